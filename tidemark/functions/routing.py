"""Routing of events to weighted market symbols, and the scores that feed it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import places

# The routing tables.
PANEL = ["CL=F", "GC=F", "BTC-USD", "SPY", "EURUSD=X"]
TOPIC_SYMBOLS = {
    "ukraine-war": ["NG=F", "ZW=F", "CL=F", "GC=F", "^VIX"],
    "russia-ukraine": ["NG=F", "ZW=F", "CL=F", "GC=F", "^VIX"],
    "middle-east-conflict": ["CL=F", "GC=F", "^VIX"],
    "iran": ["CL=F", "GC=F", "^VIX"],
    "opec": ["CL=F"],
    "fed-rates": ["^TNX", "SPY", "GC=F", "DX-Y.NYB"],
    "us-economy": ["SPY", "DX-Y.NYB", "^VIX"],
    "china-economy": ["CL=F", "SPY"],
    "us-china-trade": ["SPY", "DX-Y.NYB", "^VIX"],
    "inflation": ["GC=F", "^TNX", "DX-Y.NYB"],
    "crypto": ["BTC-USD", "ETH-USD"],
    "bitcoin": ["BTC-USD"],
}
REGION_RULES = [
    ("conflict", "middle east", ["CL=F", "GC=F", "^VIX"]),
    ("conflict", "russia", ["NG=F", "GC=F", "^VIX"]),
    ("conflict", "ukraine", ["NG=F", "ZW=F", "^VIX"]),
    ("conflict", "iran", ["CL=F", "GC=F", "^VIX"]),
    ("conflict", "israel", ["CL=F", "GC=F", "^VIX"]),
    ("conflict", "", ["GC=F", "^VIX", "CL=F"]),
    ("disaster", "gulf", ["CL=F"]),
    ("disaster", "", ["GC=F"]),
    ("economic", "", ["SPY", "GC=F", "^TNX", "DX-Y.NYB"]),
    ("political", "us", ["SPY", "DX-Y.NYB", "^VIX"]),
    ("political", "", ["GC=F", "SPY", "^VIX"]),
    ("health", "", ["^VIX", "SPY"]),
]
CATEGORY_DEFAULTS = {
    "conflict": ["GC=F", "CL=F", "^VIX"],
    "economic": ["SPY", "GC=F", "^TNX"],
    "political": ["GC=F", "SPY"],
    "disaster": ["GC=F"],
    "health": ["^VIX", "SPY"],
    "protest": ["GC=F"],
}
SUB_CATEGORY_AFFINITY = {
    "war": 1.0, "airstrike": 0.9, "strike": 0.9, "insurgency": 0.6, "terrorism": 0.8, "border-clash": 0.7, "border_clash": 0.7,
    "ground_offensive": 0.9, "naval": 0.8, "siege": 0.7, "casualties": 0.7, "ceasefire": 0.8,
    "earthquake": 0.7, "flood": 0.5, "storm": 0.6, "wildfire": 0.5, "industrial-accident": 0.7, "industrial_accident": 0.7, "explosion": 0.7, "epidemic": 0.6,
    "monetary-policy": 1.0, "monetary_policy": 1.0, "energy": 0.9, "trade": 0.8, "tariffs": 0.8, "trade/tariffs": 0.8, "labor": 0.6, "markets": 0.9,
    "sanctions": 0.8, "sanction": 0.8, "inflation": 0.9, "fiscal": 0.7, "supply_chain": 0.7,
    "election": 0.7, "legislation": 0.6, "diplomacy": 0.6, "leadership-change": 0.8, "leadership_change": 0.8, "coup": 0.9, "protest-policy": 0.5,
    "outbreak": 0.7, "pandemic": 0.9, "healthcare-system": 0.4,
}
SYMBOL_AFFINITY = {
    ("conflict", "GC=F"): -0.8, ("conflict", "CL=F"): -0.9, ("conflict", "NG=F"): -0.8, ("conflict", "ZW=F"): -0.7, ("conflict", "^VIX"): -0.9, ("conflict", "SPY"): 0.6,
    ("economic", "SPY"): 0.9, ("economic", "GC=F"): -0.4, ("economic", "^TNX"): 0.9, ("economic", "DX-Y.NYB"): 0.8, ("economic", "^VIX"): -0.6,
    ("political", "GC=F"): -0.6, ("political", "SPY"): 0.7, ("political", "^VIX"): -0.7, ("political", "DX-Y.NYB"): 0.6,
    ("disaster", "GC=F"): -0.5, ("disaster", "CL=F"): -0.5, ("health", "^VIX"): -0.6, ("health", "SPY"): 0.5,
}
COUNTRY_RISK = {
    "united states": 1.0, "usa": 1.0, "us": 1.0, "china": 0.95, "russia": 0.9, "ukraine": 0.85, "iran": 0.85, "israel": 0.8, "saudi arabia": 0.8,
    "european union": 0.85, "germany": 0.75, "united kingdom": 0.7, "uk": 0.7, "japan": 0.75, "india": 0.7, "taiwan": 0.8, "north korea": 0.7,
}
CATEGORY_FLOORS = {"conflict": 6.0, "disaster": 6.0, "health": 5.0, "political": 4.0, "economic": 4.0}
INTENSITY_PRIORS = {
    ("conflict", "war"): 0.7, ("conflict", "airstrike"): 0.6, ("conflict", "insurgency"): 0.55, ("conflict", "terrorism"): 0.65, ("conflict", "border-clash"): 0.55, ("conflict", "other"): 0.5,
    ("disaster", "earthquake"): 0.55, ("disaster", "flood"): 0.5, ("disaster", "storm"): 0.5, ("disaster", "wildfire"): 0.45, ("disaster", "industrial-accident"): 0.45,
    ("disaster", "infrastructure"): 0.4, ("disaster", "other"): 0.4,
    ("economic", "monetary-policy"): 0.45, ("economic", "energy"): 0.35, ("economic", "trade"): 0.35, ("economic", "tariffs"): 0.4, ("economic", "labor"): 0.3,
    ("economic", "markets"): 0.35, ("economic", "sanctions"): 0.45, ("economic", "other"): 0.3,
    ("political", "election"): 0.4, ("political", "legislation"): 0.3, ("political", "diplomacy"): 0.35, ("political", "leadership-change"): 0.45,
    ("political", "protest-policy"): 0.4, ("political", "other"): 0.3,
    ("health", "outbreak"): 0.5, ("health", "pandemic"): 0.7, ("health", "healthcare-system"): 0.3, ("health", "other"): 0.25, ("general", "other"): 0.15,
}


def lookup(table: dict, key: Column, default: Column | float | None = None) -> Column:
    """table[key] as a literal map; default where the key is null or absent."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def pair_lookup(table: dict, a: Column, b: Column, default: float) -> Column:
    return lookup({f"{x}|{y}": v for (x, y), v in table.items()}, F.concat_ws("|", a, b), default)


def country_risk(location: Column) -> Column:
    """The largest risk of a country whose name stands anywhere in the location, 0.5 at least. Substrings count: `us` is
    in `russia`."""
    place = F.lower(F.coalesce(location, F.lit("")))
    return F.greatest(F.lit(0.5), *[F.when(F.contains(place, F.lit(c)), r).otherwise(0.5) for c, r in COUNTRY_RISK.items()])


def adjusted_sentiment(category: Column, sentiment: Column) -> Column:
    return F.when((sentiment > 0) & category.isin("conflict", "disaster"), sentiment * 0.5).otherwise(sentiment)


def asymmetric_sentiment(sentiment: Column) -> Column:
    return F.when(sentiment.isNull(), 0.5).when(sentiment < 0, F.greatest(F.lit(-1.5), sentiment * 1.5)).otherwise(F.greatest(F.lit(0.3), sentiment))


def symbols(category: Column, location: Column, topics: Column, panel: list[str] = PANEL) -> Column:
    """array<string>: symbols of the topics, then of all region rules that apply, else the category's default ones; those of
    the panel, each once, in this order."""
    empty = F.array().cast("array<string>")
    place = F.lower(F.coalesce(location, F.lit("")))
    of_topics = F.flatten(F.transform(F.coalesce(topics, empty), lambda t: F.coalesce(lookup_array(TOPIC_SYMBOLS, t), empty)))
    rules = [F.when((category == c) & (F.contains(place, F.lit(r)) if r else F.lit(True)), F.array(*map(F.lit, s))).otherwise(empty) for c, r, s in REGION_RULES]
    found = F.concat(of_topics, *rules)
    found = F.when(F.size(found) > 0, found).otherwise(F.coalesce(lookup_array(CATEGORY_DEFAULTS, category), empty))
    return F.array_distinct(F.filter(found, lambda s: s.isin(panel)))


def lookup_array(table: dict, key: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(m, key)


def route(events: DataFrame, category="category", location="location_name", topics="topic_slugs", subs="sub_categories", sentiment="route_sentiment", intensity="intensity", panel=PANEL) -> DataFrame:
    """One row more for each (event, symbol): symbol and weight to 4 places. Nothing is shuffled; rules are literals."""
    c = F.col
    sub = F.coalesce(F.array_max(F.transform(subs, lambda s: lookup(SUB_CATEGORY_AFFINITY, s, 0.6))), F.lit(0.6))
    sent = asymmetric_sentiment(adjusted_sentiment(c(category), c(sentiment)))
    severity = F.when(c(intensity).isNull(), 1.0).otherwise(0.6 + 0.4 * F.greatest(F.lit(0.0), F.least(c(intensity), F.lit(1.0))))
    out = events.withColumn("symbol", F.explode(symbols(c(category), c(location), c(topics), panel)))
    affinity = pair_lookup(SYMBOL_AFFINITY, c(category), c("symbol"), 0.6)
    size = F.least(sub * F.abs(affinity) * country_risk(c(location)) * F.greatest(F.least(F.abs(sent), F.lit(1.0)), F.lit(0.1)) * severity, F.lit(1.0))
    sign = F.when((sent >= 0) == (affinity >= 0), 1.0).otherwise(-1.0)
    return out.withColumn("weight", places(sign * size, 4))


def importance(intensity: Column, weight: Column, bonus: Column, category: Column) -> Column:
    """1 to 10: base 1 + 9 intensity, times the source's weight (null: 1), plus the bonus, not below the category's floor; to 2 places."""
    raw = (1 + 9 * intensity) * F.coalesce(weight, F.lit(1.0)) + bonus
    return places(F.greatest(F.lit(1.0), F.least(F.lit(10.0), F.greatest(raw, lookup(CATEGORY_FLOORS, category, 0.0)))), 2)


def intensity(category: Column, sub_category: Column, severity: Column) -> Column:
    """Prior of the category plus lexical severity, within 0 and 1, to 4 places."""
    return places(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pair_lookup(INTENSITY_PRIORS, category, F.coalesce(sub_category, F.lit("other")), 0.2) + severity)), 4)
