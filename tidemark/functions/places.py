"""Place names: normal forms, aliases, the first place of a text, conflicts of city and country."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .routing import lookup

# Variants of country names, places without a country entry, demonyms.
COUNTRY_ALIASES = {
    "usa": "United States", "us": "United States", "u.s.": "United States", "u.s.a.": "United States", "america": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "britain": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom", "scotland": "United Kingdom",
    "wales": "United Kingdom", "northern ireland": "United Kingdom", "russian federation": "Russia", "czech republic": "Czechia", "turkiye": "Turkey", "türkiye": "Turkey",
    "burma": "Myanmar", "dr congo": "Democratic Republic of the Congo", "drc": "Democratic Republic of the Congo", "congo-kinshasa": "Democratic Republic of the Congo",
    "congo (kinshasa)": "Democratic Republic of the Congo", "congo-brazzaville": "Republic of the Congo", "cape verde": "Cabo Verde", "swaziland": "Eswatini",
    "macedonia": "North Macedonia", "vatican city": "Vatican", "holy see": "Vatican", "uae": "United Arab Emirates", "u.a.e.": "United Arab Emirates", "the emirates": "United Arab Emirates",
    "south korea": "South Korea", "north korea": "North Korea",
}
EXTRA_PLACES = {
    "palestine": (31.9522, 35.2332), "palestinian territories": (31.9522, 35.2332), "west bank": (31.9522, 35.2332), "gaza": (31.5, 34.47), "gaza strip": (31.5, 34.47),
    "gaza city": (31.5, 34.47), "kosovo": (42.6026, 20.9030), "jammu and kashmir": (33.7782, 76.5762), "kashmir": (33.7782, 76.5762),
}
CITY_ALIASES = {"kiev": "kyiv"}
DEMONYMS = {
    "russian": "Russia", "ukrainian": "Ukraine", "chinese": "China", "israeli": "Israel", "palestinian": "Palestine", "iranian": "Iran", "syrian": "Syria", "iraqi": "Iraq",
    "afghan": "Afghanistan", "japanese": "Japan", "german": "Germany", "french": "France", "british": "United Kingdom", "spanish": "Spain", "italian": "Italy", "turkish": "Turkey",
    "egyptian": "Egypt", "saudi": "Saudi Arabia", "pakistani": "Pakistan", "mexican": "Mexico", "brazilian": "Brazil", "nigerian": "Nigeria", "venezuelan": "Venezuela",
    "lebanese": "Lebanon", "yemeni": "Yemen", "sudanese": "Sudan", "greek": "Greece", "polish": "Poland", "dutch": "Netherlands", "swedish": "Sweden", "portuguese": "Portugal",
    "taiwanese": "Taiwan", "vietnamese": "Vietnam", "thai": "Thailand", "indonesian": "Indonesia", "filipino": "Philippines", "australian": "Australia", "canadian": "Canada",
    "colombian": "Colombia", "cuban": "Cuba", "ethiopian": "Ethiopia", "kenyan": "Kenya", "somali": "Somalia", "libyan": "Libya", "algerian": "Algeria", "moroccan": "Morocco",
    "tunisian": "Tunisia", "qatari": "Qatar",
}
#: Fixed value: what tells that a text is about the United States.
US_CONTEXT = r"\bUS\b|(?i:\bU\.S\.?A?\b|\bunited states\b|\bamerican\b|\bwashington\b)"


def normal(name: Column) -> Column:
    """Lower case without quotes around it and a leading `the`."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^[\"']+|[\"']+$", ""), "^the ", "")


def canonical_country(name: Column, countries: list[str]) -> Column:
    """The canonical name of an alias; a known country or extra place as it was written; else null."""
    known = [c.lower() for c in countries] + list(EXTRA_PLACES)
    return F.coalesce(lookup(COUNTRY_ALIASES, normal(name)), F.when(normal(name).isin(known), F.regexp_replace(F.trim(name), r"^[\"']+|[\"']+$", "")))


def place_pattern(countries: list[str]) -> str:
    """All names, the longest first; the pronoun-like alias is left to direct look-ups."""
    names = {c.lower() for c in countries} | set(COUNTRY_ALIASES) | set(EXTRA_PLACES)
    return r"(?i)\b(" + "|".join(re.escape(n) for n in sorted(names - {"us"}, key=lambda n: (-len(n), n))) + r")\b"


def find_place(text: Column, countries: list[str]) -> Column:
    """The first country, alias or extra place in the text, else the country of the first demonym, else null."""
    place = F.nullif(F.regexp_extract(text, place_pattern(countries), 1), F.lit(""))
    demonym = F.regexp_extract(text, r"(?i)\b(" + "|".join(sorted(DEMONYMS, key=lambda n: (-len(n), n))) + r")\b", 1)
    return F.coalesce(place, lookup(DEMONYMS, F.lower(demonym)))


def state_or_country(country: Column, text: Column) -> Column:
    """Georgia is the state where the text is about the United States."""
    return F.when((normal(country) == "georgia") & F.coalesce(text, F.lit("")).rlike(US_CONTEXT), "United States").otherwise(country)


def city_conflicts(places: DataFrame, cities: DataFrame, countries: list[str]) -> DataFrame:
    """places (city, country) with conflict: both are known and the city's own country is another one.

    cities: (city, city_country), the most populous per lower-case name."""
    own = cities.select(F.lower("city").alias("_c"), "city_country")
    key = F.coalesce(lookup(CITY_ALIASES, normal(F.col("city"))), normal(F.col("city")))
    paired = canonical_country(F.col("country"), countries)
    return places.join(own, key == F.col("_c"), "left").withColumn("conflict", F.coalesce(F.col("city_country") != paired, F.lit(False))).drop("_c", "city_country")


def extra_coordinates(name: Column) -> Column:
    """struct<latitude, longitude> of a place without a country entry, or null."""
    return F.when(normal(name).isin(list(EXTRA_PLACES)), F.struct(lookup({k: v[0] for k, v in EXTRA_PLACES.items()}, normal(name)).alias("latitude"), lookup({k: v[1] for k, v in EXTRA_PLACES.items()}, normal(name)).alias("longitude")))
