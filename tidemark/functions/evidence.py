"""Evidence gates: words that a category's text must hold, or else the category is corrected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of evidence.
CONFLICT = (
    r"\b(?:airstrike|air strike|attack\w*|missile|drone|troops|soldier\w*|army|military|militant\w*|rebel\w*|insurgent\w*|gunmen|gunman|shelling|invasion|ceasefire|warplane\w*|"
    r"bomb\w*|explosion\w*|terror\w*|hostage\w*|casualt\w*|wounded|war\b|combat\b|genocide|massacre\w*|ethnic cleansing|war crime\w*|atrocit\w*|death toll|"
    r"shot dead|killed in|kill(?:s|ed|ing)?\b[\s\w]{0,12}\d)"
)
PROTEST = r"\b(?:protest\w*|demonstrat\w*|riot\w*|rally|rallies|march(?:es)?|strike\w*|unrest|crackdown|activist\w*)\b"
NATURAL = (
    r"\b(?:earthquake|quake|aftershock\w*|magnitude|richter|tremor\w*|flood\w*|flash flood|wildfire\w*|bushfire\w*|hurricane|typhoon|cyclone|"
    r"tornado|tsunami|landslide|mudslide|volcan\w*|eruption|drought|heatwave)\b"
)
MILITARY = r"\b(?:airstrike|air strike|missile\w*|drone\w*|shell(?:ing|ed)?|bombard\w*|troops|soldier\w*|militant\w*|warplane\w*|struck|strikes?\b)\b"
ACCIDENT = r"\b(?:crash\w*|collision|collaps\w*|fire|blaze|explos\w*|blast|capsiz\w*|sank|sunk|shipwreck|derail\w*|accident\w*|spill|leak|turbulence|stampede|wreck\w*)\b"
ACTOR = r"\b(?:attack\w*|terror\w*|militant\w*|rebel\w*|insurgent\w*|gunmen|gunman|hostage\w*|genocide|massacre\w*|war crime\w*|atrocit\w*)\b"
MEETING = (
    r"\b(?:meets?|met with|holds? talks|held talks|summit|discuss(?:es|ed|ion)?|envoy|ambassador|diplomat\w*|foreign minister|peace (?:talks|deal|plan|process)|"
    r"\bpope\b|vatican|patriarch|archbishop|\bcleric\b)\b"
)
HEALTH = (
    r"\b(?:disease\w*|virus\w*|viral|outbreak\w*|infect\w*|pandemic\w*|epidemic\w*|patient\w*|hospital\w*|clinic\w*|vaccin\w*|physician\w*|doctor\w*|nurse\w*|"
    r"medicine|symptom\w*|illness\w*|cancer|diabet\w*|mental health|pregnan\w*|maternal|surger\w*|therap\w*|coronavirus|covid|\bWHO\b|health ministry|"
    r"health\s+system|healthcare system|public health (?:emergency|crisis|official|agency))\b"
)


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def gated(category: Column, text: Column, downgrade: bool = True) -> Column:
    """The category after the lateral swaps (one at most) and, if asked for, the two downgrades to general."""
    hostile = has(text, MILITARY) | has(text, ACTOR)
    physical = has(text, NATURAL) | has(text, ACCIDENT)
    swapped = (
        F.when((category == "conflict") & ~hostile & physical, "disaster")
        .when((category == "disaster") & has(text, MILITARY) & has(text, CONFLICT), "conflict")
        .when((category == "conflict") & ~hostile & has(text, MEETING), "political")
        .otherwise(category)
    )
    if not downgrade:
        return swapped
    return F.when((swapped == "conflict") & ~has(text, CONFLICT), "general").when((swapped == "disaster") & ~physical, "general").otherwise(swapped)


def guarded(category: Column, text: Column, second: Column) -> Column:
    """A health verdict without evidence takes the second best category."""
    return F.when((category == "health") & ~has(text, HEALTH), F.coalesce(second, category)).otherwise(category)


def sub_guarded(category: Column, sub: Column, text: Column) -> Column:
    return F.when((category == "political") & (sub == "protest-policy") & ~has(text, PROTEST), "other").otherwise(sub)


def verdict(category: Column, confidence: Column, sub: Column, allowed: list[str]) -> Column:
    """struct of a judge's verdict: an unknown category is null, confidence within 0 and 1, an empty sub is other."""
    return F.struct(F.when(category.isin(allowed), category).alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))).alias("confidence"), F.coalesce(F.nullif(F.trim(sub), F.lit("")), F.lit("other")).alias("sub"))
