"""Entities in text: mail addresses, web addresses, dates, amounts and phone numbers.

Patterns are columns over Java regular expressions; matches are trimmed of closing punctuation, distinct in order of
appearance, at most ``MOST`` a type (the reference result is a top-k report). Words, digits and white space are those of
Unicode, so the classes are spelled out; boundaries are looked at and not consumed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import LETTER, SPACE

MOST = 25
W, S, D = f"[{LETTER}]", f"[{SPACE}]", r"\p{Nd}"
#: Where a word begins or ends.
EDGE = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
#: Month names that dates are recognised by (fixed values).
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|ene|abr|ago|dic"
#: Currencies before and after an amount (fixed values).
BEFORE, AFTER = r"US\$|MX\$|\$|€|£", "USD|MXN|EUR|€|pesos|dollars"
JOINT = rf"(?:{S}|[.-])"
PATTERNS = {
    "emails": rf"(?<!{W}){W}[{LETTER}.+-]*@[{LETTER}-]+(?:\.[{LETTER}-]+)+{EDGE}",
    "urls": rf"(?i)(?<!{W})https?://[^{SPACE}<>()\"']+",
    "dates": rf"(?i){EDGE}(?:{D}{{4}}-{D}{{2}}-{D}{{2}}|{D}{{1,2}}[/.-]{D}{{1,2}}[/.-]{D}{{2,4}}|{D}{{1,2}}{S}+(?:de{S}+)?(?:{MONTHS})[a-z]*\.?(?:{S}+(?:de{S}+)?{D}{{4}})?){EDGE}",
    "amounts": rf"(?i)(?:{BEFORE}){S}?{D}[\p{{Nd}},.]*{D}|{EDGE}{D}[\p{{Nd}},.]*{D}{S}?(?:{AFTER}){EDGE}",
    "phone_numbers": rf"(?<!{W})(?:(?:\+{D}{{1,3}}{JOINT}?)?(?:\({D}{{2,3}}\){JOINT}?)?{D}{{2,4}}{JOINT}{D}{{3,4}}{JOINT}{D}{{3,4}}|\+{D}{{11,13}})(?!{W})",
}


def entities(text: Column, kind: str) -> Column:
    """Distinct values of one type, in order of appearance; null text gives null."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    bare = F.transform(found, lambda v: F.regexp_replace(F.regexp_replace(v, f"^{S}+|{S}+$", ""), r"[.,;:]+$", ""))
    return F.slice(F.array_distinct(bare), 1, MOST)


def all_entities(text: Column) -> Column:
    """Map from type to values; types without a value are absent."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), entities(text, k).alias("value")) for k in PATTERNS])
    return F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))
