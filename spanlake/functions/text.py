"""Scalar text functions as Column expressions.  Offsets count code points from 0 and intervals are half open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MarkerRule:
    """An ordered rule: group 1 of ``pattern`` is the label; ``heading`` rules need a heading of level 2 or 3."""

    kind: str
    pattern: str
    heading: bool


# The label forms of Bulgarian legal texts, tried in this order.
LEGAL_RULES = (
    MarkerRule("part", r"(?iU)^[ \t]*(Част\b(?:[ \t]+[^\s.]+)?)", True),
    MarkerRule("chapter", r"(?iU)^[ \t]*(Глава\b(?:[ \t]+[^\s.]+)?)", True),
    MarkerRule("section", r"(?iU)^[ \t]*(Раздел\b(?:[ \t]+[^\s.]+)?)", True),
    MarkerRule("article", r"(?iU)^[ \t]*((?:Чл\.|Член\b)[ \t]*[0-9]+[а-я]?)(?=$|[\s.,:;()])", False),
    MarkerRule("paragraph_sign", r"(?iU)^[ \t]*(§[ \t]*[0-9]+[а-я]?)(?=$|[\s.,:;()])", False),
    MarkerRule("annex", r"(?iU)^[ \t]*(Приложение\b(?:[ \t]+№?[ \t]*(?:[0-9]+[а-я]?|[IVXLCDMІ]+)\b)?)", True),
)
# What follows a label that a text amends, and the cues of a publication note.
AMENDMENT = r"(?iU)^се\s+(?:изменя|изменят|допълва|допълват|отменя|отменят)\b"
NOTE_CUE = r"(?iU)(?:\b(?:изм|доп|отм|обн|попр)\.|\bнов(?:а|о|и)?\b)"
NOTE_ISSUE = r"(?iU)\bДВ\b"
SUMMARY_MARK, ORIGINAL_MARK = "[EN summary]", "[EN original]"


def heading_level(style_id: Column) -> Column:
    """1 to 9 for Heading1 to Heading9, else null."""
    return F.regexp_extract(style_id, "^Heading([1-9])$", 1).try_cast("int")


def nonempty(text: Column) -> Column:
    """Not null, not empty and not white space alone (with the separators U+001C to U+001F)."""
    return F.coalesce((F.length(text) > 0) & ~text.rlike(r"(?U)^[\s\x1c-\x1f]+$"), F.lit(False))


def marker(text: Column, heading: Column, region: Column | None = None, rules: tuple[MarkerRule, ...] = LEGAL_RULES) -> Column:
    """struct(kind, label, lo, hi) of the first rule that matches a block of the full text, else null."""
    inside = F.lit(True) if region is None else region == "full_text"
    out = F.lit(None)
    for rule in reversed(rules):
        label = F.regexp_extract(text, rule.pattern, 1)
        lo = F.length(F.regexp_extract(text, r"^[ \t]*", 0))
        hit = F.struct(F.lit(rule.kind).alias("kind"), label.alias("label"), lo.alias("lo"), (lo + F.length(label)).alias("hi"))
        ok = (label != "") & inside & (heading.isin(2, 3) if rule.heading else F.lit(True))
        out = F.when(F.coalesce(ok, F.lit(False)), hit).otherwise(out)
    return out


def amends(tail: Column) -> Column:
    """Whether what follows a label is an instruction to amend."""
    return F.regexp_replace(tail, "^[ .:–—-]+", "").rlike(AMENDMENT)


def url_without_fragment(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def reference_parts(text: Column) -> Column:
    """struct(excerpt, start, end, summary): cut at the summary mark, without the original mark and outer white space."""
    at = F.instr(text, SUMMARY_MARK)
    body = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    lead = F.length(F.regexp_extract(body, r"(?U)^\s*(?:\[EN original\])?\s*", 0))
    excerpt = F.regexp_replace(F.substring(body, lead + 1, F.length(body)), r"(?U)\s+$", "")
    return F.struct(excerpt.alias("excerpt"), lead.alias("start"), (lead + F.length(excerpt)).alias("end"), F.when(at > 0, F.substring(text, at, F.length(text))).alias("summary"))


def probes(text: Column, size: int = 80, step: int = 40, least: int = 60) -> Column:
    """Distinct slices of ``size`` every ``step`` characters, in order, of at least ``least`` characters."""
    n = F.length(text)
    slices = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.array_distinct(F.filter(slices, lambda s: F.length(s) >= least))


def occurrences(text: Column, excerpt: Column) -> Column:
    """Starts of all, also overlapping, matches of a literal; none for an empty one."""
    most = F.length(text) - F.length(excerpt)
    found = F.filter(F.sequence(F.lit(0), F.greatest(most, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(excerpt)) == excerpt)
    return F.when((F.length(excerpt) > 0) & text.contains(excerpt), found).otherwise(F.array().cast("array<int>"))


def citation(text: Column, kind: Column | None = None) -> Column:
    """struct(family, number) of a leading article or paragraph label, the number in lower case; null if there is none.

    The number ends at the end of a word: 'Чл. 2текст' has none.  With ``kind`` only a block whose marker is of the
    label's own family counts."""
    out = F.lit(None)
    for family, pattern in (("paragraph_sign", r"(?iU)^\s*§\s*([0-9]+[а-я]?)\b"), ("article", r"(?iU)^\s*(?:Чл\.|Член)\s*([0-9]+[а-я]?)\b")):
        number = F.regexp_extract(text, pattern, 1)
        ok = number != "" if kind is None else (number != "") & F.coalesce(kind == family, F.lit(False))
        out = F.when(ok, F.struct(F.lit(family).alias("family"), F.lower(number).alias("number"))).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    """Text that is safe inside HTML and inside an attribute's quotes."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def preview(text: Column, most: int = 160) -> Column:
    return F.substring(text, 1, most)


def is_region_marker(text: Column, heading: Column, marker: str) -> Column:
    """A heading of level 2 with exactly this text."""
    return F.coalesce((heading == 2) & (text == marker), F.lit(False))
