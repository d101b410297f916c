"""The label rules as column expressions: folding, categories, areas, scales, levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.functions.words import CATEGORIES, LETTERS

POINT_MM = 25.4 / 72


_WITH, _WITHOUT = "".join(map(chr, LETTERS)), "".join(LETTERS.values())


def fold_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _WITH, _WITHOUT), r"\p{Mn}", ""))


def fold_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold_text(text), r"[^a-z0-9 ]+", " "))


def classify(name: Column) -> Column:
    folded = fold_words(name)
    tokens = F.split(folded, " +")
    told = F.when(name.isNull() | (name == ""), "unknown")
    for category, words in CATEGORIES:
        hit = F.lit(False)
        for w in words:
            hit = hit | (folded.contains(w) if " " in w else F.array_contains(tokens, w))
        told = told.when(hit, category)
    return told.otherwise("other")


def _number(text: Column) -> Column:
    return F.when(text != "", F.replace(text, F.lit(","), F.lit(".")).cast("double"))


def area_label(text: Column) -> Column:
    return _number(F.regexp_extract(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:m2|m²|sqm|m\^2)(?![\p{L}\p{N}_])", 1))


def scale_ratio(text: Column) -> Column:
    n = F.regexp_extract(text, r"\b1\s*[:/]\s*(\d{1,4})\b", 1)
    value = F.when(n != "", n).cast("int")
    return F.when(value.between(5, 500), value)


def scale_argument(text: Column) -> Column:
    """Millimetres a point from "1:50", "1/50", "50" (5 or more) or "17.64mm"; null for anything else."""
    plain = F.lower(F.replace(F.trim(text), F.lit(" "), F.lit("")))
    number = lambda c: F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), c).try_cast("double")
    ratio = number(F.regexp_extract(plain, r"^1[:/](\d+(?:\.\d+)?)$", 1)) * POINT_MM
    mm = F.when(plain.endswith("mm"), number(F.regexp_replace(plain, "mm$", "")))
    value = F.when(plain.endswith("mm"), mm).otherwise(F.coalesce(ratio, F.when(number(plain) >= 5, number(plain) * POINT_MM)))
    return F.when(value != 0, value)


def dimension_value(text: Column) -> Column:
    n = F.regexp_extract(F.trim(text), r"(?i)^[^\d]{0,2}(\d{3,6})(?:\s*mm)?[^\d]{0,2}$", 1)
    value = F.when(n != "", n).cast("int")
    return F.when(value.between(300, 50_000), value)


def level_values(text: Column) -> Column:
    found = F.regexp_extract_all(fold_text(text), F.lit(r"([+-] ?\d{1,3}[.,]\d{2,3})(?!\d)"), 1)
    values = F.transform(found, lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).cast("double"))
    return F.filter(values, lambda v: v.between(-60, 400))


def schedule_reference(text: Column) -> Column:
    n = F.regexp_extract(F.trim(fold_text(text)), r"^(?:d|dr|cua)\s*[-_]?\s*(\d{1,3})[a-z]?$", 1)
    return F.when(n != "", n)


def svg_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def step_escape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.regexp_replace(plain, r"[^\x20-\x7E]", "?")
