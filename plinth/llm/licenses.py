"""License scan: base phrases, and an exact set-similarity join with license templates.

Base: where a phrase's words stand consecutively in a text.  Method: a text's blocks are its
lines, each with the next one, so that a statement wrapped over two lines lies in one block (a
blank line ends it); a block matches a template if it holds at least ``THRESHOLD`` of the template's distinct
words.  The join is exact: template words are ordered by their frequency in all documents,
rarest first; a match must share one of the first |T| - ceil(THRESHOLD |T|) + 1 words (prefix
filter), have enough words (length filter), and the words after the first shared one must
suffice (positional filter).  What passes is verified on the full sets.

Everything runs on DataFrame functions and row by row: templates are a fixed small list, and a
text is only split into blocks where it holds a prefix word.

Defined results: a null or empty text has no words, null first_word and last_word, empty labels
and score 0; repeated rows are scanned each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import ascii_lower, bound, table

#: What stands between words: ASCII that is neither a digit nor a lower-case letter (texts are
#: lowered first; for counting, upper-case letters belong to words too).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label and words of each template: short statements that grant or name a license.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("proprietary", "all rights reserved no part may be reproduced without permission"),
)
THRESHOLD = 0.9


def normal(text: Column) -> Column:
    """Words of a lowered text, each with one blank on either side; "" without a word."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), BETWEEN, " ")


def template_words() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each template word, over all documents."""
    text = F.regexp_replace(F.lower(F.concat(F.lit(" "), "text", F.lit(" "))), BETWEEN, " ")
    words = template_words()
    counts = docs.select(text.alias("t")).agg(*[F.count(F.when(F.contains("t", F.lit(f" {w} ")), 1)).alias(f"c{i}") for i, w in enumerate(words)]).collect()[0]
    return {w: int(counts[i]) for i, w in enumerate(words)}


def ordered_templates(frequency: dict[str, int]) -> list[tuple[str, list[str]]]:
    """Each template's distinct words, rarest first, ties by the word."""
    return [(label, sorted(set(t.split()), key=lambda w: (frequency.get(w, 0), w))) for label, t in TEMPLATES]


def global_order(templates: list[tuple[str, list[str]]]) -> list[str]:
    """All template words in one order in which every template's own words stand."""
    place: dict[str, int] = {}
    left = [list(words) for _, words in templates]
    while left := [w for w in left if w]:
        # the templates are sorted by one key, so some first word is in no other's tail
        first = next(w[0] for w in left if not any(w[0] in other[1:] for other in left))
        place[first] = len(place)
        left = [w[1:] if w[0] == first else w for w in left]
    return list(place)


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _overlap(block: Column, words: list[str], threshold: float) -> Column:
    """Words of the template in the block, 0 where a filter or the threshold fails.  ``block``
    holds the block's template words (of any template), in the global order."""
    n, need = len(words), needed(len(words), threshold)
    has = [F.array_contains(block, w) for w in words]
    total = sum((h.cast("int") for h in has[1:]), has[0].cast("int"))
    # a match shares a prefix word, and from it on the block still has enough words
    shared = F.lit(False)
    for w in words[: n - need + 1]:
        at = F.array_position(block, w)
        shared = shared | ((at > 0) & (F.size(block) - at + 1 >= need))
    return F.when((F.size(block) >= need) & shared & (total >= need), total).otherwise(0)


def block_matches(text: Column, templates: list[tuple[str, list[str]]], threshold: float = THRESHOLD) -> Column:
    """array<struct<label, score>> of the templates that some block of the raw text matches."""
    lines = bound(F.split(text, "\n"), lambda x: F.zip_with(x, F.concat(F.slice(x, 2, F.size(x)), F.array(F.lit(""))), lambda a, b: F.concat(a, F.lit(" "), b)))
    lines = F.filter(lines, lambda x: F.length(x) > 1)
    order = F.split(F.lit(" ".join(global_order(templates))), " ")
    words_of = lambda x: F.split(F.btrim(normal(x)), " ")
    blocks = F.transform(F.transform(lines, words_of), lambda b: F.filter(order, lambda w: F.array_contains(b, w)))

    def best(b: Column, words: list[str]) -> Column:
        return F.array_max(F.transform(b, lambda x: _overlap(x, words, threshold)))

    def scored(b: Column) -> Column:
        found = [F.struct(F.lit(label).alias("label"), (F.coalesce(best(b, words), F.lit(0)) / len(words)).alias("score")) for label, words in templates]
        return F.filter(F.array(*found), lambda x: x["score"] > 0)

    return bound(blocks, scored)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of
    ``docs(doc_id, text, ...)``; score is the best containment, 1 for a base phrase."""
    only = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    templates = ordered_templates(frequencies(only))
    rough = F.regexp_replace(F.concat(F.lit(" "), "text", F.lit(" ")), BETWEEN_RAW, " ")
    prefixes = sorted({w for _, words in templates for w in words[: len(words) - needed(len(words), threshold) + 1]})
    held = lambda words: F.array(*[F.contains("low", F.lit(f" {w} ")) for w in words])
    # lower() changes more than A-Z, so it only finds rows to look at; what counts is lowered exactly
    rows = only.select("doc_id", "text", rough.alias("rough")).select(
        "doc_id", "text", "rough", F.lower("rough").alias("low"),
        (F.length("rough") - F.length(F.replace("rough", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
    )
    maybe = rows.select(
        "doc_id", "n_words",
        F.when(F.exists(held([p for p, _ in PHRASES]), lambda x: x), F.split(F.btrim(ascii_lower(F.col("rough"))), " ")).alias("words"),
        F.when(F.exists(held(prefixes), lambda x: x), block_matches(F.col("text"), templates, threshold)).alias("matches"),
    )

    def starts(words: Column, phrase: str) -> Column:
        parts = phrase.split()
        here = lambda w, i: F.when((w == parts[0]) & _follows(words, i, parts), i)
        return F.filter(F.transform(words, here), lambda i: i.isNotNull())

    def _follows(words: Column, i: Column, parts: list[str]) -> Column:
        told = F.lit(True)
        for k, p in enumerate(parts[1:], 1):
            told = told & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return told

    nothing = F.array().cast("array<struct<at:int,label:string>>")
    labelled = lambda at, label: F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    places = lambda words: F.concat(*[labelled(starts(words, p), label) for p, label in PHRASES])
    found = maybe.select("doc_id", "n_words", F.coalesce(F.when(F.col("words").isNotNull(), bound(F.col("words"), places)), nothing).alias("base"), F.coalesce("matches", F.array().cast("array<struct<label:string,score:double>>")).alias("matches"))
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("base.label"), F.col("matches.label"))))
    return found.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.at")).cast("long").alias("first_word"),
        F.array_max(F.col("base.at")).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same scan in DuckDB: every block against every template, without filters."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    base = []
    for phrase, label in PHRASES:
        here = " and ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        base.append(f"list_transform(list_filter(range(len(ws)), lambda i: {here}), lambda i: {{'at': i, 'label': '{label}'}})")
    joined = base[0]
    for b in base[1:]:
        joined = f"list_concat({joined}, {b})"
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))})" for label, t in TEMPLATES)
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, {words.format(low.format("t"))} as ws from d),
b as (select r, doc_id, t, len(ws)::bigint as n_words, {joined} as base from w),
t(label, words) as (values {templates}),
l as (select r, list_distinct({words.format(low.format("x"))}) as block from (select r, unnest(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || ' ' || coalesce(ls[i + 1], ''))) as x from (select r, string_split(t, chr(10)) as ls from d))),
m as (select r, label, max(len(list_intersect(block, words)) / len(words)) as share from l, t where len(list_intersect(block, words)) >= {THRESHOLD} * len(words) - 1e-9 group by r, label),
f as (select r, list(label) as found, max(share) as share from m group by r)
select doc_id, n_words, len(base)::bigint as n_base, list_min([x.at for x in base])::bigint as first_word, list_max([x.at for x in base])::bigint as last_word,
       coalesce(array_to_string(list_sort(list_distinct([x.label for x in base])), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat([x.label for x in base], coalesce(found, [])))), ','), '') as labels,
       case when len(base) > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from b left join f using (r)
"""


ORACLE_SQL = _oracle()
