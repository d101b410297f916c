"""Spelling variants grouped by a symmetric-delete join.

Words are counted over whole texts.  Every word emits itself and its single deletions as keys, and
words meet where they share one; which distance a shared key stands for is part of the join key:

* a word that is a deletion of another differs from it by one inserted code point (an equi-join of
  each word's distinct deletions with the words);
* words with the same deletion at the same position differ by the code point there.  Such a group
  has one word for each letter at most, and each member's near words are all the others, so the
  group gives counts and its two most frequent words, and no pair is written.

Words of over ``LONG`` code points would emit keys of quadratic size.  Of two that differ by one
edit, one half is the same (counted from the start, or from the end), so they meet on halves of
both lengths and are verified by their edit distance.

A word's form is its most frequent near word if that is ``TIMES`` times as frequent; forms grow in
frequency, so roots are found by joins that double the steps taken each round.

Defined results: a null text has no words; a null doc_id is written as nothing before the ":" of
the digest; repeated rows count each; near words of equal count are taken in code-point order; a
word without a form is its own root; other columns of documents are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import ascii_lower, cut, discard, table

#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
LETTERS = r"a-zÀ-ÿ"
#: One run in so many loses a code point.
SLIP = 31
#: How many times a word's count its form has at least.
TIMES = 10
#: Code points over which words meet by halves instead of deletions.
LONG = 48


def _without(word: Column, at: Column) -> Column:
    """``word`` without the code point ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted(docs: DataFrame, slip: int = SLIP, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters, of which one in ``slip`` by a digest loses a code point."""
    # a greedy match of so many letters is a whole run, and shorter runs give no word
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    digest = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    slipped = _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    each = each.withColumn("h", digest).select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("run")).alias("word"))
    return each.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _rank(n: str, word: str) -> Column:
    """Least for the largest count, then for the first word."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def _replaced(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that differ by one replaced code point."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda i: _without(F.col("word"), i))).alias("at", "key")
    group = words.select(_rank("n", "word").alias("one"), at).groupBy("key", "at").agg(F.sort_array(F.collect_list("one")).alias("all"))
    several = group.where(F.size("all") > 1).select("all", F.explode("all").alias("one"))
    first, second = F.col("all")[0], F.col("all")[1]
    best = F.when(F.col("one") == first, second).otherwise(first)
    return several.select(F.col("one.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), best.alias("best"))


def _both(pairs: DataFrame) -> DataFrame:
    """(word, n_near, best) from ``pairs(word, n, other, m)``, both ways."""
    one, two = F.struct("word", F.lit(1).cast("long").alias("n_near"), _rank("m", "other").alias("best")), F.struct(F.col("other").alias("word"), F.lit(1).cast("long").alias("n_near"), _rank("n", "word").alias("best"))
    return pairs.select(F.inline(F.array(one, two)))


def _inserted(words: DataFrame) -> DataFrame:
    """Pairs of a word and a deletion of it that is a word, each once: of equal neighbours only the
    first is deleted."""
    word = F.col("word")
    places = F.filter(F.sequence(F.lit(0), F.length(word) - 1), lambda i: (i == 0) | (F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1))))
    keys = words.select("word", "n", F.explode(F.transform(places, lambda i: _without(word, i))).alias("other"))
    return keys.join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")


def _halves(words: DataFrame, long: int) -> DataFrame:
    """Pairs of words at distance one of which one has over ``long`` code points."""
    word, length = F.col("word"), F.length("word")
    sizes = F.array_distinct(F.array(F.floor(length / 2), F.floor((length - 1) / 2)))
    keys = F.flatten(F.transform(sizes, lambda k: F.array(F.struct(F.lit(True).alias("start"), k.alias("k"), F.substring(word, F.lit(1), k.cast("int")).alias("part")), F.struct(F.lit(False).alias("start"), k.alias("k"), F.substring(word, length - k.cast("int") + 1, k.cast("int")).alias("part")))))
    one = words.where(F.length("word") >= long).select("word", "n", F.explode(keys).alias("key"))
    two = one.select(F.col("word").alias("other"), F.col("n").alias("m"), "key")
    near = (F.col("word") < F.col("other")) & (F.greatest(F.length("word"), F.length("other")) > long) & (F.abs(F.length("word") - F.length("other")) <= 1)
    return one.join(two, "key").where(near & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m").distinct()


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n_near, best) of ``words(word, n)`` that have a near word: how many, and the most
    frequent as struct of less (minus its count) and word."""
    short = words.where(F.length("word") <= long)
    found = _replaced(short).unionByName(_both(_inserted(short))).unionByName(_both(_halves(words, long)))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last of the forms that follow each other."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        fresh = cut(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        if fresh.where("moved").isEmpty():
            return fresh.drop("moved")
        now = cut(fresh.drop("moved"), "roots")
        discard(fresh)


def variants(docs: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``."""
    words = cut(counted(docs), "words")
    found = words.join(near_words(words, long), "word", "left")
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    known = cut(found.withColumn("form", form).select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form.word").alias("form"), (-F.col("form.less")).alias("form_n")), "forms")
    last = roots(known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def families(found: DataFrame) -> DataFrame:
    """(root, n_words, n): the words that lead to each root, and how often they stand."""
    return found.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Letters beyond ASCII, and signs that stand for them where SQL counts bytes.
WIDE, SIGNS = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(48, 127)) if not "a" <= c <= "z")
SIGNS += "".join(c for c in map(chr, range(33, 48)) if c != "'")[: len(WIDE) - len(SIGNS)]

#: The digest byte by byte (letters beyond ASCII have two bytes), words that share a key by edit
#: distance, and forms followed one by one.
ORACLE_SQL = rf"""
with recursive t as (select list_transform(range(256), lambda x: list_reduce([x, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as crc),
d as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
o as (select id, run, count(*) as k, list_transform(string_split(id || ':' || run, ''), lambda c: unicode(c)) as points from d where length(run) >= {LEAST_LENGTH} group by 1, 2),
b as (select run, k, flatten(list_transform(points, lambda c: case when c < 128 then [c] else [195, c - 64] end)) as bytes from o),
h as (select run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c // 256, t.crc[xor(c, x) % 256 + 1])), 4294967295) as h from b, t),
s as (select case when h % {SLIP} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from h),
w as (select word, sum(k)::bigint as n from s where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
e as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as key from (select word, n, unnest(range(1, length(word) + 2)) as i from w)),
p as (select distinct a.word, a.n, b.word as other, b.n as m from e a join e b on a.key = b.key and a.word <> b.word
      where levenshtein(translate(a.word, '{WIDE}', '{SIGNS}'), translate(b.word, '{WIDE}', '{SIGNS}')) = 1),
f as (select word, count(*)::bigint as n_near, arg_min({{'word': other, 'm': m}}, {{'less': -m, 'word': other}}) as best from p group by word),
r as (select word, n, coalesce(n_near, 0) as n_near, case when best.m >= {TIMES} * n then best.word end as form, case when best.m >= {TIMES} * n then best.m end as form_n from w left join f using (word)),
c as (select word, word as last, 0 as step from r union all select c.word, r.form, step + 1 from c join r on c.last = r.word where r.form is not null),
z as (select word, arg_max(last, step) as root from c group by word)
select word, form, root, n, n_near, form_n from r join z using (word)
"""
