"""Copies of a text don't move the quality rules' raw counts."""

import random

from plinth.llm import quality_rules

LABELS = "doc_id long, quality int, toxic int"


def test_unlabelled_clean_copies_are_kept_and_move_no_score(spark, prose):
    """A clean text without a label, in a third of all rows (with other white space in some)."""
    words = prose(40).split()
    text = lambda i: " ".join(random.Random(i).choices(words, k=60))
    rows = [(i, text(i)) for i in range(200)]
    copies = [(1000 + i, text(999).replace(" ", "\n" if i % 3 else "  ")) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], LABELS)
    score = lambda x: {r["doc_id"]: (r["score"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(x, "doc_id long, text string"), labels).select("row.doc_id", "score", "kept").collect()}
    once, many = score(rows + copies[:1]), score(rows + copies)
    assert all(many[d][1] for d, _ in copies)
    assert {d: many[d] for d in once} == once
