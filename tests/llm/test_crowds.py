"""Pairs inside a crowd of texts a little under the threshold that share a bucket."""

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm import neardup


def test_pairs_of_one_bucket_are_all_verified(spark):
    """60 texts at 220 / 280 of each other in one bucket, and 15 pairs among them at 225 / 275."""
    common, rows = [f"c{i}" for i in range(220)], []
    for i in range(60):
        own = [f"o{i}x{k}" for k in range(30)]
        if i < 30:
            own[:5] = [f"p{i // 2}x{k}" for k in range(5)]
        rows.append((i, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # one tuple of each collection is shared by all, so they fill one bucket
    classes = neardup.cut(neardup.classes_of(neardup.sketches(docs, 1)))
    at, n = neardup.HALVES, neardup.HASHES // neardup.TUPLE

    def alike(batches):
        for rows in batches:
            made = np.arange(len(rows) * n, dtype=np.int32).reshape(-1, n) + 1000 * n * (rows["node"].to_numpy()[:, None].astype(np.int32) + 1)
            made[:, 0], made[:, at] = 1, 2
            yield rows.assign(tuples=[x.tobytes() for x in made])

    classes = neardup.cut(classes.mapInPandas(alike, classes.schema))
    parts = neardup.links(classes, docs, 1, 80).join(classes, "node").select("rep", "component").collect()
    groups = {}
    for r in parts:
        groups.setdefault(r["component"], set()).add(r["rep"])
    assert sorted(map(sorted, groups.values())) == [[i, i + 1] for i in range(0, 30, 2)]


@pytest.mark.parametrize("small", [100, 5])
def test_large_buckets_are_dealt_out_in_blocks(spark, monkeypatch, small):
    """Every pair that is apart and may be similar is found once, whatever the number of blocks."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    parity = lambda i: bytes([255 if i % 3 else 0] * 4) + b"\0" * (neardup.PARITY_BITS // 8 - 4)
    sizes = spark.createDataFrame([(i, 50 if i % 10 else 20, parity(i)) for i in range(40)], "node long, n_shingles long, parity binary")
    rows = [((b << 32) + 5, 40 if b == 1 else 9, i, max(i, 2)) for b in (1, 2) for i in range(40 if b == 1 else 9)]
    members = spark.createDataFrame(rows, "bucket long, n long, node long, part long")
    got = sorted((r["hub"], r["node"]) for r in neardup.rest_pairs(members, sizes, 80).collect())
    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40) if j > 2 and (i % 10 == 0) == (j % 10 == 0) and (i % 3 == 0) == (j % 3 == 0)]


def test_keys_of_one_class_go_and_ends_of_partitions_stay():
    """Sorted keys in batches of any cut: exactly those that a neighbour shares, and the two ends."""
    bucket = [1, 2, 2, 3, 5, 5, 5, 5, 6, 7, 7, 9]
    want = [1, 2, 2, 5, 5, 5, 5, 7, 7, 9]
    for size in (1, 2, 3, 5, 12):
        cuts = [pa.RecordBatch.from_arrays([pa.array(bucket[i : i + size]), pa.array(range(i, min(i + size, 12)))], ["bucket", "node"]) for i in range(0, 12, size)]
        got = [b for x in neardup._shared(iter(cuts)) for b in x.column("bucket").to_pylist()]
        assert got == want
    assert list(neardup._shared(iter([]))) == []


def test_parity_bound_never_drops_a_link():
    """The bound from bitmaps holds for sets of all sizes and differences."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        both, a, b = rng.integers(1, 3000), rng.integers(0, 400), rng.integers(0, 400)
        values = rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64)
        x, y = np.unique(values[: both + a]), np.unique(np.concatenate((values[:both], values[both + a :])))
        same = len(np.intersect1d(x, y))
        differ = np.bitwise_count(np.frombuffer(neardup.parities(x), np.uint64) ^ np.frombuffer(neardup.parities(y), np.uint64)).sum()
        assert differ <= len(x) + len(y) - 2 * same
        if 100 * same >= 80 * (len(x) + len(y) - same):
            assert neardup._may_link(np.array([len(x)]), np.array([len(y)]), np.array([differ]), 80)[0]
