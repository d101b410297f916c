import gzip
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import licenses, packing, pieces, warc
from plinth.llm.wordcache import WordEncoder

PAGES = "page_id long, url string, html string"


def test_warc_round_trip_roles_and_ranges(spark, tmp_path):
    big, other = "é<p>x</p>" * 300, "other" * 400
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (9, None, big), (3, "u\r\nX: y", other), (4, "", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", big), (8, "u", "z" * 1000), (8, "u", "z" * 1000)]
    folder = str(tmp_path / "archives")
    df = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("d"), "key": F.lit(1)}).repartition(3)
    index = warc.archive(df, folder)
    got = {(r["page_id"], r["record_type"]): r for r in warc.read_records(index, folder).collect()}
    assert {k for k in got if k[1] == "revisit"} == {(1, "revisit"), (2, "revisit"), (None, "revisit")}
    assert all(r["refers_to"] == 9 for r in got.values() if r["record_type"] == "revisit")
    assert bytes(got[(9, "response")]["body"]) == big.encode() and bytes(got[(1, "revisit")]["body"]) == b""
    assert all(r["payload_bytes"] == len((dict((x[0], x[2]) for x in rows)[r["page_id"]] or "").encode()) for r in got.values())
    assert warc.read_records(index, folder).count() == len(rows)
    some = warc.read_records(index.where("page_id in (2, 9)"), folder).collect()
    assert sorted(r["page_id"] for r in some) == [2, 9]
    files = list(Path(folder).glob("*.warc.gz"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    empty = warc.archive(spark.createDataFrame([], PAGES), folder)
    assert empty.count() == 0 and warc.read_records(empty, folder).count() == 0


def test_warc_record_parses_back():
    data = warc.record(5, "http://x", b"\r\n\r\nWARC/1.1 body", "ab", None, False)
    headers, body = warc.parse(zlib.decompress(data, 31))
    assert body == b"\r\n\r\nWARC/1.1 body" and headers["WARC-Type"] == "response"


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def brute_matches(text):
    found = {}
    lines = (text or "").split("\n")
    for two in zip(lines, [*lines[1:], ""], strict=True):
        block = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(two))))
        for label, t in licenses.TEMPLATES:
            share = len(set(t.split()) & block) / len(set(t.split()))
            if share >= licenses.THRESHOLD - 1e-9:
                found[label] = max(share, found.get(label, 0))
    return found


def test_license_scan_matches_brute_force(spark, prose, clashing):
    rng = random.Random(6)
    lines = [t for _, t in licenses.TEMPLATES] + ["Released under the MIT License.", "CC-BY cc by", "GNU General\nPublic License", "the apache  LICENSE, version 2.0", "mİt license", "mit license mit license", "Kgnu general public license"]
    rows = []
    for i in range(80):
        text = prose(rng.randint(0, 30), i)
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(lines).split(" ")
            if rng.random() < 0.4 and len(words) > 3:
                words[rng.randrange(len(words))] = "zz"
            text += rng.choice(["\n", " ", ". "]) + " ".join(words)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(clashing.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = []
    for d, t in texts:
        base, found = brute_base(t), brute_matches(t)
        score = 1.0 if base[1] else max(found.values(), default=0.0)
        want.append((d, *base, ",".join(sorted(set(found) | set(filter(None, base[4].split(","))))), round(score, 6)))
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 6)) for r in licenses.scan(df.withColumns({"words": F.lit(1), "base": F.lit(2)})).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_a_statement_wrapped_over_two_lines_is_found(spark):
    statement = "Redistribution and use in source and binary forms,\nwith or without modification, are permitted"
    rows = [(1, f"x\n{statement}\ny"), (2, statement.replace("\n", "\n\n")), (3, statement.replace("\n", "\nand so on\n")), (4, "Subject to the terms of the Mozilla\n Public License, version 2.0")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "", 3: "", 4: "mpl"}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def test_word_encoder_has_the_tokenizers_ids(tokenizer, prose, odd):
    texts = [r["text"] or "" for r in odd.collect()] + [prose(50, 1), "It's x.y, a...b 'S don't  “q” <|endoftext|> <|endoftext|>a A.B., é. x́. 　y\x85z\x1cw\x1dq"]
    encoder = WordEncoder(packing.vocabulary_path(), cache_parts=20)
    for _ in range(2):
        got = encoder.encode(texts)
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert got == want


def check_packing(rows, out, tokenizer):
    want = sorted(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    assert sum(r["length"] for r in out) == sum(len(x) // 4 for x in want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    single = {d: t for d, t in rows if sum(x[0] == d for x in rows) == 1}
    for d, t in single.items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted((r for r in out if r["doc_id"] == d), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by)


def test_packing_places_every_id_once_with_little_padding(spark, prose, clashing, tokenizer):
    rng = random.Random(8)
    rows = [(i, prose(rng.choice([3, 10, 40, 40, 60, 90, 300, 900, 2500]), i)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(clashing.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    every = [(r["doc_id"], r["text"]) for r in df.collect()]
    out = packing.pack(df, packing.vocabulary_path()).collect()
    n = check_packing(every, out, tokenizer)
    assert n * packing.CAPACITY <= 1.05 * sum(r["length"] for r in out) + packing.CAPACITY
    assert packing.pack(df.limit(0), packing.vocabulary_path()).count() == 0


def test_cutting_stock_uses_the_demand_exactly():
    rng = random.Random(1)
    for room, n in ((64, 40), (512, 3000)):
        demand = {}
        for _ in range(n):
            s = min(room, max(1, int(rng.expovariate(6 / room))))
            demand[s] = demand.get(s, 0) + 1
        plan = packing.solve(demand, room)
        used = {}
        for times, pattern in plan:
            assert sum(s * k for s, k in pattern.items()) <= room
            for s, k in pattern.items():
                used[s] = used.get(s, 0) + times * k
        assert used == demand
        least = -(-sum(s * k for s, k in demand.items()) // room)
        assert sum(t for t, _ in plan) <= 1.03 * least + 4
    assert packing.solve({}, 64) == []


def test_knapsack_matches_brute_force():
    sizes, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.5])
    best = max(2 * a + 4 * b + 5.5 * c for a in range(7) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 19)
    value, pattern = packing._knapsack(values, sizes, 19)
    assert value == best == pattern @ values and pattern @ sizes <= 19


def test_piece_codec_parity_and_round_trip(spark, prose, clashing):
    import sentencepiece

    path = pieces.model_path()
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] or "" for r in clashing.collect()] + [prose(80, 2), "a  b   c", " lead", "trail ", "x\n\ny.. z,", "...   a", "tab\tq"]
    codec = pieces.PieceCodec(path, cache_parts=30)
    ids, parity = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == reference.encode(texts) and all(parity)
    assert [codec.decode(x) for x in ids] == [t.replace(pieces.MARK, " ") for t in texts]
    whole = [e.ids for e in codec.tokenizer.encode_batch([codec.normalise(t) for t in texts], add_special_tokens=False)]
    assert whole == reference.encode(texts)
    out = pieces.piece_codes(clashing, path).collect()
    assert len(out) == clashing.count() and all(r["parity"] and r["decoded"] for r in out)
    assert pieces.piece_codes(clashing.limit(0), path).count() == 0


def test_unigram_models_are_rebuilt():
    model = pieces.Model([("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("c", -2.0, 1)] + [(f"<0x{i:02X}>", -9.0, pieces.BYTE) for i in range(256)], pieces.UNIGRAM, True)
    made = pieces.build(model)
    assert made.encode("abc", add_special_tokens=False).ids == [2, 3]
    assert made.encode("é", add_special_tokens=False).ids == [1, 4 + 0xC3, 4 + 0xA9]
