"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is read field by field; normaliser, white-space marker, byte
fallback and the unigram scores or, for a BPE model, the merges that its scores imply are
rebuilt as a ``tokenizers.Tokenizer``.  Texts go through it in multithreaded batches.

A text is encoded in parts that no piece of the vocabulary can join (each run of markers
starts one, where no piece has a marker after another character), so parts are encoded once
and kept.  Every part is compared with the sentencepiece library when it is met first, and what
it decodes to with the Tokenizer's decoder; a text with a part that differs is reported in
``parity``.  Parts are normalised already, so the library reads the model with its normaliser
switched off; where the model squeezes spaces or maps characters, whole texts are compared.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
are encoded each on their own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import table, text_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of one generation that a worker keeps; a full generation becomes the old one.
CACHE_PARTS = 320_000
MODEL = "piece_bpe_32k.model"
#: Appended to a model file, these bytes (a second normaliser spec, which protobuf merges into the
#: first) take away its character map, dummy prefix and squeezing of spaces.
AS_IS = bytes([0x1A, 6, 0x12, 0, 0x18, 0, 0x20, 0])


#: Texts on which the short way to normalise is compared with the normaliser before it is used.
PROBES = ("", " ", "a", " a", "a  b ", "é\u0301 ﬁ\t\n", MARK + "x " + MARK, "İ 中文 \U0001f600")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _unpacked(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints, 32- and 64-bit words, byte strings."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            shift += 7
            i += 1
            if not data[i - 1] & 0x80:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    """The parts of a sentencepiece ModelProto that encoding needs."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.squeeze = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges that a BPE model's scores imply: a pair may join where its join is a piece,
    higher scores first."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        found += [((-model.pieces[i][1], i, ids[a], ids[b]), (a, b)) for a, b in splits]
    return [pair for _, pair in sorted(found)]


def normaliser(model: Model):
    """What the model does to a text before pieces: character map, spaces, prefix, marker."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def build(model: Model):
    """The model as a Tokenizer, with its normaliser and decoder."""
    from tokenizers import AddedToken, Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges_of(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("word and char models are not supported")
    made = Tokenizer(core)
    made.normalizer = normaliser(model)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    if user := [p for p, _, kind in model.pieces if kind == USER]:
        made.add_tokens([AddedToken(p, normalized=False) for p in user])
    return made


class PieceCodec:
    def __init__(self, path: str, check: bool = True, threads: int = 2, cache_parts: int = CACHE_PARTS):
        from tokenizers import normalizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            data = f.read()
        self.model = parse(data)
        self.normaliser, self.short = normaliser(self.model), False
        self.tokenizer = build(self.model)
        self.tokenizer.normalizer = normalizers.Sequence([])  # parts are normalised already
        # a model with neither character map nor squeezing only gets its prefix and markers
        self.short = not self.model.charsmap and not self.model.squeeze and all(self.normalise(x) == self._short(x) for x in PROBES)
        self.reference, self.whole = None, bool(self.model.squeeze or self.model.charsmap)
        if check:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data if self.whole else data + AS_IS)
        self.cache_parts, self.ids, self.old, self.inner = cache_parts, {}, {}, {}
        self.differ, self.undecoded = set(), set()
        texts = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER)]
        self.apart = not any(MARK in p.lstrip(MARK) for p in texts)
        # characters that no piece joins with another character
        self.single = {c for c in "\n" if not any(c in p and set(p) != {c} for p in texts)}
        # characters that no piece has after a letter
        self.closing = {c for c in ".,;:!?" if not any(a.isalpha() and b == c for p in texts for a, b in zip(p, p[1:], strict=False))}
        self.surface = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.byte_ids = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == BYTE}

    def _short(self, text: str) -> str:
        if self.model.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.model.escape else text

    def normalise(self, text: str) -> str:
        return self._short(text) if self.short else self.normaliser.normalize_str(text)

    def parts(self, text: str) -> list[str]:
        if not self.apart:
            return [text] if text else []
        if MARK + MARK in text:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        first, *rest = text.split(MARK)
        return ([first] if first else []) + [MARK + x for x in rest]

    def _plain(self, part: str) -> list[str]:
        """A part as smaller ones that no piece joins."""
        if "\n" not in part:
            return [part[:-1], part[-1]] if len(part) > 1 and part[-1] in self.closing and part[-2].isalpha() else [part]
        out = []
        for x in re.split("(\n)", part) if "\n" in self.single else [part]:
            if len(x) > 1 and x[-1] in self.closing and x[-2].isalpha():
                out += [x[:-1], x[-1]]
            elif x:
                out.append(x)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Encodes parts not met before and compares each, encoded and decoded, with the libraries."""
        for part in self.old.keys() & missing:
            self.ids[part] = self.old[part]
        plain = {part: self._plain(part) for part in missing if part not in self.ids}
        if len(self.inner) > self.cache_parts:
            self.inner = {}
        inner = self.inner
        fresh = list({x for xs in plain.values() for x in xs if x not in inner})
        for x, found in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            inner[x] = _packed(found.ids)
        for part, xs in plain.items():
            self.ids[part] = inner[xs[0]] if len(xs) == 1 else b"".join(map(inner.__getitem__, xs))
        new = list(plain)
        lists = [_unpacked(self.ids[x]) for x in new]
        if self.reference is not None and not self.whole:
            self.differ |= {x for x, ids, expected in zip(new, lists, self.reference.encode(new, num_threads=1), strict=True) if ids != expected}
        decoded = self.tokenizer.decode_batch(lists, skip_special_tokens=False)
        self.undecoded |= {x for x, ids, text in zip(new, lists, decoded, strict=True) if text != self._surfaces(ids)}

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids as little-endian unsigned 32-bit bytes, and whether the text had parity."""
        split = [self.parts(self.normalise(x)) for x in texts]
        if len(self.ids) > self.cache_parts:
            self.ids, self.old = {}, self.ids
        if missing := set(chain.from_iterable(split)).difference(self.ids):
            self._learn(missing)
        known = self.ids
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        bad = self.differ | self.undecoded
        fine = [not bad or bad.isdisjoint(parts) for parts in split]
        if self.reference is not None and self.whole:
            fine = [ok and ids == _packed(x) for ok, ids, x in zip(fine, out, self.reference.encode(texts, num_threads=1), strict=True)]
        return out, fine

    def _surfaces(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: bytes) -> str:
        """The text of ids; a dummy prefix is taken away, invalid UTF-8 becomes U+FFFD.  What each
        part decodes to was compared with the library's decoder when the part was met first."""
        text = self._surfaces(np.frombuffer(ids, "<u4").tolist())
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=1)
def codec_of(path: str) -> PieceCodec:
    """The worker's codec: its parts stay known from task to task."""
    return PieceCodec(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_codes(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded, parity) per row: decoded says that
    decoding the ids gives the normalised text back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        bytes_at = np.zeros(len(codec.surface), bool)
        bytes_at[sorted(codec.byte_ids)] = True
        for rows in batches:
            texts = [x or "" for x in rows["text"]]
            ids, parity = codec.encode(texts)
            plain = codec.model.squeeze or codec.model.charsmap
            yield pd.DataFrame(
                {
                    "doc_id": rows["doc_id"].astype("Int64"),
                    "n_tokens": [len(x) // 4 for x in ids],
                    "n_byte_tokens": [int(bytes_at[np.frombuffer(x, "<u4")].sum()) for x in ids],
                    "ids_crc32": [zlib.crc32(x) for x in ids],
                    "decoded": [codec.decode(x) == (codec.normalise(t).replace(MARK, " ") if plain else t.replace(MARK, " ")) for x, t in zip(ids, texts, strict=True)],
                    "parity": parity,
                }
            )

    text_batches(docs.sparkSession)
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return only.mapInPandas(run, "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded boolean, parity boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
