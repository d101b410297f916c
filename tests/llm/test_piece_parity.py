"""parity tells of ids that the sentencepiece library would not give."""

from types import SimpleNamespace

from plinth.llm import pieces


def test_wrong_ids_of_the_production_model_are_reported():
    codec = pieces.PieceCodec(pieces.model_path())
    assert codec.model.dummy_prefix
    texts = ["plain words, and more", "only others", "", " ,x\n"]
    assert codec.encode(texts)[1] == [True] * 4
    right = codec.tokenizer

    class Wrong:
        decode_batch = right.decode_batch

        def encode_batch_fast(self, xs, **options):
            return [SimpleNamespace(ids=e.ids[::-1] + [5] * ("new" in x)) for x, e in zip(xs, right.encode_batch_fast(xs, **options), strict=True)]

    codec.tokenizer = Wrong()
    assert codec.encode(["plain words, and news", "only others", "news", "others"])[1] == [False, True, False, True]
    assert codec.encode(["news, again plain", "plain"])[1] == [False, True]


def test_word_encoder_equals_the_tokenizer_and_checks_its_short_way(tmp_path):
    """Greek capitals, marks, capitals met before and after; a tokenizer that keeps case is read whole."""
    import json

    import numpy as np
    from plinth.llm import packing, wordcache
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    texts = ["logos ΛΟΓΟΣ λογος λογοσ ΛΟΓΟΣ. Word word, WORD. Éclair éclair", "ΛΟΓΟΣ \x1c x\x1cy STRASSE straße ﬁn Kelvin K don't 12a", "", "Word,word"]
    with open(path, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"]["normalizers"] = [n for n in other["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    (tmp_path / "other.json").write_text(json.dumps(other), encoding="utf-8")
    for name, plain in ((path, True), (str(tmp_path / "other.json"), False)):
        encoder, whole = wordcache.WordEncoder(name, cache_parts=5), Tokenizer.from_file(name)
        assert encoder.plain is plain
        for _ in range(2):
            for text in texts:
                assert encoder.encode([text]) == [np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_rebuilt_tokenizer_and_decoder_equal_the_library_on_whole_texts(prose):
    """The Tokenizer with its own normaliser, texts as they are; a wrong decoder is reported."""
    import sentencepiece

    path = pieces.model_path()
    whole, library = pieces.build(pieces.parse(open(path, "rb").read())), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "a", "  a  b\n\nc ", "é\u0301 ﬁ İ 中文 \U0001f600 x\x00y", "7 7 ... ,, !!", prose(300, 4), prose(50, 5).upper()]
    assert [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)] == library.encode(texts)
    codec = pieces.PieceCodec(path)
    ids, parity = codec.encode(texts)
    assert codec.short and all(parity) and [codec.decode(x) for x in ids] == texts
    broken = pieces.PieceCodec(path)
    broken.surface[library.encode("word")[0]] = b"?"
    assert broken.encode(["a word", "another"])[1] == [False, True]


def test_words_with_closing_marks_are_not_read_whole():
    import numpy as np
    from plinth.llm import packing, wordcache
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    encoder, right = wordcache.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["Word!! éclair,### STRASSE*** wordy.%%% 12!! ... don't; x&&&&& Éclair.", "word!! \x1c!! 中文!! naïve?! Ǆ#"]
    expected = [np.array(right.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    seen = []

    class Counted:
        def encode(self, x, **options):
            seen.append(x)
            return right.encode(x, **options)

        def encode_batch_fast(self, xs, **options):
            seen.extend(xs)
            return right.encode_batch_fast(xs, **options)

    encoder.tokenizer = Counted()
    assert encoder.encode(texts) == expected
    assert {"12!!", "don't;", "中文!!"} <= set(seen) and not {"Word!!", "word!!", "éclair,###", "STRASSE***", "wordy.%%%", "naïve?!"} & set(seen)


def test_ids_of_the_library_are_compared_as_they_come(monkeypatch):
    codec, packed = pieces.PieceCodec(pieces.model_path()), pieces._packed
    calls = []
    monkeypatch.setattr(pieces, "_packed", lambda ids: calls.append(ids) or packed(ids))
    assert codec.encode(["one two three"])[1] == [True]
    assert len(calls) == len(codec.inner) == 3
