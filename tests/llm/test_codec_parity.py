"""The rebuilt tokenizer against the sentencepiece library: a unigram model with a character map, and what parity catches."""

import os
import struct

import pytest

from flowseries.llm import sentencepiece_codec as codec

needs_model = pytest.mark.skipif(not os.path.isfile(codec.MODEL), reason="no model file")


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_file(bytes_too):
    """A model put together by hand: pieces with scores, and the library's own map of compatible characters."""
    import sentencepiece

    own = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for n, v in codec._fields(own.serialized_model_proto()) if n == 3)
    charsmap = dict(codec._fields(spec))[2]
    words = ["▁", "▁the", "▁a", "▁fox", "▁fo", "x", "es", "ing", "▁jump", "▁jumping", "fi", "é", "1", "12", "▁カ", "カ", "ァ", "ab", "abc", "bc", "▁ab"]
    normal = words + sorted({c for w in words for c in w} | set("abcdefghijklmnopqrstuvwxyz.,!-ñü") - set(words))
    normal = list(dict.fromkeys(normal))
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, codec.BYTE) for b in range(256)] if bytes_too else []
    pieces += [(w, -2.0 - 0.37 * ((i * 7) % 23) - (4 if len(w) == 1 else 0), codec.NORMAL) for i, w in enumerate(normal)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    return out + field(2, field(3, codec.UNIGRAM) + field(35, int(bytes_too))) + field(3, field(1, b"nmt_nfkc") + field(2, charsmap))


TEXTS = ["the fox jumping", "  the   foxes ", "ﬁ ① ｶｧ ２ é é", "abcabc ab abc", "", " ", "ﬃ\tx\n\ny", "the​fox a", "ＡＢＣ ab", "12 121212", "ñandú über, the-end!", "a" * 500]


@pytest.mark.parametrize("bytes_too", [False, True])
def test_unigram_with_a_character_map(bytes_too):
    import sentencepiece

    data = unigram_file(bytes_too)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = codec.Codec(data)
    assert own.model.charsmap and not own.by_word
    ids, same = own.encode(TEXTS)  # parity is checked within
    assert [x.tolist() for x in ids] == library.encode(TEXTS)
    if bytes_too:
        assert list(own.decode(x.tolist() for x in ids)) == library.decode(library.encode(TEXTS)) and all(same)


@needs_model
def test_parity_covers_every_word(monkeypatch):
    data = open(codec.MODEL, "rb").read()
    own = codec.Codec(data)
    texts = [f"word{i} and  more\n{i}" for i in range(40)]
    ids, same = own.encode(texts)
    assert all(same) and own.library_ids(texts) == [x.tolist() for x in ids]
    for wrong in ("word39", "39"):
        fresh = codec.Codec(data)
        good = fresh.library_ids
        monkeypatch.setattr(fresh, "library_ids", lambda t, good=good, w=wrong: [x[:-1] if w in s else x for s, x in zip(t, good(t), strict=True)])
        with pytest.raises(ValueError):
            fresh.encode(texts)


@needs_model
def test_decoding_is_of_ids():
    own = codec.Codec(open(codec.MODEL, "rb").read())
    ids = own.library_ids(["some text\n", "日本 😀"])
    assert list(own.decode(ids)) == ["some text\n", "日本 😀"]
    cut = [x[:-1] for x in ids]
    assert list(own.decode(cut)) == own.by_library(cut) and list(own.decode(cut))[1] != "日本 😀"
    own._words["▁text"] = own._words.get("▁text", b"") + b"\5\0\0\0"
    assert own.encode(["some text"])[1] == [False]


@needs_model
def test_older_words_are_looked_up_and_not_gone_through():
    class Older(dict):
        def keys(self):
            raise AssertionError("every older word is gone through")

        __iter__ = items = values = keys

    own = codec.Codec(open(codec.MODEL, "rb").read())
    own.encode(["one two three"])
    own._older, own._words = Older(own._words), {}
    assert [x.tolist() for x in own.encode(["four two  one"])[0]] == own.library_ids(["four two  one"])
    assert "▁two" in own._words and "▁three" not in own._words


@pytest.mark.parametrize("text", ["", " ", "a", "a b", " a b", "a  b", "a b ", "a▁b c", "▁", "a\nb c", "  "])
def test_words_are_those_of_the_pattern(text):
    assert codec._words(text) == (codec._WORD.findall(codec.MARKER + text.replace(" ", codec.MARKER)) if text else [])
