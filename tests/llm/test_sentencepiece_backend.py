import struct

import numpy as np
import public_tokenizers
import pytest

from rankloom.llm.sentencepiece_backend import IS_BPE, IS_UNIGRAM, MARK, PieceCodec, encode_documents, parse, wire_fields

from .helpers import CLASH, LONG, ODD, docs, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "a", " a", "a ", "  a  b ", "x\n y\t", "é😀 ü", "naïve 12 34", "\x00\x7f", "aaaa aaa aa", prose(1, 50), LONG[:5_000], "ab ba abab", "b" * 50]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def tiny_model(kind, pieces, squeeze, fallback=True):
    """A hand-made model file; nothing is trained."""
    full = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []) + [(p, s, 1) for p, s in pieces]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, t)) for p, s, t in full)
    trainer = field(3, kind) + field(35, int(fallback))
    return body + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


PIECES = [(MARK, -3.0), ("a", -3.1), ("b", -3.2), ("ab", -2.0), (MARK + "a", -1.5), (MARK + "ab", -1.0), ("aa", -2.5), ("bb", -2.6), ("aba", -2.2), (MARK + MARK, -2.8)]


def test_public_model_has_parity_and_round_trip():
    codec = PieceCodec(PATH)
    assert codec.by_word and codec.model.kind == IS_BPE and len(codec.model.pieces) == 32_000
    ids = codec.encode(TEXTS)
    assert codec.parity(TEXTS, ids) == [True] * len(TEXTS)
    assert codec.decode(ids) == TEXTS
    assert [x.tolist() for x in codec.encode(TEXTS)] == [x.tolist() for x in ids]  # the second time from the cache


@pytest.mark.parametrize("kind", [IS_UNIGRAM, IS_BPE])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("extra", [[], [("b" + MARK + "a", -0.5)]])
def test_hand_made_models_have_parity(kind, squeeze, extra):
    codec = PieceCodec(data=tiny_model(kind, PIECES + extra, squeeze))
    assert codec.by_word == (not extra)
    texts = ["", "ab", "ab ab  aab", " a", "b a", "zé ab", "aaa bbb aba", "a b " * 20]
    assert codec.parity(texts, codec.encode(texts)) == [True] * len(texts)


def test_decoder_searches_no_pattern_in_pieces():
    """Any ids, not only those of texts, decode as with a pattern for the marker."""
    import json

    from tokenizers import decoders

    codec = PieceCodec(PATH)
    steps = json.loads(codec.tokenizer.to_str())["decoder"]["decoders"]
    assert "Replace" not in {s["type"] for s in steps}
    draws = np.random.default_rng(3)
    ids = [draws.integers(0, high, size) for high in (300, 32_000) for size in (0, 1, 2, 50) for _ in range(20)]
    found = codec.decode(ids)
    assert codec.decode([x.tolist() for x in ids]) == found
    codec.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    assert codec.decode(ids) == found


def test_parser_reads_the_wire_format():
    model = parse(tiny_model(IS_UNIGRAM, PIECES, True))
    assert model.pieces[259:262] == [(MARK, -3.0, 1), ("a", pytest.approx(-3.1), 1), ("b", pytest.approx(-3.2), 1)]
    assert model.byte_fallback and model.squeeze and model.dummy_prefix and model.kind == IS_UNIGRAM
    assert list(wire_fields(field(5, 300) + field(6, b"xy"))) == [(5, 300), (6, b"xy")]
    with pytest.raises(ValueError):
        list(wire_fields(varint(1 << 3 | 3)))
    with pytest.raises(ValueError):
        parse(tiny_model(3, PIECES, True))


def test_documents(spark):
    frame = docs(spark, ODD + [LONG], **CLASH).repartition(2)
    rows = {r.doc_id: r for r in encode_documents(frame, PATH).collect()}
    assert len(rows) == len(ODD) + 1 and all(r.parity and r.round_trip for r in rows.values())
    for i, text in enumerate(ODD + [LONG]):
        assert rows[i].decoded == (text or "")
        assert rows[i].n_tokens == len(np.frombuffer(rows[i].ids, "<u4"))
    assert rows[0].n_tokens == rows[1].n_tokens == 0 and rows[5].ids == rows[6].ids
    assert encode_documents(docs(spark, []), PATH).collect() == []
    lean = encode_documents(frame, PATH, verify=False, keep_decoded=False).first()
    assert lean.parity is None and lean.decoded is None
