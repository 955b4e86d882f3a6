"""Piece encoding beside the library's own unigram search, and exact round trips."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from flowloom.llm import op3_pieces as op

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return op.PieceCodec(MODEL)


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    """The same pieces as a unigram model with the scores that the search uses."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

    pieces, proto = op.Pieces(MODEL), ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = TrainerSpec.UNIGRAM
    for p in proto.pieces:
        hit = pieces.scores.get(p.piece.replace(op.MARK, " "))
        if hit is not None:
            p.score = hit[1]
        elif p.type == ModelProto.SentencePiece.NORMAL:
            p.type = ModelProto.SentencePiece.UNUSED
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return SentencePieceProcessor(model_file=str(path))


def texts():
    rng = random.Random(9)
    words = "the of and token encoding Schiff élève über año 12345 <s> ▁ 🙂 中文 a b\tc d\ne".split(" ")
    out = ["", " ", "  ", "\n\n", "a", " leading", "trailing ", "x" * 500, "ab" * 4000, "=" * 300, "\x00\x01"]
    for n in (3, 20, 300):
        out += [rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(n)) for _ in range(20)]
    out += ["".join(rng.choice("abcdeth éñ\n,.-") for _ in range(200)) for _ in range(20)]
    return out


def cost(pieces, ids):
    """Log probability of a segmentation; byte runs count as unknown characters."""
    by_id = dict(pieces.scores.values())
    total, raw = 0.0, b""
    for i in [*ids, None]:
        if i in by_id or i is None:
            total += pieces.unknown * len(raw.decode())
            raw = b""
            total += by_id.get(i, 0.0)
        else:
            raw += pieces.bytes_of[i]
    return total


def test_as_likely_as_the_library_and_round_trip(codec, library):
    for text in texts():
        ids = codec.encode(text)
        plain = text.replace(op.MARK, " ")
        assert codec.decode(ids) == plain
        want = library.encode(plain)
        assert cost(codec.pieces, ids.tolist()) == pytest.approx(cost(codec.pieces, want), rel=1e-5, abs=1e-3), text[:80]


def whole_word(p, word):
    """A plain search over one word, whose ends are both boundaries."""
    n = len(word)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        for k in range(i + 1, min(n, i + p.longest) + 1):
            found, worth = p.scores.get(word[i:k], (-1, p.unknown if k == i + 1 else -math.inf))
            if best[i] + worth > best[k]:
                best[k], back[k] = best[i] + worth, (i, found)
    out = []
    while n:
        i, found = back[n]
        out = ([found] if found >= 0 else [p.byte_ids[b] for b in word[i:n].encode()]) + out
        n = i
    return out


def test_every_id_of_a_text_is_committed_by_the_stream(monkeypatch):
    codec, ends, plain = op.PieceCodec(MODEL), [], op.StreamingViterbi._commit

    def commit(self, end):
        out = plain(self, end)
        ends.append((end, len(out)))
        return out

    monkeypatch.setattr(op.StreamingViterbi, "_commit", commit)
    text = "the token, encoding of 12345 Schifffahrtsgesellschaften élève\nüber 中文 (a, b)"
    words = codec.pieces.words.findall(" " + text)
    got = codec.encode(text).tolist()
    assert got == [i for w in words for i in whole_word(codec.pieces, w)]
    assert len(set(words)) == len(words) and sum(n for _, n in ends) == len(got)
    assert len(ends) > len(words)  # some words are committed in parts
    assert codec.encode(text).tolist() == got


def test_words_equal_a_plain_search(codec):
    rng = random.Random(4)
    for n in [*range(1, 40), 70, 150]:
        for letters in ("etaoinshr", "ab=-.,", "é中🙂x", "0123456789"):
            word = " " + "".join(rng.choice(letters) for _ in range(n))
            ids = codec.encode(word[1:]).tolist()
            want = whole_word(codec.pieces, word)
            assert ids == want or cost(codec.pieces, ids) == pytest.approx(cost(codec.pieces, want), abs=1e-9)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_stream_commits_early_and_equals_whole(codec, size):
    text = " " + " ".join(t for t in texts() if t and len(t) < 2000)
    whole = op.StreamingViterbi(codec.pieces)
    want = whole.feed(text) + whole.finish()
    stream, got, held = op.StreamingViterbi(codec.pieces), [], 0
    for at in range(0, len(text), size):
        got += stream.feed(text[at : at + size])
        held = max(held, len(stream.text) - size)
    assert got + stream.finish() == want
    assert held < 1000
    assert cost(codec.pieces, want) == pytest.approx(cost(codec.pieces, codec.encode(text[1:]).tolist()))


def test_rows(spark):
    rows = [(1, None), (1, "one"), (1, "one"), (2, ""), (None, "null key"), (3, "z" * 300_000)]
    docs = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, ids string").repartition(2)
    got = op.encode(docs, MODEL)
    back = {(r.doc_id, r.text) for r in op.decode(got, MODEL).collect()}
    assert back == set(rows)
    for r in got.collect():
        assert r.n_tokens == len(r.ids or []) and (r.ids is None or r.round_trip)
        assert r.ids is None or r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert op.encode(docs.limit(0), MODEL).count() == 0


def test_words_of_the_cache_are_bounded_and_round_trips_told(monkeypatch):
    monkeypatch.setattr(op, "MAX_CACHED", 50)
    codec = op.PieceCodec(MODEL)
    for n in range(5):
        text = " ".join(f"w{k}x{n}" for k in range(40)) + " the of"
        got = codec.encode(text)
        whole = op.StreamingViterbi(op.Pieces(MODEL)).encode((" " if codec.pieces.prefix else "") + text)
        assert got.tolist() == whole and codec.round_trip(text, got)
        assert len(codec.cache) <= 50 and len(codec.cache.old) <= 50
    assert " the" in codec.cache or " the" in codec.cache.old
    [the] = [i for p, (i, _) in codec.pieces.scores.items() if p == "the"]
    codec.pieces.bytes_of[the] = b"xxx"
    assert [codec.round_trip(t, codec.encode(t)) for t in ("see\nthe", "over night", "")] == [False, True, True]
