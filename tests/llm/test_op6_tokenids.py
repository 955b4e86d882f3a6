"""Token files: Elias-Fano round trips, ids beside the library, reading back."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowloom.llm import op6_tokenids as op
from flowloom.llm import wordbpe
from flowloom.llm.eliasfano import EliasFano, encode
from flowloom.llm.wordtable import text_runs

MODEL = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(-5, 2**40), max_size=300), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, shift):
    values = np.sort(np.array(values, dtype=np.int64) >> (10 * shift))
    coded = EliasFano(encode(values))
    assert (coded.values() == values).all() and len(coded) == len(values)
    for i in range(0, len(values), 7):
        assert coded.select(i) == values[i]
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    ends = np.cumsum(rng.integers(1, 2000, 100_000))
    assert len(encode(ends)) < 2 * 100_000 and (EliasFano(encode(ends)).values() == ends).all()


def texts(n: int = 150):
    rng = random.Random(1)
    parts = ["The", "don't", "we'll", "ÉTÉ", "été", "ΣΑΣ", "İ", "中文", "🙂🙂", "a1b2", "½²", "\x1c", " ", " ", "\x85", "\xa0", "\u2003", "\u3000", "\x0b", "<|endoftext|>", "<|startoftext|", "...", "$$$", "ß", "ǅ", "ſ", "x̣́", "\n", "\t"]
    chars = [chr(c) for c in range(1, 0x260)] + ["\u0301", "\u0338", "'s", "'LL", "中"]
    narrow = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 12))) for _ in range(4 * n)]
    return [None, "", " ", "a", "word " * 3000, "z" * 20_000, *narrow] + ["".join(rng.choice(["", " "]) + rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 400, 1 << 20])
@pytest.mark.parametrize("cached", [5, 400_000])
def test_words_encode_like_the_library(size, cached, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(wordbpe, "MAX_CACHED", cached)
    library, own = Tokenizer.from_file(MODEL), wordbpe.WordEncoder(MODEL)
    rows, at = texts(1500), 0
    for _, buf, offsets in text_runs(pa.array(rows), size):
        ids, sizes = own.encode(buf, offsets)
        assert len(sizes) == len(offsets) - 1 and sizes.sum() == len(ids)
        for got in np.split(ids, np.cumsum(sizes)[:-1]):
            want = library.encode(rows[at] or "", add_special_tokens=False).ids
            assert got.tolist() == want, rows[at]
            at += 1
    assert at == len(rows)


def test_files_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL)
    rows = list(enumerate(texts())) + [(3, "again"), (3, "again"), (-7, "negative"), (None, "null key"), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    manifest = op.write_ids(docs, f"file://{tmp_path}/ids", MODEL)
    got = op.read_digest(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    want = {}
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [op.END_ID]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    shard = op.Shard.open(manifest.orderBy("shard").first().path)
    assert [len(shard.document(i)) for i in range(len(shard.ends) - 1)] == [len(ids) for _, _, ids in shard.documents()]
    assert [shard.key(i) for i in range(3)] == [k for k, _, _ in list(shard.documents())[:3]]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.read_digest(spark, op.write_ids(docs, f"{tmp_path}/none", MODEL)).count() == 0
