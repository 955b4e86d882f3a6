"""Quality rules by repetition coverage.

Word runs of several lengths are hashed by rolling in numpy; a text fails when too
many of its characters lie inside runs or lines it holds more than once.

Defined results: a null or empty text has no words and fails the base rule; rows
with one doc_id are judged one by one; ties do not arise; extra columns are kept by
``quality_filter`` and ignored by ``quality_rules``. Very long texts are walked in
slices (see ``wordtable``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowloom.llm.arrow import column_at, map_batches
from flowloom.llm.wordtable import SPACE, Group, groups, window_hashes

#: Share of characters that may lie inside repeated runs of n words: the longer the run, the lower. These
#: are the published limits of 0.15, 0.12 and 0.10 for the repeats alone (Rae et al. 2021, table A1), doubled,
#: because the first of two equal runs counts here too.
MAX_COVERAGE = {5: 0.30, 8: 0.24, 10: 0.20}
#: Share of characters that may lie in lines that stood before (same source; the first line does not count).
MAX_LINE_COVERAGE = 0.20
#: Symbols per word.
MAX_SYMBOLS = 0.3
MIN_WORDS = 20
BASE_RUN = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_RESULT = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "line_coverage": "double", **{f"coverage_{n}": "double" for n in MAX_COVERAGE},
}


def repeated(group: Group, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each run length: which words lie inside a run its own text holds twice or more."""
    doc = group.doc_of_word()
    total, out = len(doc), {}
    for n, runs in window_hashes(group.hashes, lengths).items():
        whole = np.flatnonzero(doc[: len(runs)] == doc[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
        # the text is part of the key, so one sort finds repeats of all texts
        key = runs[whole] ^ (doc[whole].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(order), dtype=bool)
        hit[1:] |= same
        hit[:-1] |= same
        at = whole[order[hit]]
        opens, closes = np.bincount(at, minlength=total + 1), np.bincount(at + n, minlength=total + 1)
        out[n] = np.cumsum(opens - closes)[:total] > 0
    return out


def _lines(text: bytes) -> tuple[int, int, int]:
    """Repeated lines with a word, their characters, and the characters of all lines with a word."""
    count = dup = size = 0
    seen = set()
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        chars = len(line) if line.isascii() else len(line.decode())
        size += chars
        if line in seen:
            count += 1
            dup += chars
        else:
            seen.add(line)
    return count, dup, size


def _measure(column: pa.Array, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    rows: dict[str, list[np.ndarray]] = {}

    def put(name: str, values: np.ndarray) -> None:
        rows.setdefault(name, []).append(values)

    for g in groups(column, SPACE):
        cut = g.bounds[:-1]
        chars, symbols = np.zeros(g.size, np.int64), np.zeros(g.size, np.int64)
        lines = np.zeros((g.size, 3), np.int64)
        for k in range(g.size):
            part = g.buf[g.offsets[k] : g.offsets[k + 1]]
            if len(part):
                chars[k] = np.count_nonzero(((part & 0xC0) != 0x80) & ~SPACE[part])
                symbols[k] = np.count_nonzero(_SYMBOL[part])
                lines[k] = _lines(part.tobytes())
        n_words = np.diff(g.bounds)
        before = np.concatenate([[0], np.cumsum((g.buf & 0xC0) != 0x80)])
        length = before[g.ends] - before[g.starts]  # characters of each word
        size = np.concatenate([[0], np.cumsum(length)])
        total = np.maximum(size[g.bounds[1:]] - size[cut], 1)
        put("n_words", n_words)
        put("word_chars", chars)
        put("n_symbols", symbols)
        put("n_dup_lines", lines[:, 0])
        put("line_coverage", lines[:, 1] / np.maximum(lines[:, 2], 1))
        for n, inside in repeated(g, lengths).items():
            if n == BASE_RUN:
                words = np.concatenate([[0], np.cumsum(inside)])
                put("n_repeat_words", words[g.bounds[1:]] - words[cut])
            covered = np.concatenate([[0], np.cumsum(np.where(inside, length, 0))])
            put(f"coverage_{n}", (covered[g.bounds[1:]] - covered[cut]) / total)
    return {k: np.concatenate(v) for k, v in rows.items()}


def _judge(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words = m["n_words"]
    base = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * words)
    kept = ~base & (m["line_coverage"] <= MAX_LINE_COVERAGE) & (m["n_symbols"] <= MAX_SYMBOLS * words)
    for n, most in MAX_COVERAGE.items():
        kept &= m[f"coverage_{n}"] <= most
    return m | {"base_failed": base, "kept": kept}


def _batches(batches: Iterator[pa.RecordBatch], text: tuple[str, ...], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    lengths = tuple(sorted({*MAX_COVERAGE, BASE_RUN}))
    for batch in batches:
        if batch.num_rows:
            got = _judge(_measure(column_at(batch, text), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(got[c]) for c in _RESULT], schema=schema)


def _apply(docs: DataFrame, text: tuple[str, ...], columns: list[str]) -> DataFrame:
    out = StructType([docs.schema[c] for c in columns])
    for name, kind in _RESULT.items():
        out = out.add(name, kind)
    return map_batches(docs.select(*dict.fromkeys([*columns, text[0]])), _batches, out, text, columns)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, the counts and the verdict."""
    return _apply(docs, (text,), [key])


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with their columns as they were."""
    return _apply(docs.select(F.struct("*").alias("_row")), ("_row", text), ["_row"]).filter("kept").select("_row.*")
