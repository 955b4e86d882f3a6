"""Language identification by words first, with a backoff to shorter and shorter n-grams.

A known word adds its log frequency in each language. An unseen word is walked
character by character: each position takes the longest known n-gram that starts
there (five characters down to one, the word's ends marked) and adds its log frequency
in each language. The language of the largest sum wins.

The model is fitted on about ``max_docs`` labelled rows and keeps ``max_words`` words
and ``max_grams`` n-grams, so it has a fixed size. Predicting covers whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the first language by name;
repeated rows are judged alike; a null key is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from flowloom.llm.arrow import column_at, map_batches
from flowloom.llm.sample import crc_fold, hash_share
from flowloom.llm.stored import stored
from flowloom.llm.wordtable import PUNCT, Group, HashRows, byte_class, groups, span_hashes

MAX_DOCS = 20_000
MAX_WORDS = 200_000
MAX_GRAMS = 200_000
LONGEST = 5
UNKNOWN = "und"

_DIGIT = byte_class((0x30, 0x39))
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))


def _grams(group: Group, chosen: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """``(word of each character, [(n, first characters, hashes)])`` of the chosen words.

    The words are copied out between two spaces, so an n-gram at an end differs.
    """
    size = group.ends[chosen] - group.starts[chosen] + 2
    stop = np.cumsum(size)
    first = stop - size
    buf = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    inner = np.repeat(group.starts[chosen] - first - 1, size) + np.arange(len(buf))
    edge = np.zeros(len(buf), dtype=bool)
    edge[first] = edge[stop - 1] = True
    buf[~edge] = group.buf[inner[~edge]]
    char = np.flatnonzero((buf & 0xC0) != 0x80)
    word = np.searchsorted(stop, char, side="right")
    ends = np.append(char, len(buf))
    grams = []
    for n in range(1, LONGEST + 1):
        if len(char) >= n:
            whole = np.flatnonzero(word[: len(char) - n + 1] == word[n - 1 :])
            grams.append((n, whole, span_hashes(buf, char[whole], ends[whole + n])))
    return word, grams


def _spoken(group: Group) -> np.ndarray:
    """Words that do not begin with a digit."""
    return np.flatnonzero(~_DIGIT[group.buf[group.starts]])


def _count_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, code = langs.dictionary, np.asarray(langs.indices)
        for g in groups(batch.column("text"), PUNCT, fold=True):
            use = _spoken(g)
            lang = code[g.first : g.first + g.size][g.doc_of_word()[use]]
            for which in range(len(names)):
                mine = use[lang == which]
                _, grams = _grams(g, mine)
                for kind, hashes in [(0, g.hashes[mine]), *((n, h) for n, _, h in grams)]:
                    value, count = np.unique(hashes, return_counts=True)
                    k = len(value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int32)), pa.array(value.view(np.int64)), names.take(pa.array(np.full(k, which))), pa.array(count)], schema=schema)


@dataclass
class Model:
    """Log frequencies per language of known words and n-grams."""

    langs: list[str]
    words: HashRows
    word_logs: np.ndarray
    grams: list[HashRows]
    gram_logs: list[np.ndarray]
    prior: np.ndarray


def _logs(hashes: np.ndarray, lang: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, row = np.unique(hashes, return_inverse=True)
    table = np.zeros((len(keys), len(total)))
    np.add.at(table, (row, lang), count)
    return keys, np.log((table + 0.1) / (total + 0.1 * (len(keys) + 1))).astype(np.float32)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS) -> Model | None:
    """The model of all languages in ``labelled``; None without labelled rows."""
    rows = hash_share(labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), "key", max_docs)
    counted = map_batches(rows.select("text", "lang"), _count_batches, StructType().add("kind", "integer").add("hash", "long").add("lang", "string").add("n", "long")).groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    ranked = counted.groupBy("kind", "hash").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    ranked = stored(ranked.filter("all >= 2"), "grams")  # six selections read it
    limits = {0: MAX_WORDS} | {n: MAX_GRAMS // LONGEST for n in range(1, LONGEST + 1)}
    best = [ranked.filter(F.col("kind") == k).orderBy(F.desc("all"), "hash").limit(most) for k, most in limits.items()]
    table = best[0]
    for other in best[1:]:
        table = table.union(other)
    got = table.select("kind", "hash", F.explode("by").alias("x")).select("kind", "hash", "x.lang", "x.n").toArrow()
    if not got.num_rows:
        return None
    kind, hashes = got["kind"].to_numpy(), got["hash"].to_numpy().view(np.uint64)
    names, count = got["lang"].to_pylist(), got["n"].to_numpy()
    langs = sorted(set(names))
    place = {name: k for k, name in enumerate(langs)}
    code = np.array([place[x] for x in names])
    tables = []
    for k in range(LONGEST + 1):
        own = kind == k
        total = np.bincount(code[own], weights=count[own], minlength=len(langs))
        keys, logs = _logs(hashes[own], code[own], count[own], total)
        tables.append((HashRows(keys), logs, total))
    prior = tables[0][2] + 1
    return Model(langs, tables[0][0], tables[0][1], [t[0] for t in tables[1:]], [t[1] for t in tables[1:]], np.log(prior / prior.sum()))


def _scores(model: Model, g: Group) -> tuple[np.ndarray, np.ndarray]:
    """``(sums per text and language, evidence per text)``."""
    use, doc = _spoken(g), g.doc_of_word()
    row = model.words.find(g.hashes[use])
    known = row >= 0
    parts = [(doc[use[known]], model.word_logs[row[known]])]
    new = use[~known]
    if len(new):
        word, grams = _grams(g, new)
        free = np.ones(len(word), dtype=bool)
        for n, whole, hashes in reversed(grams):
            at = np.flatnonzero(free[whole])
            row = model.grams[n - 1].find(hashes[at])
            hit = row >= 0
            start = whole[at[hit]]
            free[start] = False
            parts.append((doc[new[word[start]]], model.gram_logs[n - 1][row[hit]]))
    owner, logs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    sums = np.stack([np.bincount(owner, weights=logs[:, k], minlength=g.size) for k in range(len(model.langs))], axis=1)
    return sums, np.bincount(owner, minlength=g.size)


def _has_letter(text: np.ndarray) -> bool:
    return bool(_LETTER[text].any()) or any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def _predict_batches(batches: Iterator[pa.RecordBatch], model: Model | None, columns: list[str], text: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for g in groups(column_at(batch, text), PUNCT, fold=True):
            part = batch.slice(g.first, g.size)
            names, score = [UNKNOWN] * g.size, np.zeros(g.size)
            if model is not None:
                sums, seen = _scores(model, g)
                sums = (sums + model.prior) / np.sqrt(np.maximum(seen, 1))[:, None]
                share = np.exp(sums - sums.max(axis=1, keepdims=True))
                best = share.argmax(axis=1)
                top = share.max(axis=1) / share.sum(axis=1)
                for k in range(g.size):
                    if _has_letter(g.buf[g.offsets[k] : g.offsets[k + 1]]):
                        names[k], score[k] = model.langs[best[k]], top[k]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(names, pa.string()), pa.array(score)], schema=schema)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: dict[str, Column] | None = None, inside: str | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` for each row, beside the columns in ``keep``.

    ``inside`` names the struct of ``keep`` that already holds the text.
    """
    keep = keep or {}
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], *([F.col(text).alias("_text")] if inside is None else []))
    out = StructType([*(rows.schema[n] for n in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(rows, _predict_shared, out, shared, list(keep), ("_text",) if inside is None else (inside, text))


def _predict_shared(batches: Iterator[pa.RecordBatch], shared, columns: list[str], text: tuple[str, ...], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return _predict_batches(batches, shared.value, columns, text, schema)


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.filter(F.coalesce(crc_fold(F.col(key), 3) != 1, F.lit(True)))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, held_out, lang_pred, score`` with the model of the rows not held out."""
    model = fit(training_rows(docs, key), key)
    held = F.coalesce(crc_fold(F.col(key), 3) == 1, F.lit(False))
    return predict(docs, model, keep={key: F.col(key), "held_out": held}).select(key, "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose language could be told, with their columns as they were."""
    model = fit(training_rows(docs, key), key)
    return predict(docs, model, keep={"_row": F.struct("*")}, inside="_row").filter(F.col("lang_pred") != UNKNOWN).select("_row.*")
