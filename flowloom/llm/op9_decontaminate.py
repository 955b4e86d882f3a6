"""Benchmark decontamination by a broadcast hash set, in DataFrame functions only.

Windows of ten normalised words of the benchmark (all words of a shorter item)
become 64-bit keys. A document's windows are hashed as whole arrays, put together
from runs of 1, 2, 4 and 8 words, and looked up in the key table; every hit is
verified word by word in the join condition. The key table is broadcast only
while its measured size is within ``broadcast_bytes``; beyond that single windows, each
with its own words only, are shuffled to it, so the rows grow with the words of a text.

Defined results: a null or empty text has no words and no hits, an item without
words has no windows; rows with one key are judged together only if their texts
are equal, and each keeps its own row; windows that several items share count
for all of them; an empty benchmark leaves everything clean; a very long text is one
array of words and one of keys, and one small row per window. Extra columns are
ignored by ``find_hits`` and kept by ``remove_hits``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.parsing import bind

WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: From this share of hit words on a document goes whole; below it the spans go.
DROP_SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MARK = 0


def normal_words(text: Column) -> Column:
    """Words of letters and digits (and all beyond ASCII), A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN, -1), "")


def _join(left: Column, right: Column, shift: int, n: Column) -> Column:
    size = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), size), F.slice(right, F.lit(shift + 1), size), lambda a, b: F.xxhash64(a, b))


def _run_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add arrays ``_w<n>`` of the hashes of all runs of n words, for each length."""
    df = df.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    step = 1
    while 2 * step <= max(lengths, default=1):
        df = df.withColumn(f"_w{2 * step}", _join(F.col(f"_w{step}"), F.col(f"_w{step}"), step, n - (2 * step - 1)))
        step *= 2
    for length in lengths:
        bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length & 1 << k]
        done = bits[0]
        acc = F.col(f"_w{done}")
        for bit in bits[1:]:
            acc = _join(acc, F.col(f"_w{bit}"), done, n - (done + bit - 1))
            done += bit
        if len(bits) > 1:
            df = df.withColumn(f"_w{length}", acc)
    return df


def window_table(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(item, len, words, key)`` of the distinct windows of all items."""
    items = bind(benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("_text")), _words=normal_words(F.col("_text"))).filter(F.size("_words") > 0)
    n = F.size("_words")
    length = F.least(n, F.lit(window))
    starts = F.sequence(F.lit(1), n - length + 1)
    runs = items.select("item", length.alias("len"), F.explode(F.transform(starts, lambda s: F.slice("_words", s, length))).alias("_words")).distinct()
    keyed = _run_hashes(runs, list(range(1, window + 1)))
    key = F.coalesce(*[F.when(F.col("len") == k, F.element_at(f"_w{k}", 1)) for k in range(1, window + 1)])
    return keyed.select("item", "len", F.array_join("_words", " ").alias("words"), key.alias("key"))


def _window_starts(lengths: list[int]) -> list[Column]:
    """Where the windows of each length begin in a document's array of keys, after its marker."""
    counts = [F.greatest(F.size("_words") - (k - 1), F.lit(0)) for k in lengths]
    return [reduce(lambda a, b: a + b, counts[:i], F.lit(1)) for i in range(len(lengths) + 1)]


def _hits_in_place(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits by a broadcast of the windows; a document's words stay where they are."""
    mark = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("item"), F.lit(0).alias("len"), F.lit("").alias("words"), F.lit(_MARK).cast("long").alias("key"))
    table = F.broadcast(windows.union(mark))
    keys = F.concat(F.array(F.lit(_MARK).cast("long")), *[F.col(f"_w{k}") for k in lengths])
    at = rows.select("_id", "text_hash", "_words", F.posexplode(keys).alias("_at", "key"))
    n = F.size("_words")
    place = F.coalesce(*[F.when(table["len"] == k, F.col("_at") - b) for k, b in zip(lengths, _window_starts(lengths))], F.lit(-1))
    real = (place >= 0) & (place <= n - table["len"]) & (F.array_join(F.slice("_words", place + 1, F.greatest(table["len"], F.lit(1))), " ") == table["words"])
    hit = at.join(table, (at["key"] == table["key"]) & F.when(F.col("_at") == 0, table["len"] == 0).when(place < 0, F.lit(False)).otherwise(real))
    return hit.select("_id", "text_hash", n.alias("n"), "item", F.when(F.col("len") > 0, F.struct(place.alias("pos"), F.col("len"))).alias("span"))


def _hits_by_shuffle(rows: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Hits by a shuffle of single windows: place, key and the words of the window, not those of the text.

    Markers have keys of their own, so they spread over all tasks; they have no words and meet no
    window, and the outer join keeps them.
    """
    keys = F.concat(F.array(F.xxhash64("_id", "text_hash")), *[F.col(f"_w{k}") for k in lengths])
    at = rows.select("_id", "text_hash", "_words", F.posexplode(keys).alias("_at", "key"))
    starts = _window_starts(lengths)
    inside = [F.when((F.col("_at") >= b) & (F.col("_at") < e), F.struct((F.col("_at") - b).alias("pos"), F.lit(k).alias("len"))) for k, b, e in zip(lengths, starts, starts[1:])]
    span = F.coalesce(*inside, F.lit(None).cast("struct<pos:int,len:int>"))
    at = at.select("_id", "text_hash", F.size("_words").alias("n"), "key", span.alias("span"), F.array_join(F.slice("_words", span["pos"] + 1, span["len"]), " ").alias("_run"))
    hit = at.join(windows, (at["key"] == windows["key"]) & (at["span.len"] == windows["len"]) & (at["_run"] == windows["words"]), "left")
    return hit.filter(F.col("span").isNull() | F.col("words").isNotNull()).select("_id", "text_hash", "n", "item", "span")


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(key, text_hash, n_rows, n_words, hits, items)`` per key and text.

    ``hits`` are the hit word positions from 0, ``items`` the sorted ids of the items
    with occurring windows. One marker per document passes the join, so the
    documents without hits come out of the same scan.
    """
    windows = window_table(benchmark, window=window)
    per_length = windows.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("words") + F.octet_length("item") + 64).alias("bytes")).collect()  # `window` rows at most
    lengths = sorted((r.len for r in per_length), reverse=True)
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("text_hash"), normal_words(F.col(text)).alias("_words"))
    rows = _run_hashes(rows, lengths)
    small = sum(r.bytes for r in per_length) <= broadcast_bytes
    hit = _hits_in_place(rows, windows, lengths) if small else _hits_by_shuffle(rows, windows, lengths)
    got = hit.groupBy("_id", "text_hash").agg(
        F.sum(F.when(F.col("span").isNull(), 1).otherwise(0)).alias("n_rows"),
        F.max("n").cast("long").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.collect_set("item").alias("items"),
    )
    hits = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    return got.select(F.col("_id").alias(key), "text_hash", "n_rows", "n_words", hits.alias("hits"), F.array_sort("items").alias("items"))


def digest(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document row: counts and the hash of its items."""
    each = hits.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return each.select(
        key,
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def _pieces(text: Column) -> Column:
    """Each word with what stands before it, and the rest of the text."""
    words, between = F.regexp_extract_all(text, F.lit(_WORD), 0), F.split(text, _WORD, -1)
    return F.zip_with(between, words, lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))


def _without(pieces: Column, hits: Column) -> Column:
    """The pieces that are not hit, put together; linear in the text."""
    before = F.concat(F.array(F.lit(-1)), hits)
    after = F.concat(hits, F.array(F.size(pieces)))
    runs = F.filter(F.zip_with(before, after, lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("n"))), lambda r: r["n"] > 0)
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(pieces, r["start"], r["n"]))), "")


def remove_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", drop_share: float = DROP_SHARE) -> DataFrame:
    """The documents without contamination, with their columns as they were.

    A document goes when ``drop_share`` of its words or more are hit; otherwise the
    hit spans are cut out of its text. Clean rows stay untouched.
    """
    hits = find_hits(docs, benchmark, key, text).filter(F.size("hits") > 0).select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_words").alias("_n"), F.col("hits").alias("_hits"))
    met = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_own")).join(hits, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    met = met.filter(F.col("_hits").isNull() | (F.size("_hits") < drop_share * F.col("_n")))
    # bound first: a lambda would split the text again for every run
    met = bind(met, _pieces=F.when(F.col("_hits").isNotNull(), _pieces(F.col("_row")[text])), _sorted=F.array_sort("_hits"))
    cut = F.when(F.col("_hits").isNull(), F.col("_row")[text]).otherwise(_without(F.col("_pieces"), F.col("_sorted")))
    return met.select(*[(cut if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
