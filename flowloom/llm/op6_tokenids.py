"""Token ids as binary files with Elias-Fano document boundaries.

Documents are dealt out by ranges of their id, tokenized in order, and each partition
writes one file: the concatenated ids, the boundaries and the document ids, both
Elias-Fano coded, and a footer. A manifest table lists the files. Files carry a name of
their own per attempt, and only those of committed tasks reach the manifest, so a
lost executor leaves nothing but an unlisted file.

Defined results: a null text is empty and holds only the end id; null document ids come
first; rows with one id stand side by side, ordered by a hash of their text;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from flowloom.llm.arrow import map_batches
from flowloom.llm.eliasfano import EliasFano, encode
from flowloom.llm.stored import stored
from flowloom.llm.wordbpe import encoder
from flowloom.llm.wordtable import text_runs

END_ID = 1
MAGIC = b"EFTOKEN1"
_FOOT = np.dtype([("tokens", "<u8"), ("documents", "<u8"), ("nulls", "<u8"), ("width", "<u4"), ("ends_bytes", "<u8"), ("keys_bytes", "<u8"), ("magic", "S8")])
READ_TOKENS = 1 << 20

MANIFEST = StructType().add("shard", "integer").add("path", "string").add("n_docs", "long").add("n_tokens", "long")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach; ``s3a`` is read as ``s3``."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    system, root = filesystem(folder)
    words = encoder(tokenizer)
    shard = TaskContext.get().partitionId()
    path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
    ends, keys, nulls, tokens = [np.zeros(1, np.int64)], [], 0, 0
    width = np.dtype(words.width).itemsize
    system.create_dir(root, recursive=True)
    with system.open_output_stream(path, buffer_size=1 << 20) as out:
        for batch in (b for part in ([first], batches) for b in part):
            for _, buf, offsets in text_runs(batch.column("text")):
                ids, sizes = words.encode(buf, offsets)
                out.write(np.insert(ids, np.cumsum(sizes), end_id))
                ends.append(tokens + np.cumsum(sizes + 1))
                tokens = int(ends[-1][-1])
            key = batch.column("id")
            nulls += key.null_count
            keys.append(key.drop_null().to_numpy())
        ends_bytes, keys_bytes = encode(np.concatenate(ends)), encode(np.concatenate(keys))
        out.write(ends_bytes)
        out.write(keys_bytes)
        n_docs = sum(map(len, ends)) - 1
        out.write(np.array([(tokens, n_docs, nulls, width, len(ends_bytes), len(keys_bytes), MAGIC)], dtype=_FOOT).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([n_docs]), pa.array([tokens])], schema=schema)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write the files to ``folder`` and return their manifest, in document order."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    # texts move in their own bytes; ids are made where they are written
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    return stored(map_batches(dealt, _write_batches, MANIFEST, folder, tokenizer, end_id), "manifest")


@dataclass
class Shard:
    """Random access to one file."""

    tokens: int
    nulls: int
    width: int
    ends: EliasFano
    keys: EliasFano
    file: pa.NativeFile

    @classmethod
    def open(cls, uri: str) -> Shard:
        system, path = filesystem(uri)
        file = system.open_input_file(path)
        size = file.size()
        foot = np.frombuffer(file.read_at(_FOOT.itemsize, size - _FOOT.itemsize), _FOOT)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        n_ends, n_keys = int(foot["ends_bytes"]), int(foot["keys_bytes"])
        tail = file.read_at(n_ends + n_keys, size - _FOOT.itemsize - n_ends - n_keys)
        return cls(int(foot["tokens"]), int(foot["nulls"]), int(foot["width"]), EliasFano(tail[:n_ends]), EliasFano(tail[n_ends:]), file)

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self.file.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects and one read."""
        return self.ids(self.ends.select(i), self.ends.select(i + 1))

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(key, start, ids)`` of all documents, read a block at a time."""
        keys = iter(k for run in self.keys.runs() for k in run.tolist())
        number, start, held, at = 0, None, np.zeros(0, f"<u{self.width}"), 0
        for run in self.ends.runs():
            for stop in run.tolist():
                if start is not None:
                    if stop > at + len(held):
                        at, held = start, self.ids(start, max(stop, min(start + READ_TOKENS, self.tokens)))
                    yield (None if number < self.nulls else next(keys)), start, held[start - at : stop - at]
                    number += 1
                start = stop


def _read_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            rows: list[tuple] = []
            for key, start, ids in Shard.open(uri).documents():
                rows.append((key, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(rows) >= 10_000:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def read_digest(spark: SparkSession, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every document, from the files."""
    shards = manifest.orderBy("shard").collect()  # one small row per file
    rows, before = [], 0
    for s in shards:
        rows.append((s.path, before))
        before += s.n_tokens
    out = StructType().add(key, LongType()).add("start", LongType()).add("n_tokens", LongType()).add("ids_crc32", LongType())
    files = spark.createDataFrame(rows, StructType().add("path", StringType()).add("before", LongType()))
    return map_batches(files.repartition(max(1, len(rows))), _read_batches, out)
