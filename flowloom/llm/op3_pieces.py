"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation of a text under the pieces' log probabilities is found position
by position. Only a window of the longest piece is alive: each position relaxes the
ends of the pieces that start there. When the back pointers of all living ends lead
through one boundary, everything before it is final; its ids are committed and
forgotten. A position that no living path passes over is such a boundary and is seen
at once; where paths run side by side, their back pointers are followed now and then (a
run like ``zzzz...`` whose odd and even paths never meet is held until its end, one back
pointer per character). A character no piece covers costs ``UNKNOWN`` more than the
rarest piece and is written as byte pieces.

The scores of a unigram model are used as they are. A BPE model stores merge ranks
instead; rank r is then given the Zipf probability ``1 / ((r + 1) * H)``, so its ids are
the likeliest segmentation into its pieces, not its merge order (see README).

Texts are fed to the search in chunks. If the model's pieces hold a space at the front
only, all paths meet at the ends of words: words are the chunks then, and the ids that the
search gave for a word are kept in a bounded cache.

Defined results: a null text has no ids and decodes to null, an empty one has no ids;
the piece mark U+2581 in a text counts as a space; repeated rows are encoded
alike; of equally likely segmentations the one whose last piece starts first is taken;
an empty table gives no rows; a very long text or word goes through in chunks of ``CHUNK``;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from flowloom.llm.arrow import map_batches

MARK = "▁"
UNKNOWN = 10.0
NEVER = -1e6
#: Words in each of the two ages of the cache.
MAX_CACHED = 60_000
#: Longer words are searched again each time, which bounds the cache.
MAX_KEPT = 64
CHUNK = 1 << 16
CHECK_EVERY = 64


class Pieces:
    """Pieces of a model file with their log probabilities."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalization are supported")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        kinds = ModelProto.SentencePiece.Type
        ranked = proto.trainer_spec.model_type == proto.trainer_spec.ModelType.Value("BPE")
        library = SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        scores: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.Value("BYTE"):
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i) or library.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.piece.replace(MARK, " ").encode())
                if p.score > NEVER:
                    scores[p.piece.replace(MARK, " ")] = (i, p.score)
        if ranked:
            total = math.log(sum(1 / (1 - s) for _, s in scores.values()))
            scores = {p: (i, -math.log(1 - s) - total) for p, (i, s) in scores.items()}
        self.unknown = min(s for _, s in scores.values()) - UNKNOWN
        self.longest = max(map(len, scores))
        #: Next character to (id or -1, score, following characters); None where no piece goes on.
        self.tree: dict = {}
        for piece, (i, score) in scores.items():
            self._plant(piece, i, score)
        self.scores = scores
        self.singles = {p for p in scores if len(p) == 1}
        inside = {c for p in scores for c in p[1:]}
        crossing = {c for p in scores if len(p) > 1 for c in p}
        # a word may be encoded alone if no piece reaches over its ends
        self.words = re.compile(" [^ \n]*|[^ \n]+|\n") if " " not in inside and "\n" not in crossing else None
        self.width = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"

    def _plant(self, piece: str, i: int, score: float) -> None:
        kids = self.tree
        for c in piece[:-1]:
            at = kids.get(c, (-1, 0.0, None))
            if at[2] is None:
                at = kids[c] = (at[0], at[1], {})
            kids = at[2]
        kids[piece[-1]] = (i, score, kids.get(piece[-1], (-1, 0.0, None))[2])


class StreamingViterbi:
    """Text in, committed ids out; holds one window and the uncommitted back pointers."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self._restart()

    def _restart(self) -> None:
        self.text = ""  # from the last forgotten boundary on; positions count from there
        self.at = self.reach = self.done = 0  # next position to open, farthest living end, committed up to
        self.best, self.start, self.piece = [0.0], [0], [-1]
        self.check = CHECK_EVERY

    def feed(self, text: str) -> list[int]:
        """Ids that became final; text may come in chunks of any size."""
        n = len(text)
        self.text += text
        self.best += [-math.inf] * n
        self.start += [0] * n
        self.piece += [-1] * n
        # a start is opened once all pieces from it can be seen
        stop = len(self.text) - self.p.longest + 1
        if stop <= self.at:
            return []
        out = self._open(stop)
        if 2 * self.done > len(self.text):
            self._forget()
        return out

    def finish(self) -> list[int]:
        """The remaining ids; the search is ready for another text."""
        stop = len(self.text)
        out = self._open(stop)
        if self.done < stop:
            out += self._commit(stop)
        self._restart()
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text, fed in chunks."""
        out = self.feed(text[:CHUNK])
        for at in range(CHUNK, len(text), CHUNK):
            out += self.feed(text[at : at + CHUNK])
        return out + self.finish()

    def _open(self, stop: int) -> list[int]:
        out: list[int] = []
        text, longest, tree, singles, unknown = self.text, self.p.longest, self.p.tree, self.p.singles, self.p.unknown
        best, start, piece, i, reach = self.best, self.start, self.piece, self.at, self.reach
        while i < stop:
            if i == reach:
                # one living end: all paths meet here
                if i > self.done:
                    out += self._commit(i)
                    best[i] = 0.0
            elif i >= self.check:
                out += self._meet(i, reach)
                # paths that run side by side for long are followed less and less often
                self.check = i + max(CHECK_EVERY, i - self.done)
            score, kids, k = best[i], tree, i
            for c in text[i : i + longest]:
                if c not in kids:
                    break
                k += 1
                found, worth, kids = kids[c]
                if found >= 0:
                    worth += score
                    if worth > best[k]:
                        best[k], start[k], piece[k] = worth, i, found
                    if k > reach:
                        reach = k
                if kids is None:
                    break
            if text[i] not in singles:
                if score + unknown > best[i + 1]:
                    best[i + 1], start[i + 1], piece[i + 1] = score + unknown, i, -1
                if i + 1 > reach:
                    reach = i + 1
            i += 1
        self.at, self.reach = i, reach
        return out

    def _meet(self, low: int, high: int) -> list[int]:
        """Ids up to the boundary where the paths of all living ends meet."""
        ends = {k for k in range(low, high + 1) if self.best[k] > -math.inf}
        while len(ends) > 1:
            last = max(ends)
            ends.discard(last)
            ends.add(self.start[last])
        return self._commit(max(ends.pop(), self.done))

    def _commit(self, end: int) -> list[int]:
        out: list[int] = []
        start, piece, done, at = self.start, self.piece, self.done, end
        while at > done:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.p.byte_ids[b] for b in reversed(self.text[start[at] : at].encode("utf-8", "surrogatepass"))]
            at = start[at]
        self.done = end
        return out[::-1]

    def _forget(self) -> None:
        cut = self.done
        self.text = self.text[cut:]
        self.best, self.start, self.piece = self.best[cut:], [s - cut for s in self.start[cut:]], self.piece[cut:]
        self.at, self.reach, self.check, self.done = self.at - cut, self.reach - cut, self.check - cut, 0


class _Cache(dict):
    """Words to the id bytes that the search gave for them.

    A full cache becomes the old one, and a word found there moves on to the new one, so frequent words stay.
    ``unsound``: the ids of some word did not decode to it.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.search, self.code = StreamingViterbi(pieces), "H" if pieces.width == "<u2" else "I"
        self.old: dict[str, bytes] = {}
        self.unsound = False

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            ids = self.search.encode(word)
            if b"".join(map(self.search.p.bytes_of.__getitem__, ids)) != word.encode():
                self.unsound = True
            got = array(self.code, ids).tobytes()
        if len(word) <= MAX_KEPT:
            if len(self) >= MAX_CACHED:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class PieceCodec:
    """``encode`` and ``decode`` of whole texts."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.cache = _Cache(self.pieces)

    def encode(self, text: str) -> np.ndarray:
        text = text.replace(MARK, " ")
        if text and self.pieces.prefix:
            text = " " + text
        if self.pieces.words is None:
            return np.array(self.cache.search.encode(text), dtype=self.pieces.width)
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.pieces.words.findall(text))), dtype=self.pieces.width)

    def round_trip(self, text: str, ids: np.ndarray) -> bool:
        """Whether ``ids``, which ``encode`` gave for ``text``, decode to it.

        Every word is decoded when it is searched, and a text decodes to what its words decode to, one after the
        other. Where a word did not come back, and where texts are not cut into words, the text is decoded.
        """
        if self.pieces.words is not None and not self.cache.unsound:
            return True
        return self.decode(ids) == text.replace(MARK, " ")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One per worker process, so that its cache serves all its tasks."""
    return PieceCodec(path)


def _encode_batches(batches: Iterator[pa.RecordBatch], columns: list[str], model: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = codec(model)
    for batch in batches:
        at, texts = 0, batch.column("_text")
        while at < batch.num_rows:
            ids, same, size, first = [], [], 0, at
            while at < batch.num_rows and size < 1 << 20:
                text = texts[at].as_py()
                got = pieces.encode(text or "")
                ids.append(None if text is None else got)
                same.append(None if text is None else pieces.round_trip(text, got))
                size += len(got)
                at += 1
            part = batch.slice(first, at - first)
            counts = np.array([0 if x is None else len(x) for x in ids])
            flat = np.concatenate([x for x in ids if x is not None and len(x)] or [np.zeros(0, np.int32)]).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(flat), mask=pa.array([x is None for x in ids]))
            crc = [None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), lists.cast(schema.field("ids").type)], schema=schema)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_crc32, round_trip, ids`` of each row.

    ``round_trip`` says that the decoded ids give the text back.
    """
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    out = StructType([rows.schema[key]]).add("n_tokens", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    out = out.add(StructField("ids", ArrayType(IntegerType(), False)))
    return map_batches(rows, _encode_batches, out, [key], model)


def _decode_batches(batches: Iterator[pa.RecordBatch], columns: list[str], model: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pieces = codec(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = part.column("_ids")
            texts = [pieces.decode(ids[i].values.to_numpy()) if ids[i].is_valid else None for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], schema=schema)


def decode(rows: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` from rows of ids."""
    rows = rows.select(F.col(key), F.col(ids).alias("_ids"))
    return map_batches(rows, _decode_batches, StructType([rows.schema[key]]).add("text", "string"), [key], model)
