"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Every text is encoded once and written, packed, to the shared folder. Pieces of
a full window go out as they are; what is left of each document is packed with
its like: documents are dealt into shards by a min-hash of their terms, so that
related ones meet, and each shard builds an inverted index with document
frequencies and the mean length counted over what is packed so, corpus-wide. The
next unused document is the seed; the index scores all unused documents by BM25
with every term of the seed, and its neighbours, best first, fill the
window greedily. The one that doesn't fit is cut, and its rest stays unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_folder, parts_for
from .words import byte_level_ids

#: Window in tokens; BM25's constants.
WINDOW, K1, B = 2048, 1.2, 0.75
#: Terms in more than one of so many documents have their scores as a row of all documents; neighbours sorted first.
DENSE, HEAD = 8, 256
#: Tokens that one shard holds at most (its index is kept in memory), texts encoded at once.
SHARD, TEXTS = 3_000_000, 500

_TOKENS = "doc_id long, n long, route long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(docs: DataFrame, ranks: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """``doc_id, n, route, ids``: packed ids with ``end_id`` appended, and a min-hash of the different terms; and how many ids there can be.

    Ids take two bytes if all of them fit, else four.
    """
    size = max(byte_level_ids(ranks, pattern).size, end_id + 1)
    kind = dtype_of(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_level_ids(ranks, pattern)
        end = np.array([end_id], kind).tobytes()
        mixed = np.random.default_rng(7).permutation(size).astype(np.int64)
        for x in batches:
            for i in range(0, len(x), TEXTS):
                some = x.slice(i, TEXTS)
                ids = [np.frombuffer(b, own.dtype).astype(kind, copy=False).tobytes() + end for b in own.encode([t or "" for t in some.column("text").to_pylist()])]
                n = np.array([len(b) // kind.itemsize for b in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), kind)
                at = np.cumsum(n) - n
                # the least and the next pair of terms by a fixed random order
                pair = mixed[flat] * size + np.r_[mixed[flat[1:]], 0]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n), pa.array(np.minimum.reduceat(pair, at)), pa.array(ids, pa.binary())], ["doc_id", "n", "route", "ids"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, _TOKENS), size


def dtype_of(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def document_frequencies(tokens: DataFrame, size: int = 1 << 16, window: int = WINDOW) -> tuple[np.ndarray, int]:
    """How many documents' rests beyond full windows have each term, and how many rests there are: numbers bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, dtype = np.zeros(size, np.int64), 0, dtype_of(size)
        for x in batches:
            for b in x.column("ids"):
                ids = np.frombuffer(b.as_buffer(), dtype)
                rest = ids[len(ids) // window * window :]
                n += len(rest) > 0
                df[np.unique(rest)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], ["term", "n"])

    got = dict(arrow_map(tokens.select("ids"), run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    df = np.zeros(size, np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return df, got.get(-1, 0)


class _Index:
    """BM25 over the documents of one shard. Scores of a term are laid out by term, so a query adds slices up."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
        key, count = np.unique(np.concatenate(ids).astype(np.int64) << 32 | doc, return_counts=True)
        self.doc, term = (key & 0xFFFFFFFF).astype(np.int32), key >> 32
        self.at = np.searchsorted(term, np.arange(len(idf) + 1))
        norm = K1 * (1 - B + B * sizes / mean)
        self.score = (idf[term] * count * (K1 + 1) / (count + norm[self.doc])).astype(np.float32)
        self.ids, self.n = ids, len(ids)
        self.local = np.diff(self.at)
        often = np.flatnonzero(self.local * DENSE > self.n)
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        for k, t in enumerate(often.tolist()):
            self.dense[k, self.doc[self.at[t] : self.at[t + 1]]] = self.score[self.at[t] : self.at[t + 1]]

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document for all different terms of the seed."""
        terms = np.unique(self.ids[seed])
        rows = self.row[terms]
        total = self.dense[rows[rows >= 0]].sum(axis=0).astype(np.float64)
        terms = terms[rows < 0]
        terms = terms[self.local[terms] > 1]
        if len(terms):
            spans = [slice(self.at[t], self.at[t + 1]) for t in terms.tolist()]
            total += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.score[s] for s in spans]), self.n)
        return total

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share any term with the seed, best first (ties: shard order); the tail is sorted when it is asked for."""
        total = self.scores(seed)
        found = np.flatnonzero((total > 0) & unused)
        t = total[found]
        head = np.ones(len(t), bool) if len(t) <= HEAD else t >= np.partition(t, len(t) - HEAD)[len(t) - HEAD]
        for some in (head, ~head):
            yield from found[some][np.argsort(-t[some], kind="stable")].tolist()


def _pack(ids: list[np.ndarray], rest: np.ndarray, index: _Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length) over the last ``rest`` ids of each document."""
    n = len(ids)
    left, total = rest.copy(), np.array([len(x) for x in ids])
    at, unused = 0, left > 0
    while True:
        while at < n and not unused[at]:
            at += 1
        if at == n:
            return
        room, out = window, []
        seed, queue = at, None
        now = seed
        while True:
            take = min(room, int(left[now]))
            out.append((now, int(total[now] - left[now]), take))
            left[now] -= take
            room -= take
            unused[now] = left[now] > 0
            if not room:
                break
            if queue is None:
                queue = index.neighbours(seed, unused)
            if (following := next(queue, None)) is not None:
                now = following
                continue
            # the seed has no more neighbours: the next unused document goes on
            while at < n and not unused[at]:
                at += 1
            if at == n:
                break
            seed = now = at
            queue = None
        yield out


def pack(docs: DataFrame, ranks: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ids: the piece's ids, little-endian unsigned 32-bit, packed. Each id of
    each document lies in exactly one piece; only the last sequence of a shard
    isn't full. A null text is empty: its end id alone. Repeated rows are
    packed each; null ids stay. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "pack")
    encoded, vocabulary = tokenize(docs, ranks, pattern, end_id, doc_id, text)
    encoded.write.option("compression", "zstd").parquet(folder)
    tokens, kind = spark.read.schema(_TOKENS).parquet(folder), dtype_of(vocabulary)
    df, n = document_frequencies(tokens, vocabulary, window)
    rest_of = F.col("n") % window
    mean = tokens.agg(F.avg(F.when(rest_of > 0, rest_of))).first()[0] or 1.0
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, 0
        for x in batches:
            for d, n, b in zip(*(x.column(c) for c in ("doc_id", "n", "ids")), strict=True):
                ids = np.frombuffer(b.as_buffer(), kind)
                whole = len(ids) // window * window
                held.append((d.as_py(), ids))
                size, total = size + len(ids) - whole, total + len(ids)
                if size >= shard or total >= 4 * shard:
                    yield from packed(held)
                    held, size, total = [], 0, 0
        if held:
            yield from packed(held)

    serial = [0]

    def packed(held: list[tuple[int | None, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        rows, weight = [], 0
        ids = [x for _, x in held]
        sizes = np.array([len(x) for x in ids], np.int64)
        rest = sizes % window

        def windows() -> Iterator[list[tuple[int, int, int]]]:
            for d, n in enumerate(sizes.tolist()):
                for start in range(0, n // window * window, window):
                    yield [(d, start, window)]
            yield from _pack(ids, rest, _Index([x[len(x) - r :] if r else x[:0] for x, r in zip(ids, rest.tolist(), strict=True)], idf, mean), window)

        for w in windows():
            offset = 0
            for d, start, length in w:
                rows.append((held[d][0], start, length, int(sizes[d]), base + serial[0], offset, ids[d][start : start + length].astype("<u4").tobytes()))
                offset += length
            serial[0] += 1
            weight += window
            if weight > 1 << 20:
                yield frame(rows)
                rows, weight = [], 0
        if rows:
            yield frame(rows)

    kinds = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _PIECES.split(", ")])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    # a hot route is a group of copies: doc_id tells its rows apart, so it spreads over ranges
    dealt = tokens.repartitionByRange(parts_for(docs), "route", "doc_id").sortWithinPartitions("route", "doc_id")
    return arrow_map(dealt, shards, _PIECES)
