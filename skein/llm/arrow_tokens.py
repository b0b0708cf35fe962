"""Token ids in Arrow files of equal-length sequences and masks.

A file has record batches of two fixed-size-list columns: ``ids`` (sequences
of ``length`` ids, the documents one after another, cut wherever a sequence is
full) and ``mask`` (true for ids, false for the padding that fills a file's
last sequence; a bit each, which reading unpacks). Batches are not compressed and lists have no offsets, so a
memory-mapped file gives any sequence, or any run of ids, as a view. A second
file beside it has a row for each document: where it starts, how many ids.

Files hold ranges of doc_id in ascending order and are committed under
temporary names with a manifest, which also gives each file's first position.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, commit, new_folder, one_each, parts_for, ranges, store_of
from .words import word_end_ids

#: Ids of a sequence, sequences of a batch, texts that are encoded at once.
LENGTH, BATCH, TEXTS = 2048, 64, 500


class _Writer:
    """One file and its index, filled id by id in constant memory."""

    def __init__(self, store, path: str, length: int, dtype: np.dtype) -> None:
        self.length, self.dtype, self.n, self.held, self.size, self.docs = length, dtype, 0, [], 0, []
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [store.open_output_stream(path), store.open_output_stream(f"{path}.index")]
        self.files = [ipc.new_file(self.streams[0], self.schema), ipc.new_file(self.streams[1], self.index)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.n += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH * self.length:
            self._put(False)
        if len(self.docs) >= 50_000:
            self._list()

    def _put(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = BATCH * self.length
        whole = len(flat) if last else len(flat) // step * step
        for i in range(0, whole, step):
            ids = flat[i : min(i + step, whole)]
            rows = -(-len(ids) // self.length)
            mask = np.arange(rows * self.length) < len(ids)
            ids = np.concatenate([ids, np.zeros(rows * self.length - len(ids), self.dtype)])
            self.files[0].write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))
        self.held, self.size = [flat[whole:]], len(flat) - whole

    def _list(self) -> None:
        if self.docs:
            self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)], schema=self.index))
        self.docs = []

    def close(self) -> None:
        self._put(True)
        self._list()
        for f in (*self.files, *self.streams):
            f.close()


class TokenFile:
    """Random access to one file: any sequence, mask or run of ids, without copying where the file is memory-mapped."""

    def __init__(self, store, path: str) -> None:
        from pyarrow.fs import LocalFileSystem

        opened = lambda p: pa.memory_map(p) if isinstance(store, LocalFileSystem) else store.open_input_file(p)
        self.file, self.index = ipc.open_file(opened(path)), ipc.open_file(opened(f"{path}.index"))
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, i: int) -> np.ndarray:
        return self._row("ids", i)

    def mask(self, i: int) -> np.ndarray:
        return self._row("mask", i)

    def _row(self, column: str, i: int) -> np.ndarray:
        values = self.file.get_batch(i // BATCH).column(column).values
        at = i % BATCH * self.length
        return values.slice(at, self.length).to_numpy(zero_copy_only=column == "ids")

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file; a view if they lie in one batch."""
        step, parts, end = BATCH * self.length, [], start + n
        while start < end:
            stop = min(end, (start // step + 1) * step)
            parts.append(self.file.get_batch(start // step).column("ids").values.slice(start % step, stop - start).to_numpy())
            start = stop
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def docs(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, length: int = LENGTH) -> str:
    """Encode every whole text, append ``end_id``, and write all in ascending doc_id order; returns the folder.

    tokenizer: a file of the tokenizers library whose vocabulary drops white
    space. A null text is empty (its end id only). Null ids come first, equal
    ids in order of their texts. An empty table gives a manifest without
    files. Other columns are ignored, whatever their names.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = ranges(rows, "doc_id", parts_for(docs))
    dealt = rows.withColumn("part", cuts.of(F.col("doc_id"))).repartitionById(cuts.parts, "part").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        own = word_end_ids(tokenizer)
        end, out, name, temp = np.array([end_id], own.dtype), None, None, None
        n_docs = 0
        for x in batches:
            if out is None and len(x):
                name = f"part-{x.column('part')[0].as_py():05d}.arrow"
                temp = f"_temporary/{uuid.uuid4().hex}-{name}"
                store.create_dir(f"{root}/_temporary", recursive=True)
                out = _Writer(store, f"{root}/{temp}", length, own.dtype)
            for i in range(0, len(x), TEXTS):
                some = x.slice(i, TEXTS)
                for d, ids in zip(some.column("doc_id").to_pylist(), own.encode(some.column("text").to_pylist()), strict=True):
                    out.add(d, np.concatenate([np.frombuffer(ids, own.dtype), end]))
                    n_docs += 1
        if out is not None:
            out.close()
            for more in ("", ".index"):
                yield pa.RecordBatch.from_pylist([{"temp": temp + more, "name": name + more, "tokens": out.n, "docs": n_docs}])

    files = [r.asDict() for r in arrow_map(dealt, run, "temp string, name string, tokens long, docs long").collect()]
    files.sort(key=lambda f: f["name"])
    start = 0
    for f in files:
        f["start"] = start
        start += f["tokens"] * f["name"].endswith(".index")
    store, root = store_of(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)
    commit(folder, files)
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read from the files: its first id's position among all, and its ids (little-endian unsigned 32-bit, packed)."""
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        files = [(x["name"], x["start"]) for x in json.loads(f.read()) if not x["name"].endswith(".index")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for x in batches:
            for row in x.to_pylist():
                file = TokenFile(store, f"{root}/{row['name']}")
                for all_docs in file.docs():
                    for i in range(0, len(all_docs), TEXTS):
                        d = all_docs.slice(i, TEXTS)
                        starts, sizes = d.column("start").to_pylist(), d.column("n_tokens").to_pylist()
                        ids = [file.ids(a, n).astype("<u4").tobytes() for a, n in zip(starts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array([row["first"] + a for a in starts], pa.int64()), d.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return arrow_map(one_each(spark, files, "name string, first long"), run, "doc_id long, start long, n_tokens long, ids binary")
