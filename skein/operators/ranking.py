"""Weighted PageRank by power iteration: in one task if the graph is small, over blocks of edges, or over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation

from ..runtime import cut, drop_cut
from ..settings import DEFAULTS

#: Edges up to which one task solves the graph in memory (some 100 MB).
SMALL = 2_000_000
#: Nodes up to which the driver holds the scores and broadcasts them in each round (32 MB); edges of a block.
MOST_NODES, BLOCK = 4_000_000, 1 << 20


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = DEFAULTS.alpha, tolerance: float = DEFAULTS.tolerance, most: int = DEFAULTS.most_iterations, small: int = SMALL, written: bool = False) -> DataFrame:
    """``node, score`` over ``src, dst, weight``.

    Teleport and dangling mass go to the nodes of ``seeds`` (column ``node``)
    that are in the graph, evenly; without any of them in the graph in
    proportion to weighted in-degree; without ``seeds`` to all nodes evenly.
    Stops when the L1 change is below N times ``tolerance``, or after ``most``
    rounds. A graph of at most ``small`` edges, which are counted, is one
    task's. The edges of a larger one of up to ``MOST_NODES`` nodes are written
    as blocks of flat arrays, and a round is one job without a shuffle
    (:func:`_by_blocks`). Beyond, a round joins and shuffles: it writes the
    scores, observes the change and the mass to give back on the way, and
    deletes the round before it. Edges are written first, unless ``written``
    says that reading them again costs no more.
    """
    edges = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    edges = edges if written else cut(edges)
    if (n_edges := edges.count()) <= small:
        return _in_one_task(edges, seeds, alpha, tolerance, most)
    if (scores := _by_blocks(edges, n_edges, seeds, alpha, tolerance, most)) is not None:
        return scores
    out = edges.groupBy("src").agg(F.sum("weight").alias("w_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("w_in"))
    graph = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("w_out")).alias("p")))
    base = out.withColumnRenamed("src", "node").join(into.withColumnRenamed("dst", "node"), "node", "full_outer").select("node", F.col("w_out").isNotNull().alias("sends"), F.greatest(F.coalesce("w_in", F.lit(0.0)), F.lit(1e-9)).alias("w_in"))
    if seeds is None:
        base = base.withColumn("t", F.lit(1.0))
    else:
        base = base.join(seeds.select("node", F.lit(1.0).alias("seed")).distinct(), "node", "left")
        base = base.withColumn("t", F.coalesce("seed", F.lit(0.0))) if not base.where("seed = 1").isEmpty() else base.withColumn("t", F.col("w_in"))
    base = cut(base.select("node", "sends", "t"))
    n, total, silent = base.agg(F.count("*"), F.sum("t"), F.count_if(~F.col("sends"))).first()
    base = base.select("node", "sends", (F.col("t") / total).alias("t"))
    written, ranks, lost = None, base.withColumn("score", F.lit(1.0 / n)), silent / n
    for _ in range(most):
        got = ranks.select("node", "score").join(graph, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("t")) + (1 - alpha) * F.col("t")
        now = ranks.join(got, F.col("node") == F.col("dst"), "left").select("node", "sends", "t", new.alias("score"), F.col("score").alias("old"))
        seen = Observation()
        now = cut(now.observe(seen, F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.sum(F.when(F.col("sends"), 0.0).otherwise(F.col("score"))).alias("lost")))
        if written is not None:
            drop_cut(written)
        written, ranks, lost = now, now.drop("old"), seen.get["lost"]
        if seen.get["change"] < n * tolerance:
            break
    return ranks.select("node", "score")


def _in_one_task(edges: DataFrame, seeds: DataFrame | None, alpha: float, tolerance: float, most: int) -> DataFrame:
    """The same over flat arrays. Seeds are rows without a ``dst``."""
    rows = edges if seeds is None else edges.unionByName(seeds.select(F.col("node").alias("src")).distinct(), allowMissingColumns=True)
    seeded = seeds is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, schema=pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())]))
        link = whole.filter(whole["dst"].is_valid())
        if not len(link):
            return
        both = pa.chunked_array(link["src"].chunks + link["dst"].chunks, pa.string()).combine_chunks().dictionary_encode()
        names, at = both.dictionary, both.indices.to_numpy()
        src, dst, w, n = at[: len(link)], at[len(link) :], link["weight"].to_numpy(), len(both.dictionary)
        w_out = np.bincount(src, w, n)
        t = np.ones(n)
        if seeded:
            t = names.is_valid().to_numpy(zero_copy_only=False) & np.isin(names.to_numpy(zero_copy_only=False), whole.filter(whole["dst"].is_null())["src"].to_numpy())
            t = t.astype(float) if t.any() else np.maximum(np.bincount(dst, w, n), 1e-9)
        t /= t.sum()
        p, silent, score = w / w_out[src], np.bincount(src, minlength=n) == 0, np.full(n, 1 / n)
        for _ in range(most):
            new = alpha * (np.bincount(dst, score[src] * p, n) + score[silent].sum() * t) + (1 - alpha) * t
            change, score = np.abs(new - score).sum(), new
            if change < n * tolerance:
                break
        yield pa.RecordBatch.from_arrays([names, pa.array(score)], ["node", "score"])

    return rows.repartition(1).mapInArrow(run, "node string, score double")


def _by_blocks(edges: DataFrame, n_edges: int, seeds: DataFrame | None, alpha: float, tolerance: float, most: int) -> DataFrame | None:
    """The same, with the scores at the driver; None if there are too many nodes for that, or two of one 64-bit hash.

    A node's number is its hash's place among all. The edges into a node are
    one task's, ordered by it and written once; in each round a task gets all
    scores, a share of each for a unit of weight, and tells the sums of its nodes.
    """
    sc = edges.sparkSession.sparkContext
    ends = edges.select(F.col("src").alias("node"), F.col("weight").alias("w_out"), F.lit(0.0).alias("w_in")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(None).cast("double").alias("w_out"), F.col("weight").alias("w_in")))
    nodes = ends.groupBy("node").agg(F.sum("w_out").alias("w_out"), F.sum("w_in").alias("w_in")).withColumn("h", F.xxhash64("node"))
    if seeds is not None:
        nodes = nodes.join(seeds.select("node", F.lit(1.0).alias("seed")).distinct(), "node", "left")
    nodes = cut(nodes)
    if nodes.count() > MOST_NODES:
        return None
    told = nodes.drop("node").toArrow()
    order = np.argsort(told["h"].to_numpy())
    h, w_out, w_in = (told[c].to_numpy()[order] for c in ("h", "w_out", "w_in"))
    n, sends = len(h), told["w_out"].is_valid().to_numpy()[order]
    if (h[1:] == h[:-1]).any():
        return None
    t = np.ones(n)
    if seeds is not None:
        t = told["seed"].is_valid().to_numpy()[order].astype(float)
        t = t if t.any() else np.maximum(w_in, 1e-9)
    t /= t.sum()
    known = sc.broadcast(h)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*[np.searchsorted(known.value, x.column(c).to_numpy()).astype(np.int32) for c in "sd"], x.column("w").to_numpy()) for x in batches]
        if not held:
            return
        src, dst, w = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(dst, kind="stable")
        for lo in range(0, len(order), BLOCK):
            o = order[lo : lo + BLOCK]
            at = np.flatnonzero(np.diff(dst[o], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (src[o], w[o], dst[o][at], at)], ["src", "w", "dst", "at"])

    hashed = edges.select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d"), F.col("weight").alias("w"))
    blocks = cut(hashed.repartition(-(-n_edges // BLOCK), "d").mapInArrow(block, "src binary, w binary, dst binary, at binary"))
    score = np.full(n, 1 / n)
    for _ in range(most):
        share = sc.broadcast(np.divide(score, w_out, out=np.zeros(n), where=sends))

        def step(batches: Iterator[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for k in range(len(x)):
                    src, w, at = (np.frombuffer(x.column(c)[k].as_buffer(), of) for c, of in (("src", np.int32), ("w", np.float64), ("at", np.int64)))
                    got = np.add.reduceat(share.value[src] * w, at)
                    yield pa.RecordBatch.from_arrays([x.column("dst")[k : k + 1], pa.array([got.tobytes()], pa.binary())], ["dst", "got"])

        new = np.zeros(n)
        for dst, got in blocks.select("src", "w", "dst", "at").mapInArrow(step, "dst binary, got binary").collect():
            # a node comes again if its edges are in several blocks
            new[np.frombuffer(dst, np.int32)] += np.frombuffer(got, np.float64)
        share.destroy()
        new = alpha * (new + score[~sends].sum() * t) + (1 - alpha) * t
        change, score = np.abs(new - score).sum(), new
        if change < n * tolerance:
            break
    drop_cut(blocks)
    scores = sc.broadcast(score)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column("node"), pa.array(scores.value[np.searchsorted(known.value, x.column("h").to_numpy())])], ["node", "score"])

    return nodes.select("node", "h").mapInArrow(named, "node string, score double")
