"""Ranks in the naive and the credible graph of the same claims, whose edges are folded once from sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, drop_cut
from ..settings import DEFAULTS

#: Nodes up to which the driver holds the scores (some 15 arrays of 8 bytes each); rows that a task folds at once; rounds that are asked for the end of all paths.
MOST_NODES, FOLDED, DEPTH = 4_000_000, 1 << 20, 3
#: Nodes whose scores are added up at once.
CHUNK = 1 << 16

_BLOCK = ["names", "src", "w", "n", "dst", "at", "w_out", "n_out", "w_in", "n_in"]
_KINDS = dict(zip(_BLOCK, (np.int64, np.int32, np.float64, np.int32, np.int64, np.int32, *[np.float64] * 4), strict=True))


def ranks(links: DataFrame, seeds: DataFrame, alpha: float = DEFAULTS.alpha, tolerance: float = DEFAULTS.tolerance, most: int = DEFAULTS.most_iterations, most_nodes: int | None = None) -> DataFrame | None:
    """``node, ppr_naive, ppr_credible`` of the ends of ``links`` (src, dst, g, w) in both graphs, by the rounds of ``ranking.pagerank``.

    In the credible graph a link adds ``w`` to its edge, those of one edge and
    ``g`` (not null) their largest once; in the naive one each counts one, if
    its ends have names. The first teleports to the seeds (``node``). Links are
    moved once. Nodes are 64-bit hashes. None if there are more than
    ``most_nodes``, or two ``dst`` of one hash.

    A round is linear, so the scores of round k add up from the teleport's and
    the start's mass after 0, 1, ... steps. Where no path has more than
    ``DEPTH`` edges, these are the only passes over the edges.
    """
    sc = links.sparkSession.sparkContext
    blocks = cut(_folded(links))
    if not blocks.where("clash").isEmpty():
        return None
    nodes = blocks.select("names", "w_out", "n_out", "dst", "w_in", "n_in").mapInArrow(_ends, "h long, w_out double, n_out double, w_in double, n_in double")
    nodes = nodes.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("w_out", "n_out", "w_in", "n_in")])
    nodes = cut(nodes.join(seeds.select(F.xxhash64("node").alias("h"), F.lit(True).alias("seed")).distinct(), "h", "left"))
    if nodes.count() > (MOST_NODES if most_nodes is None else most_nodes):
        return None
    told = nodes.select("h", "w_out", "n_out", (F.col("n_out") + F.col("n_in") > 0).alias("naive"), F.col("seed").isNotNull().alias("seed")).toArrow()
    order = np.argsort(told["h"].to_numpy())
    h, w_out, n_out, naive, seeded = (told[c].to_numpy()[order] for c in ("h", "w_out", "n_out", "naive", "seed"))
    del told
    if not seeded.any():
        w_in = nodes.select("h", "w_in").toArrow()
        seeded = np.maximum(w_in["w_in"].to_numpy()[np.argsort(w_in["h"].to_numpy())], 1e-9)
    known = sc.broadcast(h)

    def flow(shares: list[tuple[str, np.ndarray]]) -> list[np.ndarray]:
        """What each node gets, for each kind of weight and share of a unit of it."""
        told, kinds = sc.broadcast([x for _, x in shares]), [k for k, _ in shares]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for k in range(len(x)):
                    b = {c: np.frombuffer(x.column(c)[k].as_buffer(), _KINDS[c]) for c in x.schema.names}
                    at = np.searchsorted(known.value, b["names"])
                    got = [np.add.reduceat(v[at][b["src"]] * b[c], b["at"]) for c, v in zip(kinds, told.value, strict=True)]
                    to = np.searchsorted(known.value, b["dst"]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary()) for y in (to, *got)], ["dst", *[f"g{i}" for i in range(len(got))]])

        new = [np.zeros(len(h)) for _ in shares]
        for dst, *got in blocks.select("names", "src", "w", "n", "dst", "at").mapInArrow(step, "dst binary, " + ", ".join(f"g{i} binary" for i in range(len(shares)))).collect():
            # a node comes again if its edges are in several blocks
            for v, g in zip(new, got, strict=True):
                v[np.frombuffer(dst, np.int32)] += np.frombuffer(g, np.float64)
        told.destroy()
        return new

    graphs = [_Graph("n", naive.astype(float), naive.astype(float), n_out), _Graph("w", seeded.astype(float), np.ones(len(h)), w_out)]
    for _ in range(DEPTH):
        wanted = [(g, i) for g in graphs for i in g.open()]
        if not wanted:
            break
        for (g, i), x in zip(wanted, flow([(g.kind, g.share(g.after[i][-1])) for g, i in wanted]), strict=True):
            g.after[i].append(x)
        del g, x, wanted
    # the arrays of a graph go when its scores are there
    scores = sc.broadcast([graphs.pop(0).scores(flow, alpha, tolerance, most) for _ in range(2)])
    has = sc.broadcast(naive)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(len(x)):
                at = np.searchsorted(known.value, np.frombuffer(x.column("own")[k].as_buffer(), np.int64))
                whole = pa.RecordBatch.from_arrays([x.column("name")[k].values, *[pa.array(s[at]) for s in scores.value]], ["node", "ppr_naive", "ppr_credible"])
                whole = whole.filter(pc.and_(pa.array(has.value[at]), pc.not_equal(whole.column("node"), "")))
                for lo in range(0, len(whole), 100_000):
                    yield whole.slice(lo, 100_000)

    out = cut(blocks.select("own", "name").mapInArrow(named, "node string, ppr_naive double, ppr_credible double"))
    drop_cut(nodes)
    drop_cut(blocks)
    return out


class _Graph:
    """One graph's teleport and start, and their mass after 0, 1, ... steps along the edges, as far as it is known."""

    def __init__(self, kind: str, teleport: np.ndarray, start: np.ndarray, out: np.ndarray):
        self.kind, self.out, self.sends, self.n = kind, out, out > 0, int(np.count_nonzero(start))
        t, s = teleport / max(teleport.sum(), 1e-300), start / max(start.sum(), 1)
        self.after = [[t]] if (t == s).all() else [[t], [s]]

    def open(self) -> list[int]:
        """Which of them a further step would move."""
        return [i for i, x in enumerate(self.after) if x[-1][self.sends].any()]

    def share(self, mass: np.ndarray) -> np.ndarray:
        return np.divide(mass, self.out, out=np.zeros(len(mass)), where=self.sends)

    def scores(self, flow, alpha: float, tolerance: float, most: int) -> np.ndarray:
        if self.open():
            return self._by_rounds(flow, alpha, tolerance, most)
        # a score is a sum of these, and so are its lost mass and its change
        t, start = self.after[0], self.after[-1]
        parts = [*t, *start]
        weigh = lambda c: (sum(x * part[lo : lo + CHUNK] for x, part in zip(c, parts, strict=True) if x) for lo in range(0, len(t[0]), CHUNK))
        power = alpha ** np.r_[np.arange(len(t)), np.arange(len(start))]
        lost = power * [x[~self.sends].sum() for x in parts]
        now, back = np.r_[np.zeros(len(t)), 1, np.zeros(len(start) - 1)], []
        for k in range(1, most + 1):
            back.insert(0, alpha * (now @ lost) + 1 - alpha)
            new = np.zeros(len(now))
            new[: min(k, len(t))] = back[: len(t)]
            if k < len(start):
                new[len(t) + k] = 1
            step, now = (new - now) * power, new
            if sum(np.abs(x).sum() for x in weigh(step)) < self.n * tolerance:
                break
        return np.concatenate([np.zeros(0), *(x + np.zeros(1) for x in weigh(now * power))])

    def _by_rounds(self, flow, alpha: float, tolerance: float, most: int) -> np.ndarray:
        t, score = self.after[0][0], self.after[-1][0]
        for _ in range(most):
            (got,) = flow([(self.kind, self.share(score))])
            new = alpha * (got + score[~self.sends].sum() * t) + (1 - alpha) * t
            change, score = np.abs(new - score).sum(), new
            if change < self.n * tolerance:
                break
        return score


def _folded(links: DataFrame) -> DataFrame:
    """Blocks of edges as flat arrays, in the order of their ends: a column for each array, those of a block's sources, edges and ends.

    ``own, name``: the ends that the task didn't meet before.
    """
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    # k: 1 for a link that counts by itself, 2 if its ends have names
    kind = F.col("g").isNull().cast("int") + F.when(there("src") & there("dst"), 2).otherwise(0)
    rows = links.select(F.xxhash64("dst").alias("d"), F.xxhash64("src").alias("s"), kind.alias("k"), F.coalesce("g", F.lit(0).cast("long")).alias("g"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("dst", F.lit("")).alias("name"))

    def block(x: tuple, name: pa.Array, known: np.ndarray) -> pa.RecordBatch:
        d, s, k, _, w, c = x
        edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
        w, n = np.add.reduceat(w, edge), np.add.reduceat(np.where(k & 2, c, 0), edge).astype(np.int32)
        names, src = np.unique(s[edge], return_inverse=True)
        d = d[edge]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        dst = d[at]
        new = ~np.isin(dst, known)
        sums = [np.bincount(src, y, len(names)) for y in (w, n)] + [np.add.reduceat(y.astype(float), at) for y in (w, n)]
        arrays = dict(zip(_BLOCK, (names, src, w, n, dst, at, *sums), strict=True))
        told = [pa.array([arrays[c].astype(_KINDS[c]).tobytes()], pa.binary()) for c in _BLOCK]
        own = name.take(pa.array(edge[at[new]]))
        whole = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
        return pa.RecordBatch.from_arrays([*told, pa.array([dst[new].tobytes()], pa.binary()), whole, pa.array([False])], [*_BLOCK, "own", "name", "clash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, left, known = [], 0, None, np.zeros(0, np.int64)

        def fold(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, left, known
            t = pa.Table.from_batches(held) if held else None
            x = [t[c].to_numpy() for c in ("d", "s", "k", "g", "w")] + [np.ones(len(t), np.int64)] if held else None
            name = t["name"].combine_chunks() if held else None
            if left is not None:
                x = [np.r_[a, b] for a, b in zip(left[0], x, strict=True)] if x else left[0]
                name = pa.concat_arrays([left[1], name]) if held else left[1]
            held, n, left = [], 0, None
            if x is None:
                return
            kept = len(name)
            if not final:
                # the last group may go on
                d, s, k, g = (y[-2::-1] == y[-1] for y in x[:4])
                same = d & s & k & g & (x[2][-1] & 1 == 0)
                kept -= 1 + (len(same) if same.all() else int(np.argmin(same)))
                left = [*[y[-1:] for y in x[:4]], x[4][kept:].max(keepdims=True), x[5][kept:].sum(keepdims=True)], name.slice(len(name) - 1)
                if not kept:
                    return
            order = np.lexsort([y[:kept] for y in x[3::-1]])
            d, s, k, g, w, c = (y[order] for y in x)
            name = name.take(pa.array(order))
            same = d[1:] == d[:-1]
            if pc.any(pc.not_equal(name.slice(1).filter(pa.array(same)), name.slice(0, kept - 1).filter(pa.array(same)))).as_py():
                # two ends of one hash
                yield pa.RecordBatch.from_arrays([*[pa.array([b""], pa.binary()) for _ in _BLOCK], pa.array([b""], pa.binary()), pa.array([[]], pa.list_(pa.string())), pa.array([True])], [*_BLOCK, "own", "name", "clash"])
                return
            first = np.flatnonzero(np.r_[True, ~same | (s[1:] != s[:-1]) | (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | ((k[1:] & 1) == 1)])
            x = d[first], s[first], k[first], g[first], np.maximum.reduceat(w, first), np.add.reduceat(c, first)
            yield block(x, name.take(pa.array(first)), known)
            known = np.union1d(known, x[0])

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= FOLDED:
                yield from fold(False)
        yield from fold(True)

    schema = ", ".join(f"{c} binary" for c in _BLOCK) + ", own binary, name array<string>, clash boolean"
    # copies of a link come one after another, by a first key that a sort has to look at only
    return rows.repartition("d").sortWithinPartitions(F.xxhash64("s", "d"), "k", "g").mapInArrow(run, schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources with what they send in a block, and ends with what they get."""
    cols = ["h", "w_out", "n_out", "w_in", "n_in"]
    for x in batches:
        for k in range(len(x)):
            b = {c: np.frombuffer(x.column(c)[k].as_buffer(), _KINDS[c]) for c in x.schema.names}
            none = [np.zeros(len(b[c])) for c in ("names", "dst")]
            for y in ([b["names"], b["w_out"], b["n_out"], none[0], none[0]], [b["dst"], none[1], none[1], b["w_in"], b["n_in"]]):
                for lo in range(0, len(y[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in y], cols)
