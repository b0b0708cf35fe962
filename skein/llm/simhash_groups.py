"""Near-duplicate texts: SimHash tries find the candidates, the whole shingle sets decide.

A document is the set of its shingles' hashes; equal sets are one class. Each
class has a wide SimHash of ``WIDTH`` words of 64 bits. A pair of likeness s
differs in a share d of the bits, so one trie whose first levels may spend no
error finds it only by chance; hence as many tries are walked, each over other
bits, as reach the asked ``recall`` at the threshold (:func:`layout`). What a
walk links within its error budget is a candidate. The components of these
links are then decided by exact Jaccard likeness of the whole sets, without
comparing pairs that are in one group already: those of bounded size by one
task each, larger ones in rounds that are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, cut
from .simhash import MOST_BROADCAST, joined, keep_smallest

#: Words of a wide fingerprint; classes of a subtree, on average; chance that a pair at the threshold is found.
WIDTH, SUBTREE, RECALL = 8, 256, 0.999
#: Standard deviations that an error budget leaves above the mean at the threshold.
SLACK = 3.5
#: Hashes of all sets of a component that one task decides (8 MB); of larger ones: classes that meet in one task, pivots of the first round.
BOUND, SALTED, PIVOTS = 1 << 20, 128, 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 12

_MIX = np.random.default_rng(11).integers(0, 2**64, WIDTH, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The different XXH64 values of the runs of ``words`` words, sorted. Fewer words: one shingle of all; none, or null: empty."""
    from xxhash import xxh64_intdigest as xxh

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined_ = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh(joined_, seed)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    return np.unique(np.fromiter((xxh(joined_[a:b], seed) for a, b in zip((ends - sizes)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(found) - words + 1))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` words: bit k is 1 if it is 1 in over half of the hashes, each mixed anew for each word."""
    ones = np.zeros(64 * WIDTH, np.int64)
    for i in range(0, len(hashes), BLOCK):
        x = hashes[i : i + BLOCK]
        y = (x ^ (x >> np.uint64(29)))[:, None] * _MIX
        y = (y ^ (y >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        y ^= y >> np.uint64(29)
        bits = np.unpackbits(y.astype("<u8", copy=False).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for j in range(0, len(x), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, digest, n, wide``: of each row its set's digest, size and wide fingerprint; an empty set has none."""
    from hashlib import blake2b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [shingle_set(t.as_py(), words) for t in x.column("text")]
            digests = [blake2b(h.tobytes(), digest_size=16).digest() for h in sets]
            wide = [wide_print(h).view(np.int64) if len(h) else None for h in sets]
            sizes = pa.array([len(h) for h in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(digests, pa.binary()), sizes, pa.array(wide, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "wide"])

    return arrow_map(docs, run, "doc_id long, digest binary, n long, wide array<long>")


def layout(classes: int, threshold: float, recall: float) -> tuple[int, int, int, int, int]:
    """(levels without error, tries, error budget in a trie, over two words, over the wide fingerprint).

    Two sets of likeness s differ in a share ``d = acos(2 s / (1 + s)) / pi`` of
    the bits, or less if their sizes differ. All levels of a trie agree with
    a chance of ``(1 - d) ** levels``.
    """
    d = math.acos(2 * threshold / (1 + threshold)) / math.pi
    levels = max(0, math.ceil(math.log2(max(1, classes) / SUBTREE)))
    tries = 1 if not levels else math.ceil(math.log(1 - recall) / math.log(1 - (1 - d) ** levels))
    budget = lambda n: math.ceil(n * d + SLACK * math.sqrt(n * d * (1 - d)))
    return levels, tries, budget(64 - levels), budget(128 - levels), budget(64 * WIDTH)


def _rotated(word, by):
    return F.shiftleft(word, by).bitwiseOR(F.shiftrightunsigned(word, 64 - by)) if by else word


def candidates(classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, int]:
    """``u, v``: of each subtree a spanning star of what its walk linked, by ``c, wide``; and the wide fingerprint's error budget.

    Trie t takes word ``t % WIDTH``, turned so that other bits come first, and
    the word after it for a second, wider look at pairs of leaves.
    """
    levels, tries, budget, second, last = layout(classes.count(), threshold, recall)
    word = lambda t: F.get("wide", F.lit(t % WIDTH))
    each = [F.struct(_rotated(word(t), levels * (t // WIDTH) % 64).alias("bits"), word(t + 1).alias("more")) for t in range(tries)]
    rows = classes.select("c", F.posexplode(F.array(*each)).alias("trie", "x")).select("c", "trie", "x.bits", "x.more")
    rows = rows.withColumn("root", F.shiftrightunsigned("bits", 64 - levels) if levels else F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for x in batches:
            if not len(x):
                continue
            now = tuple(x.column(k).to_numpy() for k in ("trie", "root", "bits", "more", "c"))
            # a subtree may go on in the next batch: its rows wait
            open_ = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            if not open_.all():
                yield found([*held, tuple(k[~open_] for k in now)])
                held = []
            elif held and (held[0][0][0], held[0][1][0]) != (now[0][0], now[1][0]):
                yield found(held)
                held = []
            held.append(tuple(k[open_] for k in now))
        if held:
            yield found(held)

    def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        trie, root, bits, more, c = (np.concatenate(k) for k in zip(*parts, strict=True))
        tree = np.cumsum(np.r_[True, (trie[1:] != trie[:-1]) | (root[1:] != root[:-1])]) - 1
        order = np.lexsort((bits.view(np.uint64), tree))
        c, tree = c[order], tree[order]
        label = joined(bits.view(np.uint64)[order], tree, np.full(len(c), 63 - levels), budget, (more.view(np.uint64)[order], second))
        least = np.full(len(c), 2**63 - 1)
        np.minimum.at(least, label, c)
        u = least[label]
        some = u != c
        return pa.RecordBatch.from_arrays([pa.array(u[some]), pa.array(c[some])], ["u", "v"])

    dealt = rows.repartition("trie", "root").sortWithinPartitions("trie", "root")
    return arrow_map(dealt, run, "u long, v long").distinct(), last


def _sets(members: DataFrame, words: int) -> DataFrame:
    """``comp, n, c, wide, set``: the shingles of rows ``comp, n, c, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for x in batches:
            sets = [shingle_set(t.as_py(), words) for t in x.column("text")]
            arrays = [pa.array([wide_print(h).view(np.int64) for h in sets], kind), pa.array([h.view(np.int64) for h in sets], kind)]
            yield pa.RecordBatch.from_arrays([x.column("comp"), x.column("n"), x.column("c"), *arrays], ["comp", "n", "c", "wide", "set"])

    return arrow_map(members, run, "comp long, n long, c long, wide array<long>, set array<long>")


def decide(sets: list[np.ndarray], label: np.ndarray, threshold: float) -> np.ndarray:
    """Labels after linking all pairs of sets (sorted, without repeats) that reach the threshold; the sets' labels before.

    A set in turn is compared with all others, by postings. Once all sets
    outside one group had their turn, every pair of different groups was
    compared; so sets of the smallest group come first.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    if n == 2:
        same = len(np.intersect1d(*sets, assume_unique=True))
        return np.full(2, label.min()) if same >= threshold * (sizes.sum() - same) - 1e-9 else label
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    posted, ends = owner[order], np.cumsum(np.bincount(code))
    starts, first = np.r_[0, ends[:-1]], np.r_[0, np.cumsum(sizes)]
    label, open_ = label.copy(), np.ones(n, bool)
    while len(np.unique(label[open_])) > 1:
        held = np.unique(label, return_inverse=True, return_counts=True)
        i = int(np.argmin(np.where(open_, held[2][held[1]], n + 1)))
        own = code[first[i] : first[i + 1]]
        times = ends[own] - starts[own]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[own], times)
        same = np.bincount(posted[at], minlength=n)
        near = np.unique(label[same >= threshold * (sizes[i] + sizes - same) - 1e-9])
        label[np.isin(label, near)] = near.min()
        open_[i] = False
    return label


def _in_one_task(rows: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` by ``comp, c, set``; each component is decided by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            if not len(x):
                continue
            comp = x.column("comp").to_numpy()
            last = int(np.searchsorted(comp, comp[-1]))  # a component may go on in the next batch
            if held and held[0].column("comp")[0].as_py() != comp[0]:
                yield from found(held)
                held = []
            if last:
                yield from found([*held, x.slice(0, last)])
                held = []
            held.append(x.slice(last))
        if held:
            yield from found(held)

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        comp, c, sets = rows["comp"].to_numpy(), rows["c"].to_numpy(), rows["set"].chunk(0)
        flat, at = sets.flatten().to_numpy(), np.r_[0, np.cumsum(np.array(sets.value_lengths()))]
        edges = np.r_[0, np.flatnonzero(np.diff(comp)) + 1, len(comp)].tolist()
        nodes, tops = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            # rows of one id are one node from the start
            ids, label = np.unique(c[a:b], return_inverse=True)
            if len(ids) > 1:
                label = decide([flat[at[i] : at[i + 1]].view(np.uint64) for i in range(a, b)], label, threshold)
                of = dict(zip(c[a:b].tolist(), label.tolist(), strict=True))
                least: dict[int, int] = {}
                for d, k in of.items():
                    least[k] = min(d, least.get(k, d))
                nodes += of
                tops += [least[k] for k in of.values()]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tops, pa.int64())], ["node", "component"])

    return arrow_map(rows.select("comp", "c", "set").repartition("comp").sortWithinPartitions("comp"), run, "node long, component long")


def _by_rounds(members: DataFrame, threshold: float, budget: int) -> DataFrame:
    """The same by ``comp, n, c, wide, set`` for components of any size.

    Each class is a pivot in one round and meets the classes whose round isn't
    over yet; a component's first round has about ``PIVOTS`` pivots, each next
    one four times as many, so large groups grow together before most pairs
    come up. Pivots go to every salt of their component, other classes to one.
    """
    n = F.col("n")
    place = F.pmod(F.xxhash64("c"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * n
    turn = F.when(place < PIVOTS, 0).otherwise(F.floor(F.log2(place / PIVOTS) / 2) + 1).cast("int")
    salts = F.ceil(n / SALTED).cast("int")
    rows = cut(members.select("comp", "c", "wide", "set", turn.alias("round"), salts.alias("salts"), F.pmod(F.xxhash64("c", F.lit(1)), salts).cast("int").alias("salt")))
    who = cut(rows.groupBy("c", "comp", "round").agg(F.first("c").alias("g")))
    for k in range((rows.agg(F.max("round")).first()[0] or 0) + 1):
        left = who.where(F.col("round") >= k)
        open_ = left.groupBy("comp").agg((F.min("g") < F.max("g")).alias("open")).where("open").select("comp")
        now = cut(left.join(open_, "comp", "left_semi").select("c", "g"))
        if now.isEmpty():
            break
        some = rows.join(now, "c")
        pivots = some.where(F.col("round") == k).select("comp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.struct("c", "g", "wide", "set").alias("p"))
        apart = sum((F.bit_count(F.get("wide", F.lit(i)).bitwiseXOR(F.get("p.wide", F.lit(i)))) for i in range(WIDTH)), F.lit(0))
        due = (F.col("round") > k) | (F.col("p.c") < F.col("c"))
        pairs = some.join(pivots, ["comp", "salt"]).where((F.col("g") != F.col("p.g")) & due & (apart <= budget))
        shared = F.size(F.array_intersect("set", "p.set"))
        alike = shared >= F.lit(threshold) * (F.size("set") + F.size("p.set") - shared) - 1e-9
        found = cut(pairs.where(alike).select(F.col("p.g").alias("u"), F.col("g").alias("v")).distinct())
        if not found.isEmpty():
            moved = connected_components(found).select(F.col("node").alias("g"), "component")
            who = cut(who.join(moved, "g", "left").select("c", "comp", "round", F.coalesce("component", "g").alias("g")))
    return who.select(F.col("c").alias("node"), F.col("g").alias("component")).distinct()


def alike_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = RECALL, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: the smallest doc_id reachable over pairs whose Jaccard likeness is at least ``threshold``.

    No pair below the threshold is linked; one at the threshold is missed with
    a chance of about ``1 - recall``, one above it with less. Equal sets are
    alike, empty ones (null, empty and white texts) too. Rows without an id
    are left out. Rows that repeat an id are in a group if any of them is. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    signed = cut(signatures(docs, words))
    classes = cut(signed.groupBy("digest").agg(F.min("doc_id").alias("c"), F.first("n").alias("n"), F.first("wide").alias("wide")))
    links, budget = candidates(classes.where("wide is not null"), threshold, recall)
    near = connected_components(links).join(classes.groupBy(F.col("c").alias("node")).agg(F.sum("n").alias("hashes")), "node")
    near = cut(near.select(F.col("node").alias("c"), F.col("component").alias("comp"), "hashes"))
    sizes = near.groupBy("comp").agg(F.count("*").alias("n"), F.sum("hashes").alias("all"))
    near = cut(near.join(sizes, "comp").select("c", "comp", "n", "all"))
    few = near.count() <= most_broadcast
    members = docs.join(F.broadcast(near) if few else near, F.col("doc_id") == F.col("c")).select("comp", "n", "c", "text", "all")
    groups = _in_one_task(_sets(members.where(F.col("all") <= BOUND).drop("all"), words), threshold)
    if not near.where(F.col("all") > BOUND).isEmpty():
        groups = groups.unionByName(_by_rounds(_sets(members.where(F.col("all") > BOUND).drop("all"), words), threshold, budget))
    of_class = classes.join(groups, F.col("c") == F.col("node"), "left").select("digest", F.coalesce("component", "c").alias("component_id"))
    return signed.select("doc_id", "digest").join(of_class, "digest").select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = RECALL, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Of each of :func:`alike_groups` the row with the smallest doc_id, with all its columns; rows without one stay.

    Of rows that repeat an id, one stays, if any of them is its group's
    smallest. Ids are broadcast if there are at most ``most_broadcast`` of
    them (8 bytes each), else texts are shuffled by id. An empty table gives
    no rows; columns may have any names.
    """
    return keep_smallest(docs, alike_groups(docs, doc_id, text, words, threshold, recall, most_broadcast), doc_id, most_broadcast)
