"""SimHash fingerprints and near-duplicate groups by a binary trie self-join.

Fingerprints that differ in at most ``budget`` bits are linked. The join walks
the binary trie of the fingerprints with itself: a pair of nodes goes to the
pairs of their children, the differing bits add up, and a pair over the budget
is dropped with all below it.

So that the walk can be dealt out, the 64 bits are cut into blocks. Two
fingerprints within the budget agree in all bits of at least ``blocks -
budget`` blocks, so for each choice of that many blocks a trie is built whose
first levels are those blocks; there the walk may spend no error, hence a
subtree below them is joined with itself only and is a task's unit of work.
Only distinct fingerprints enter, each with its smallest document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, cut, fresh

#: Shingles whose bits are counted at once, and node pairs that one step of the walk expands.
BLOCK, FRONTIER = 1 << 15, 1 << 18
#: Node pairs with so few leaf pairs are compared leaf by leaf; fingerprints of a subtree, on average.
LEAVES, SUBTREE = 16, 64
#: Ids that are broadcast at most (32 MB).
MOST_BROADCAST = 4_000_000


def simhash64(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint, unsigned: a bit is 1 if it is 1 in over half of the shingles' XXH64 values.

    Words are runs without space and \\x09-\\x0D of the text with A-Z in lower
    case. Fewer words than a shingle has: one shingle of all; none, or null: 0.
    """
    from xxhash import xxh64_intdigest as xxh

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        h = np.array([xxh(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        h = np.fromiter((xxh(joined[a:b], seed) for a, b in zip((ends - sizes)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(h)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fp = np.fromiter((simhash64(t.as_py(), words) for t in x.column("text")), np.uint64, len(x))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def block_layout(distinct: int, budget: int) -> tuple[int, int]:
    """(blocks, blocks that agree): the fewest choices whose agreeing bits leave ``SUBTREE`` fingerprints or less to a subtree on average."""
    agree = 1
    while agree < 5 and distinct >> (64 * agree // (budget + agree)) > SUBTREE:
        agree += 1
    return budget + agree, agree


def _arranged(fp, blocks: int, agree: int) -> tuple[list, list[int]]:
    """For each choice of blocks: the fingerprint's bits with those blocks first (a long column), and how many bits they have."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out, heads = [], []
    for c in combinations(range(blocks), agree):
        order, at, parts = [*c, *(b for b in range(blocks) if b not in c)], 64, []
        for b in order:
            n = edges[b + 1] - edges[b]
            at -= n
            parts.append(F.shiftleft(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << n) - 1).cast("long")), at))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.bitwiseOR(p)
        out.append(whole)
        heads.append(sum(edges[b + 1] - edges[b] for b in c))
    return out, heads


def joined(values: np.ndarray, subtree: np.ndarray, bit: np.ndarray, budget: int, more: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Walk the subtrees' pairs of nodes. values: sorted within each subtree; bit: the subtree's first free bit.

    more: further bits of each value, and the budget of both together, asked
    of pairs of leaves. Returns for each value the index of a value that it is linked with, over
    any number of links; itself for the first of a group.
    """
    n = len(values)
    label = np.arange(n)
    cuts = np.flatnonzero(np.r_[True, subtree[1:] != subtree[:-1]])
    ends = np.r_[cuts[1:], n]
    some = ends - cuts > 1
    lo, hi = cuts[some], ends[some]
    if not len(lo):
        return label
    changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
    ones: dict[int, np.ndarray] = {}
    first = bit[lo]
    stack = [(b, lo[first == b], hi[first == b], lo[first == b], hi[first == b], np.zeros((first == b).sum(), np.int8)) for b in np.unique(first)]
    while stack:
        b, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(b, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]), (b, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half])]
            continue
        # a pair of nodes that is linked already, whole with whole, can add nothing
        new = ~((changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo]))
        alo, ahi, blo, bhi, err = (x[new] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        pairs = (ahi - alo) * (bhi - blo)
        few = (pairs <= LEAVES) | (b < 0)
        if few.any():
            a, c, times = alo[few], blo[few], pairs[few]
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            wide = np.repeat(bhi[few] - c, times)
            i, j = np.repeat(a, times) + at // wide, np.repeat(c, times) + at % wide
            apart = np.bitwise_count(values[i] ^ values[j])
            near = (i < j) & (apart <= budget)
            if more is not None:
                near &= apart + np.bitwise_count(more[0][i] ^ more[0][j]) <= more[1]
            if near.any():
                _link(label, i[near], j[near])
                changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        many = ~few
        if not many.any():
            continue
        alo, ahi, blo, bhi, err = (x[many] for x in (alo, ahi, blo, bhi, err))
        if b not in ones:
            ones[b] = np.r_[0, np.cumsum((values >> np.uint64(b)) & np.uint64(1)).astype(np.int64)]
        k = ones[b]
        am, bm = ahi - (k[ahi] - k[alo]), bhi - (k[bhi] - k[blo])
        other = alo != blo
        grown = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), tuple(x[other] for x in (am, ahi, blo, bm, err + 1))]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*grown, strict=True))
        kept = (ahi > alo) & (bhi > blo) & (err <= budget)
        stack.append((b - 1, alo[kept], ahi[kept], blo[kept], bhi[kept], err[kept]))
    return label


def _link(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put i and j into one group, in place; the label of a group is its smallest index."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def trie_links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """``u, v``: links between documents, one column ``fp`` (distinct) and one ``doc_id`` given.

    Each subtree returns a spanning forest of its links instead of all of
    them, so the groups are those of all links, and a group of any size costs
    no more rows than it has members in each arrangement.
    """
    prints = cut(prints.select("fp", "doc_id"))
    blocks, agree = block_layout(prints.count(), budget)
    arranged, heads = _arranged(F.col("fp"), blocks, agree)
    rows = prints.select("doc_id", F.posexplode(F.array(*arranged)).alias("choice", "bits"))
    head = F.get(F.array(*[F.lit(h) for h in heads]), F.col("choice"))
    rows = rows.withColumn("root", _top(F.col("bits"), head))
    heads_of = np.array(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []
        for x in batches:
            if not len(x):
                continue
            now = tuple(x.column(c).to_numpy() for c in ("choice", "root", "bits", "doc_id"))
            # a subtree may go on in the next batch: hold the last one back
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            if not (last.all() and rest and (rest[0][0][0], rest[0][1][0]) == (now[0][0], now[1][0])):
                yield found([*rest, tuple(c[~last] for c in now)])
                rest = []
            rest.append(tuple(c[last] for c in now))
        if rest:
            yield found(rest)

    def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        choice, root, bits, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        bits = bits.view(np.uint64)
        tree = np.cumsum(np.r_[True, (choice[1:] != choice[:-1]) | (root[1:] != root[:-1])][: len(choice)]) - 1
        # the order within a subtree is that of the unsigned bits
        order = np.lexsort((bits, tree))
        label = joined(bits[order], tree[order], 63 - heads_of[choice[order]], budget)
        linked = np.flatnonzero(label != np.arange(len(label)))
        doc = doc[order]
        return pa.RecordBatch.from_arrays([pa.array(doc[linked]), pa.array(doc[label[linked]])], ["u", "v"])

    dealt = rows.repartition("choice", "root").sortWithinPartitions("choice", "root")
    return arrow_map(dealt, run, "u long, v long").distinct()


def _top(bits, head):
    """The first ``head`` of the 64 bits."""
    return F.call_function("shiftrightunsigned", bits, F.lit(64) - head)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the fingerprint, and the smallest doc_id reachable over links.

    A null or empty text, or one of white space, has fingerprint 0 and is
    linked like any other. Repeated rows stay, each with its group. A null
    doc_id gets the group of its fingerprint. An empty table gives no rows.
    Other columns of the input are ignored, whatever their names.
    """
    prints = cut(fingerprints(docs, doc_id, text, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    groups = connected_components(trie_links(distinct.where("doc_id is not null"), budget))
    of_print = distinct.join(groups, F.col("doc_id") == F.col("node"), "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, budget: int = 4, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id, with all its columns.

    Rows without a doc_id stay: nothing tells them apart. Of rows that repeat
    an id, one stays, if any of them is its group's smallest. The ids that go
    are broadcast if there are at most ``most_broadcast`` of them (8 bytes
    each), so that no text is shuffled; more are joined by a shuffle. An empty
    table gives no rows; columns may have any names.
    """
    return keep_smallest(docs, near_duplicates(docs, doc_id, text, words, budget).where("doc_id is not null"), doc_id, most_broadcast)


def keep_smallest(docs: DataFrame, groups: DataFrame, doc_id: str, most_broadcast: int) -> DataFrame:
    """The rows of ``docs`` whose id is its group's smallest, by ``doc_id, component_id``, and those without an id."""
    ids, name = cut(groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))), fresh(docs, "gone")
    n_gone, repeats = ids.agg(F.count_if(~F.col("stays")), F.count_if(F.col("n") > 1)).first()
    gone = ids.where("not stays").select(F.col("doc_id").alias(name))
    out = docs.join(F.broadcast(gone) if n_gone <= most_broadcast else gone, F.col(doc_id) == F.col(name), "left_anti")
    if not repeats:
        return out
    return out.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]).unionByName(out.where(F.col(doc_id).isNull()))
