"""Document fingerprints: one-permutation MinHash with optimal densification.

Each shingle is hashed once; the hash's low bits choose one of 256 bins, the
rest is the value, and a bin keeps its smallest. An empty bin copies a full
one, which it finds by its own pseudo-random walk over all bins (the same walk
for every document). Of each bin 8 bits are stored, packed into 32 longs.
Everything is a DataFrame expression: no shuffle, no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_RE, const_array, fresh

#: Bins (2**8), bits stored of each, words of a shingle.
BINS, BITS, WORDS = 256, 8, 5
#: Walk steps taken by all empty bins at once before the rest is searched.
ROUNDS = 4


def _mix(x: int) -> int:
    """A fixed 64-bit mixer (splitmix64's finaliser)."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


#: Bin i looks at bins (first + t * step) mod BINS, t = 0, 1, ...; an odd step reaches every bin.
FIRST = [_mix(2 * i) % BINS for i in range(BINS)]
STEP = [_mix(2 * i + 1) % BINS | 1 for i in range(BINS)]
#: t of bin j on bin i's walk is (j - first) * inverse mod BINS.
INVERSE = [pow(s, -1, BINS) for s in STEP]


def sketch(rows: DataFrame, text: str, out: str, words: int = WORDS) -> DataFrame:
    """Add ``out``: the packed fingerprint (32 longs) of the column ``text``, null for a text without words.

    Words are runs without space and \\x09-\\x0D. Fewer words than a shingle
    has: one shingle of all. Equal texts have equal fingerprints; repeated
    rows stay, an empty table gives no rows. A column that is named like
    ``out`` already is replaced; all others stay, whatever their names.
    """
    a, b, c, d = (fresh(rows, f"{out}_{x}") for x in "abcd")
    found = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE_RE), lambda w: w != "")
    rows = rows.withColumn(a, F.transform(found, lambda w: F.xxhash64(w)))
    wide = F.transform(F.sequence(F.lit(0), F.size(a) - words), lambda i: F.xxhash64(*[F.get(F.col(a), i + k) for k in range(words)]))
    short = F.array(F.xxhash64(F.col(a)))
    shingles = F.when(F.size(a) >= words, wide).otherwise(short)
    # a long holds the bin above the value; a last value for each bin marks where it ends (and that it is empty)
    bits = 64 - 1 - BINS.bit_length()
    packed = F.transform(shingles, lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1)), bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)))
    none = (1 << bits) - 1
    ends = const_array([(i << bits) | none for i in range(BINS)], "bigint")
    rows = rows.withColumn(b, F.when(F.size(a) > 0, F.sort_array(F.concat(packed, ends))))
    first = F.filter(b, lambda x, i: (i == 0) | (F.shiftright(F.get(b, i - 1), bits) != F.shiftright(x, bits)))
    rows = rows.withColumn(c, F.transform(first, lambda x: F.nullif(x.bitwiseAND(F.lit(none)), F.lit(none))))
    full = F.transform(F.filter(F.transform(c, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: x["v"].isNotNull()), lambda x: x["i"])
    rows = rows.withColumn(d, F.when(F.exists(c, lambda v: v.isNull()), full))
    start, step, inverse = (const_array(x, "int") for x in (FIRST, STEP, INVERSE))

    def filled(v: Column, i: Column) -> Column:
        walk = [F.get(F.col(c), (F.get(start, i) + t * F.get(step, i)).bitwiseAND(F.lit(BINS - 1))) for t in range(ROUNDS)]
        t_of = F.array_min(F.transform(d, lambda j: ((j - F.get(start, i)) * F.get(inverse, i)).bitwiseAND(F.lit(BINS - 1))))
        return F.coalesce(v, *walk, F.get(F.col(c), (F.get(start, i) + t_of * F.get(step, i)).bitwiseAND(F.lit(BINS - 1))))

    rows = rows.withColumn(c, F.when(F.col(d).isNull(), F.col(c)).otherwise(F.transform(c, filled)))

    def pack(k: Column) -> Column:
        out_of = F.lit(0).cast("long")
        for j in range(8):
            out_of = out_of.bitwiseOR(F.shiftleft(F.get(F.col(c), 8 * k + j).bitwiseAND(F.lit(2**BITS - 1)), BITS * j))
        return out_of

    return rows.withColumn(out, F.when(F.col(c).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), pack))).drop(a, b, c, d)


def as_text(packed: Column) -> Column:
    """A packed fingerprint as 512 lowercase hex digits; without words: the empty string."""
    return F.coalesce(F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    The share of equal bins, less the share that different values of 8 bits
    have in common by chance. Equal fingerprints: 1; two texts without words:
    1; one of them: 0.
    """

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for s in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, s))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    same = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x) / BINS
    chance = 2.0**-BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
