"""Secret scans: patterns, then corpus-wide ownership of what they find.

The base patterns give spans that stay. What they found, and besides every
long mixed run of letters and digits that none of them has, is a candidate:
the hash of its value is counted over the whole corpus by distinct owners and
repositories. A value of few owners and few repositories looks like a live
credential; one that many have is a widely copied example. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Kinds in order, pattern, group that is measured, its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (Of ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` a match ends where its run of characters ends, so that
#: dropping the short ones is the same as asking for the length in the pattern; of assign it isn't.)
KINDS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: A candidate: so many characters of a token's alphabet, a letter and a digit among them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: A value that more owners, or more repositories, than these have is a copied example.
MOST_OWNERS, MOST_REPOS = 1, 3
#: Parts that the rows of one hash are dealt to, when they meet its counts.
SALTS = 16

_SPANS = "array<struct<start:int,kind:int,end:int,hash:bigint>>"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int, quick: str) -> Column:
    """The pattern's matches, leftmost and not overlapping, whose group is long enough: (start, kind, end, hash of the group).

    Matches and the pieces between them alternate, so their lengths (in code
    points) add up to the positions. quick: a cheap test that a match needs.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern).alias("piece"), whole.alias("whole"), part.alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("spans"))

    def step(a: Column, r: Column) -> Column:
        start = a["at"] + F.length(r["piece"])
        end = start + F.coalesce(F.length(r["whole"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(r["part"]).alias("hash")))
        return F.struct(end.alias("at"), F.when(F.length(r["part"]) >= least, F.concat(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

    return F.when(text.rlike(quick), F.aggregate(rows, zero, step)["spans"]).otherwise(F.expr(f"cast(array() as {_SPANS})"))


#: What a text with any candidate has: the cheap tests of :func:`_found`.
_QUICK = {"assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}"}
_ANY = "|".join(f"(?:{p})" for p in (*_QUICK.values(), CANDIDATE))
_NONE = f"cast(array() as {_SPANS})"


def _found(text: Column) -> Column:
    """All candidates of a text by start and kind: the base spans, and mixed tokens (kind 3) that overlap none."""
    base = F.concat(*[_spans(text, k, p, g, n, _QUICK[kind]) for k, (kind, p, g, n) in enumerate(KINDS)])
    mixed = F.filter(_spans(text, len(KINDS), CANDIDATE, 0, 20, CANDIDATE), lambda s: _mixed(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    # a mixed token that touches a base span is left out when the two are put together
    return F.struct(F.sort_array(base).alias("base"), mixed.alias("mixed"))


def _candidates(found: Column) -> Column:
    free = F.filter(found["mixed"], lambda c: ~F.exists(found["base"], lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return F.sort_array(F.concat(found["base"], free))


def _judged(rows: DataFrame, most_owners: int, most_repos: int) -> DataFrame:
    """``rid, spans`` of :func:`_owned` rows that have a candidate: (start, kind, end, hash, n_owners, n_repos, live), ordered."""
    one = rows.select("rid", "owner", "repo", F.explode("found").alias("c"))
    # two levels: a hash that a third of the rows have is combined by owner before it meets
    held = one.groupBy(F.col("c.hash").alias("hash"), "owner", "repo").agg(F.count("*").alias("n"))
    counts = held.groupBy("hash").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    counts = counts.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = one.select("rid", "c", F.col("c.hash").alias("hash"), F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["hash", "salt"])
    return told.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("c.start", "c.kind", "c.end", "c.hash", "n_owners", "n_repos", "live"))).alias("spans"))


def _owned(docs: DataFrame, text: str, owner: str, repository: tuple[str, ...]) -> list[Column]:
    """The columns owner and repo; a null counts as one of its own."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\1"))
    return [of(owner).alias("owner"), F.concat_ws("\0", *map(of, repository)).alias("repo")]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """``doc_id, spans``: for every row its candidates, ordered by start and kind.

    spans: array of (start, kind, end, hash, n_owners, n_repos, live). kind: as
    in KINDS, whose spans are the base spans, or 3 for a mixed token. hash: of
    the value (assign: what is assigned). live: at most ``most_owners`` owners
    and ``most_repos`` repositories have the value; else it is a copied
    example. Positions are code points, end exclusive. A null text is empty; a
    null owner or repository counts as one of its own. Repeated rows and null
    ids stay, each with its own spans. An empty table gives no rows. Other
    columns are ignored, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), *_owned(docs, text, owner, repository), _found(t).alias("found"))
    rows = cut(rows.withColumn("found", _candidates(F.col("found"))))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,hash:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>)")
    judged = _judged(rows.where(F.size("found") > 0), most_owners, most_repos)
    return rows.select("rid", "doc_id").join(judged, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _mixed(token: Column) -> Column:
    """Letters and digits both, and more than a few kinds of character: a random key rather than a word or a rule of dashes."""
    return token.rlike("[0-9].*[0-9]") & token.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(token, ""))) >= 8)


def redact(
    docs: DataFrame,
    text: str = "text",
    mark: str = "[SECRET]",
    example: str = "[EXAMPLE]",
    n_chars: str | None = None,
    owner: str = "source",
    repository: tuple[str, ...] = ("source", "lang"),
    most_owners: int = MOST_OWNERS,
    most_repos: int = MOST_REPOS,
) -> DataFrame:
    """``docs`` with every live value's span replaced by ``mark``, and every base span of a copied example by ``example``.

    n_chars: a column that is to hold the length of each changed text. Rows
    that overlap no candidate stay as they are and where they are; the others
    are written with their spans, told apart by a number of their own, so ids
    don't matter: null and repeated ones keep each row's own spans, and as many
    rows come out as went in. Copied mixed tokens stay in the text. Of spans
    that overlap, the first is replaced and what the others have beyond it goes
    with it. A null text stays null. An empty table gives no rows. The table's
    other columns stay, whatever their names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    suspect = t.rlike(_ANY)
    row, kind = fresh(docs, "row"), docs.schema[text].dataType
    some = docs.where(suspect).select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(c) for c in docs.columns]).alias(row), *_owned(docs, text, owner, repository), _found(t).alias("found"))
    some = cut(some.withColumn("found", _candidates(F.col("found"))))
    judged = _judged(some.where(F.size("found") > 0).select("rid", "owner", "repo", "found"), most_owners, most_repos)
    both = some.select("rid", row).join(judged, "rid", "left")
    old = F.col(row)[text]
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    # where spans overlap, the text goes on behind the one that ends last
    step = lambda a, s: F.struct(
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(old, a["at"] + 1, s["start"] - a["at"]), F.when(s["live"], F.lit(mark)).otherwise(F.lit(example)))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    gone = F.filter("spans", lambda s: s["live"] | (s["kind"] < len(KINDS)))
    done = F.aggregate(gone, zero, step, lambda a: F.concat(a["out"], F.substring(old, a["at"] + 1, F.lit(2**31 - 1))))
    new = fresh(docs, "new")
    both = both.withColumn(new, F.when(F.size(gone) > 0, done))
    changed = {text: F.col(new).cast(kind)} | ({n_chars: F.length(new).cast(docs.schema[n_chars].dataType)} if n_chars else {})
    out = both.select(*[F.coalesce(changed[c], F.col(row)[c]).alias(c) if c in changed else F.col(row)[c].alias(c) for c in docs.columns])
    return docs.where(~suspect).unionByName(out)
