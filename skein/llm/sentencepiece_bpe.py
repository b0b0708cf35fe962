"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a batch of texts that weren't seen before are laid out as one
flat array of symbols. In each round every word finds the pair of neighbours
of the best rank (a segmented minimum), merges that pair wherever it stands,
from the left and without overlap, and the array is compacted; it ends when no
word has a pair left. Texts are then put together from their words' ids.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

#: The library's space sign (fixed value).
SPACE = "▁"
#: Words that a worker keeps, the longest kept, texts that are encoded at once.
MOST, LONGEST, TEXTS = 400_000, 40, 500
NO_RANK = np.iinfo(np.int32).max

#: The library writes U+FFFD for each byte that isn't UTF-8.
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceCodec:
    """``encode(texts)`` and ``decode(ids)`` as the sentencepiece library does them, without begin or end ids, no sampling.

    The library reads the model file's pieces, scores and kinds; merging is
    done here. Only models that leave text as it is (identity normaliser, a
    space put before it, byte fallback) are supported; others raise.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if [sp.decode(sp.encode(t)) for t in ("  a  b ", "ﬁ\t\x00", "é")] != ["  a  b ", "ﬁ\t\x00", "é"] or sp.id_to_piece(sp.encode("a")[0]) != SPACE + "a":
            raise ValueError(f"{path}: not an identity model with a leading space and byte fallback")
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(sp.is_unused(i) for i in range(n)) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError(f"{path}: unused pieces, or pieces over word ends, are not supported")
        self.size = n
        bytes_at = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_ids = np.array([bytes_at[b] for b in range(256)], np.int32)
        # ranks: equal scores have equal ranks, the leftmost pair goes first then
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.zeros(n, np.int32)
        rank[:] = np.searchsorted(np.unique(-scores), -scores)
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, whole = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        keys = left * n + right
        order = np.argsort(keys)
        self.keys, self.whole, self.ranks = keys[order], whole[order].astype(np.int32), rank[whole[order]]
        # All places of a pair may merge in one round if no pair that this makes has a rank as good: else only the leftmost
        self.safe = np.ones(n, bool)
        for part in (left, right):
            early = rank[whole] <= rank[part]
            self.safe[part[early]] = False
        self.text_of = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.byte_of = np.full(n, -1, np.int16)
        self.byte_of[self.byte_ids] = np.arange(256)
        for b, i in bytes_at.items():
            self.text_of[i] = bytes([b])
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.seen: dict[str, bytes] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; NO_RANK where they make no piece."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.whole[at], -1)

    def _merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed int32."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        different, back = np.unique(chars, return_inverse=True)
        # characters without a piece are negative and never merge
        of_char = np.array([self.ids.get(chr(c), -1 - int(c)) for c in different], np.int32)
        sym, word = of_char[back], np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, whole = self._pair(sym[:-1], sym[1:]) if len(sym) > 1 else (np.empty(0, np.int32), np.empty(0, np.int32))
        rank, whole = np.r_[rank, NO_RANK].astype(np.int32), np.r_[whole, -1].astype(np.int32)
        rank[np.flatnonzero(word[1:] != word[:-1])] = NO_RANK
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_RANK
            if over.any():
                # words without a pair are finished and leave the array
                gone = np.repeat(over, np.diff(np.r_[starts, len(sym)]))
                done.append((word[gone], sym[gone]))
                sym, word, rank, whole = (x[~gone] for x in (sym, word, rank, whole))
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                best = best[~over]
            per = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sym)]))
            at = np.flatnonzero(rank == best[per])
            # the leftmost place of the best rank tells the word's pair; other pieces of equal rank wait
            first = np.r_[True, per[at][1:] != per[at][:-1]]
            piece = whole[at[first]][np.cumsum(first) - 1]
            same = (whole[at] == piece) & (first | self.safe[piece])
            at = at[same]
            # places that follow each other overlap: of such a run every second one merges
            run = np.r_[True, np.diff(at) != 1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = whole[at]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            moved = np.cumsum(kept) - 1
            sym, word, rank, whole = (x[kept] for x in (sym, word, rank, whole))
            at = moved[at]
            # only pairs with a new symbol change
            for left in (at, at[at > 0] - 1):
                left = left[left < len(sym) - 1]
                r, w = self._pair(sym[left], sym[left + 1])
                apart = word[left] != word[left + 1]
                rank[left], whole[left] = np.where(apart, NO_RANK, r), np.where(apart, -1, w)
            if len(sym):
                rank[-1], whole[-1] = NO_RANK, -1
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        sym, word = self._bytes(sym[order], word[order])
        data, ends = sym.astype(np.int32).tobytes(), (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        return list(map(data.__getitem__, map(slice, ends, ends[1:])))

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by the ids of their UTF-8 bytes."""
        at = np.flatnonzero(sym < 0)
        if not len(at):
            return sym, word
        different, back = np.unique(sym[at], return_inverse=True)
        raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in different.tolist()]
        times = np.ones(len(sym), np.int64)
        times[at] = np.array([len(b) for b in raw])[back]
        out, begin = np.repeat(sym, times), np.cumsum(times) - times
        for k in range(4):
            some = times[at] > k
            kth = np.array([b[k] if k < len(b) else 0 for b in raw])
            out[begin[at[some]] + k] = self.byte_ids[kth[back[some]]]
        return out, np.repeat(word, times)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > MOST:
            self.seen.clear()
        new = list(set().union(*cut).difference(self.seen))
        if new:
            self.seen.update(zip(new, self._merge(new), strict=True))
        get = self.seen.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]
        for w in new:
            if len(w) > LONGEST:
                del self.seen[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that was put before it goes, bytes that aren't UTF-8 become U+FFFD."""
        data = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        if len(ids) and self.byte_of[ids[0]] < 0 and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "each-byte")


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text.

    A null text is empty and has no ids. Repeated rows and null ids stay. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for x in batches:
            for i in range(0, len(x), TEXTS):
                some = x.slice(i, TEXTS)
                ids = own.encode([t or "" for t in some.column("text").to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The given columns and ``out``: the text of each row's ids (null ids: empty).

    A column that is named like ``out`` already is replaced. Repeated rows
    stay; an empty table gives no rows. A text of any length is one row's.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() == out.lower() and c != ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for x in batches:
            at = x.schema.get_field_index(ids)
            for i in range(0, len(x), TEXTS):
                some = x.slice(i, TEXTS)
                col = some.column(at)
                flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
                texts = [own.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, out])

    schema = T.StructType([*rows.schema, T.StructField(out, T.StringType())])
    return arrow_map(rows, run, schema)
