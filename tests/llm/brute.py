"""Plain Python versions of the contracts, row by row and without any of the operators' code."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def chats(turns: list[tuple]) -> dict:
    """conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        out[conv] = (len(rows), sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(loss), sha(loss))
    return out


def simhash(text: str | None, words: int = 4) -> int:
    from xxhash import xxh64_intdigest

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints: dict[int, int], budget: int = 4) -> dict[int, int]:
    """Smallest id reachable, by comparing all pairs of fingerprints."""
    import numpy as np

    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(prints)
    v = np.array([prints[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= budget):
            a, b = sorted((find(d), find(ids[i + 1 + j])))
            root[b] = a
    return {d: find(d) for d in ids}


def base_quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


KINDS = (
    ("assign", re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end), ordered."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= n)


def edited(texts: list[str]) -> list[str]:
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 4
        out.append(t[: len(t) - k] + texts[(i + 1) % len(texts)][:k])
    return out


def jaccard(a: str, b: str, words: int = 5) -> float:
    def of(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def url(u: str | None) -> tuple[str, str]:
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def crc(ids) -> int:
    import struct

    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
