"""Runs (maximal periodicities) of a text's words by Kolpakov and Kucherov's method.

The words' suffix automaton gives the Lempel-Ziv factorisation. A run that crosses or touches a border between factors is found by
Main's comparison of both sides of the border; a run strictly inside a factor is a copy of one in the factor's earlier
occurrence. Only runs of an exponent of four or more are wanted, which shortens the stretches that a border compares.

The method works on islands: stretches outside of which no such run can lie. In a run of period q every four words behind the
first q repeat at distance q, and so repeat at distance 2 ** k or less for 3 * q - 3 places in a row, where q is in
(2 ** (k - 1), 2 ** k]. Stretches of that kind, found for all k from each place's distance to its last equal, are widened by 2 ** k to the left and
by four to the right and joined. Islands lose no run and don't shorten one; hash collisions could only add to them.

Documents are independent, so nothing is shuffled; memory follows the longest text, and in it the longest island
(about 0.6 KB for each of its words).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smallest exponent and length of a run; words of an island's evidence; words that are searched for islands at once.
EXPONENT, LEAST, GRAM, CHUNK = 4, 6, 4, 1 << 16


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, length, start of an earlier occurrence, -1 for a new word), from the suffix automaton of w."""
    link, size, to, first, last = [-1], [0], [{}], [-1], 0
    for i, c in enumerate(w):
        now = len(size)
        size.append(i + 1)
        first.append(i)
        to.append({})
        link.append(0)
        p = last
        while p != -1 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p != -1:
            q = to[p][c]
            if size[q] != size[p] + 1:  # split off the state's shorter words
                size.append(size[p] + 1)
                first.append(first[q])
                to.append(to[q].copy())
                link.append(link[q])
                short = link[q] = now + 1
                while p != -1 and to[p].get(c) == q:
                    to[p][c] = short
                    p = link[p]
                q = short
            link[now] = q
        last = now
    out, i, n = [], 0, len(w)
    while i < n:
        state = k = 0
        while i + k < n:
            after = to[state].get(w[i + k])
            if after is None or first[after] - k >= i:
                break
            state, k = after, k + 1
        out.append((i, max(k, 1), first[state] - k + 1 if k else -1))
        i += max(k, 1)
    return out


def prefixes(x: list[int]) -> list[int]:
    """For each place the length of the longest stretch that is also a prefix of x."""
    n = len(x)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of w, by start and period."""
    n, found, at = len(w), {}, defaultdict(list)
    if n < LEAST:
        return []

    def keep(s: int, e: int, p: int) -> None:
        if e - s >= max(LEAST, EXPONENT * p) and not (s and w[s - 1] == w[s - 1 + p]) and not (e < n and w[e] == w[e - p]) and found.get((s, e), n) > p:
            if (s, e) not in found:
                at[s].append(e)
            found[s, e] = p

    f = factors(w)
    for i in range(1, len(f) + 1):
        b, size, source = f[i] if i < len(f) else (n, 0, -1)
        before = f[i - 1][1]
        most = (size + before - 1) // (EXPONENT - 1)
        if most and size + before + most >= LEAST:
            left, right = w[max(0, b - before - most) : b], w[b : b + size]
            back, ahead = left[::-1], right[:most]
            nu, nv = len(left), len(right)
            # a period lies right of the border: compare b with b + p
            z, y = prefixes(right), prefixes(back + [-1] + ahead[::-1] + back)
            for p in range(1, min(most, nv) + 1):
                keep(b - y[nu + 1 + len(ahead) - p], b + p + (z[p] if p < nv else 0), p)
            # a period lies left of it: compare b - p with b
            close = left[-most:]
            z, y = prefixes(right + [-1] + close + right), prefixes(back)
            for p in range(1, min(most, nu) + 1):
                keep(b - p - (y[p] if p < nu else 0), b + z[nv + 1 + len(close) - p] if nv else b, p)
        if source >= 0 and at:
            for s in range(source + 1, source + size):  # ascending: the occurrence may overlap the factor
                for e in at.get(s, ()):
                    if e < source + size and (s + b - source, e + b - source) not in found:
                        found[s + b - source, e + b - source] = found[s, e]
                        at[s + b - source].append(e + b - source)
    return sorted((s, e, p) for (s, e), p in found.items())


def islands(ids: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Word numbers, distinct between texts, with n + 1 offsets -> disjoint (begin, end) that hold every run whole."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    x = ids.astype(np.uint64)
    g = sum(x[k : n + k] * np.uint64(odd) for k, odd in enumerate((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)))
    order = np.argsort(g, kind="stable")
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    here, gap = order[same + 1], order[same + 1] - order[same]
    up = np.argsort(here)
    here, gap = here[up], gap[up]
    found, k = [], 0
    while len(here):
        q = (1 << k - 1) + 1 if k else 1
        need = max(LEAST - 1, (EXPONENT - 1) * q) - GRAM + 1
        p = here[gap <= 1 << k]
        cut = np.flatnonzero(np.diff(p) > 1) + 1
        first, last = p[np.append(0, cut)] if len(p) else p, p[np.append(cut - 1, len(p) - 1)] if len(p) else p
        long = last - first + 1 >= need
        found += zip((first[long] - (1 << k)).tolist(), (last[long] + GRAM).tolist(), strict=True)
        if need > len(here):
            break
        k += 1
    out = []
    begin = at[np.searchsorted(at, [b - 1 for _, b in found], "right") - 1].tolist() if found else []
    for a, b in sorted((max(a, t), b) for (a, b), t in zip(found, begin, strict=True)):  # none reaches before its text
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth document (by its id's checksum) with a stretch that repeats up to the end; a null id changes nothing."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * ((n - a) // p + 1))[:n]


def _row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = (None, None, None)
    for s, e, p in found:
        if best[0] is None or (e - s) * best[2] > best[1] * p:
            best = (s, e - s, p)
    if found:
        gone = np.zeros(len(words), bool)
        for s, e, p in found:
            gone[s + p : e] = True
        words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
    listed = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
    return len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def _rows(docs: list[list[bytes]]) -> Iterator[tuple]:
    """A result row for each list of words."""
    at = np.cumsum([0, *map(len, docs)])
    ids = np.empty(int(at[-1]), np.int64)
    for i, words in enumerate(docs):
        number = dict(zip(words, range(int(at[i]), int(at[i + 1])), strict=True))
        ids[at[i] : at[i + 1]] = list(map(number.__getitem__, words))
    found = defaultdict(list)
    for a, b in islands(ids, at):
        i = int(np.searchsorted(at, a, "right")) - 1
        found[i] += [(s + a - int(at[i]), e + a - int(at[i]), p) for s, e, p in runs(ids[a:b].tolist())]
    for i, words in enumerate(docs):
        yield _row(words, sorted(found.get(i, ())))


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def some(ids: list, held: list[list[bytes]]) -> pa.RecordBatch:
        columns = zip(*((i, *r) for i, r in zip(ids, _rows(held), strict=True)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    for b in batches:
        ids, held, n = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            ids.append(i)
            held.append(rewritten((t.as_py() or b"").split(), i))  # splits at 0x20 and 0x09-0x0D
            n += len(held[-1])
            if n >= CHUNK:
                yield some(ids, held)
                ids, held, n = [], [], 0
        if ids:
            yield some(ids, held)


def word_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the runs of the words of each text and the text without their repetitions, one row for each row.

    n_runs, the run of the greatest exponent (start, length, period, exponent_milli; nulls without a run; ties: smallest start, then
    period), the SHA-256 of all runs and of the words that stay, joined by one space: words of a run behind its first period go.
    Null and empty texts have no words. Rows that repeat a doc_id are looked at one by one; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_collapsed, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
