"""Periodic run detection over the words of each document (operator 11).

A run is a stretch of words with smallest period q, at least ``LEAST_WORDS``
words and ``LEAST_EXPONENT`` periods long, that neither neighbour extends.

Method, per stretch of documents inside a task:

1. Words become integers. A word of a run occurs in it once per period, so
   words that occur less than ``LEAST_EXPONENT`` times in a piece belong to no
   run of it: they cut the document into pieces, again and again. That is
   exact, and leaves little of ordinary prose.
2. Baier's grouping (phase one of the grouping suffix sorter) over the pieces,
   joined by separators, gives the Lyndon array: positions start in groups by
   word; from the highest group down, each finished position is credited to
   the nearest unfinished position on its left, which moves to a new group
   just above its own, longer by what it was credited with. When a group is
   taken, its length is the longest Lyndon word at its members. It runs once
   under the order of the integers and once under the reverse order.
3. Every run has, under one of the two orders, its period as Lyndon array at
   all its Lyndon roots. Roots are extended both ways by longest common
   extensions, found by bisection over prefix hashes (all roots at once), and
   each run is confirmed word by word; a hash collision falls back to
   comparing words.

Documents are independent, so nothing is shuffled; a lost executor repeats its
own tasks. Time is n log n in the words of a text, memory linear in one
stretch (about ``STRETCH_BYTES`` of text, or one longer document).

Nulls and edge cases: a null or empty text has no words, no runs and an empty
collapsed text. Null and repeated ids stay rows of their own. Only ``doc_id``
and ``text`` are read, so other columns may have any name. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import ship_package

LEAST_WORDS = 6
LEAST_EXPONENT = 4
#: Texts worked on together in a task; one longer document is a stretch by itself.
STRETCH_BYTES = 1 << 20
#: Cutting pieces at rare words stops after so many rounds; that only leaves more words for the next step.
CUT_ROUNDS = 12

Words = list[bytes]
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)


def lyndon_array(s: list[int]) -> list[int]:
    """Longest Lyndon word at each position, by Baier's grouping.

    ``s`` starts and ends with 0, the separator, which is the least symbol and
    gets no value; no Lyndon word crosses it."""
    n = len(s)
    found = [0] * n
    group = s[:]                       # group of each position: first its symbol, later a new number
    members: dict[int, list[int]] = {}
    for i, x in enumerate(s):
        if x in members:
            members[x].append(i)
        else:
            members[x] = [i]
    symbols = sorted(members)
    size = dict.fromkeys(symbols, 1)
    above = dict(zip(symbols, symbols[1:]))
    below = dict(zip(symbols[1:], symbols))
    fresh = symbols[-1] + 1
    left = list(range(n))              # nearest unfinished position at or before each one, with path halving
    now = symbols[-1]
    while now:
        mine = [i for i in members.pop(now) if group[i] == now]
        length = size[now]
        for i in mine:
            left[i] = i - 1
            found[i] = length
        credit: dict[int, int] = {}
        for i in mine:
            j = left[i]
            while left[j] != j:
                left[j] = j = left[left[j]]
            left[i] = j
            credit[j] = credit.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in credit.items():
            old = group[j]
            if old:
                moved.setdefault((times, old), []).append(j)
        for times, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            positions = moved[times, old]
            new, fresh = fresh, fresh + 1
            members[new] = positions
            size[new] = size[old] + times * length
            for j in positions:
                group[j] = new
            up = above[old]
            above[old], below[new], above[new], below[up] = new, old, up, new
        now = below[now]
    return found


def _cut(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run, and the piece each belongs to."""
    place, piece = np.arange(len(ids)), doc
    for _ in range(CUT_ROUNDS):
        if not len(place):
            break
        order = np.lexsort((ids[place], piece))
        p, w = piece[order], ids[place][order]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (w[1:] != w[:-1])])
        often = np.empty(len(place), bool)
        often[order] = np.repeat(np.diff(np.r_[first, len(p)]) >= LEAST_EXPONENT, np.diff(np.r_[first, len(p)]))
        kept, was = place[often], piece[often]
        if not len(kept):
            return kept, was
        starts = np.r_[True, (kept[1:] != kept[:-1] + 1) | (was[1:] != was[:-1])]
        number = np.cumsum(starts) - 1
        long_enough = (np.bincount(number) >= LEAST_WORDS)[number]
        settled = len(kept) == len(place) and long_enough.all()
        place, piece = kept[long_enough], number[long_enough]
        if settled:
            break
    return place, piece


def _common(h: np.ndarray, power: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, back: bool) -> np.ndarray:
    """Words that ``a`` and ``b`` (a < b) have in common from there on, or before them if ``back``."""
    low = np.zeros(len(a), np.int64)
    high = a.copy() if back else n - b
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        x, y = (a - mid, a) if back else (a, a + mid)
        u, v = (b - mid, b) if back else (b, b + mid)
        same = (h[y] - h[x]) * power[b - a] == h[v] - h[u]
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def _extend(x: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Start and length of the stretch of period ``q`` around place ``i``, by comparing words."""
    end = i + q
    while end < len(x) and x[end] == x[end - q]:
        end += 1
    while i and x[i - 1] == x[i - 1 + q]:
        i -= 1
    return i, end - i


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of ``x``; 0 separates pieces and is at both ends."""
    n, top = len(x), int(x.max()) + 1
    # Each separator is a symbol of its own, so that nothing in common crosses one.
    alone = x.copy()
    gaps = np.flatnonzero(x == 0)
    alone[gaps] = top + np.arange(len(gaps))
    symbol = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, int(alone.max()) + 1, dtype=np.uint64)
    power = np.ones(n + 1, np.uint64)
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(symbol[alone] * power[:-1], out=h[1:])
    out = set()
    for order in (x, np.where(x == 0, 0, top - x)):
        period = np.array(lyndon_array(order.tolist()), np.int64)
        i = np.flatnonzero(period)
        i = i[period[i + period[i]] == period[i]]        # four periods hold two neighbouring roots at least
        q = period[i]
        before = _common(h, power, i, i + q, n, True)
        length = before + q + _common(h, power, i, i + q, n, False)
        long_enough = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
        for r in set(zip((i - before)[long_enough].tolist(), length[long_enough].tolist(), q[long_enough].tolist(), strict=True)):
            start, size, p = r
            if not np.array_equal(alone[start:start + size - p], alone[start + p:start + size]):
                for k in i[(q == p) & (i - before == start)].tolist():
                    exact = (*_extend(alone, k, p), p)
                    if exact[1] >= max(LEAST_WORDS, LEAST_EXPONENT * p):
                        out.add(exact)
            else:
                out.add(r)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[Words]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (a list of words) by start, then period."""
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return result
    flat = np.empty(sizes.sum(), object)
    flat[:] = [w for t in texts for w in t]
    ids = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place, piece = _cut(ids, doc)
    if not len(place):
        return result
    # Pieces in one row: place p of piece k stands k + 1 separators further on.
    start = np.r_[True, piece[1:] != piece[:-1]]
    number = np.cumsum(start)
    at = np.arange(len(place)) + number
    x = np.zeros(at[-1] + 2, np.int64)
    x[at] = np.unique(ids[place], return_inverse=True)[1] + 1
    word = np.zeros(len(x), np.int64)
    word[at] = place
    base = np.cumsum(sizes) - sizes
    for s, length, q in _runs(x):
        d = int(doc[word[s]])
        result[d].append((int(word[s] - base[d]), length, q))
    return result


def collapse(words: Words, runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q:start + length] = True
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def _stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > STRETCH_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def _runs_type() -> pa.DataType:
    return pa.list_(pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """``doc_id, runs, collapsed_text``: every run of every text, and the text
    with each run cut to its first period (words joined by one space).
    ``prepare(doc_id, words)`` may change the words first."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            sizes = [0 if x is None else x for x in pa.compute.binary_length(text).to_pylist()]
            for a, b in _stretches(sizes):
                doc_id = batch.column("doc_id").slice(a, b - a)
                # bytes.split() parts at exactly the six white-space bytes of the contract.
                words = [(t or b"").split() for t in text.slice(a, b - a).to_pylist()]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(doc_id.to_pylist(), words, strict=True)]
                runs = runs_of_texts(words)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
                kept = [collapse(w, r).decode() for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(rows, _runs_type()), pa.array(kept, pa.string())],
                                                 ["doc_id", "runs", "collapsed_text"])

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {dict(docs.dtypes)['doc_id']}, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")


def repeat_tail(doc_id: int | None, words: Words) -> Words:
    """The contract's test repetition: in one document of ten (by its id) the
    words from a place on repeat with a period. A null id changes nothing."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * ((n - a) // p + 1))[:n - a]


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of runs and collapsed text."""
    best = "array_min(transform(runs, r -> struct(-r.length AS size, r.start AS start, r.period AS period)))"
    lines = "concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))"
    found = find_runs(docs, repeat_tail).withColumn("best", F.expr(best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.size")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-1000 * best.size) DIV best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
