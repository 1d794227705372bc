"""Periodic runs of words: maximal stretches that repeat themselves several times.

Every run of exponent two or more has a root that is the longest Lyndon word at its start, under the order of
the words or the reverse order. A stack scanned from right to left finds those words for both orders; suffixes
are compared, and roots extended both ways, by rolling hashes modulo 2^61 - 1 and binary search. Each run found
is then verified word by word; a collision makes the scan start again with another base. There is no suffix array.

A run of exponent e holds each of its words at least e times. Words that are rarer in a stretch cannot be in a run
and cut it, so only stretches of words that recur are scanned; this loses no run.

Defined results: null, empty and blank texts have no words and no runs; words are `[^\\x20\\x09-\\x0D]+`, compared
as they stand; repeated rows are judged alike; an empty table gives an empty result; other columns pass through, and
columns with the names of the results are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import sliced, tidy

_MOD = (1 << 61) - 1
#: Rounds of cutting at rare words; the scan is exact after any number of them.
_CUTS = 4
_powers: dict[int, list[int]] = {}


class _Collision(Exception):
    pass


class _Hashes:
    """Comparisons of two stretches of one sequence, by prefix hashes."""

    def __init__(self, a: list[int], base: int) -> None:
        self.a, self.n = a, len(a)
        self.prefix = list(itertools.accumulate(a, lambda h, x: (h * base + x + 1) % _MOD, initial=0))
        powers = _powers.setdefault(base, [1])
        while len(powers) <= self.n:
            powers.append(powers[-1] * base % _MOD)
        self.powers = powers
        #: distance -> (place, end) of the last comparison at that distance: equal from place to end, and no further
        self.reach: dict[int, tuple[int, int]] = {}

    def same(self, i: int, j: int, size: int) -> bool:
        h = self.prefix
        return not (h[i + size] - h[j + size] - (h[i] - h[j]) * self.powers[size]) % _MOD

    def ahead(self, i: int, j: int) -> int:
        """How many words the suffixes at i < j share; i never grows from call to call."""
        a, n, k = self.a, self.n, 0
        while k < 4 and j + k < n and a[i + k] == a[j + k]:
            k += 1
        if k < 4 or j + k == n:
            return k
        at, end = self.reach.get(j - i, (n, n))
        if at < n and self.same(i, j, at - i):
            found = end - i
        else:
            low, high, step = k, n - j if at == n else at - i - 1, k
            while low + step <= high and self.same(i, j, low + step):
                low, step = low + step, 2 * step
            high = min(high, low + step)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if self.same(i, j, middle) else (low, middle - 1)
            found = low
        self.reach[j - i] = (i, i + found)
        return found

    def behind(self, i: int, j: int) -> int:
        """How many words before i equal those before j > i."""
        low, high, step = 0, i, 1
        while low + step <= high and self.same(i - low - step, j - low - step, low + step):
            low, step = low + step, 2 * step
        high = min(high, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i - middle, j - middle, middle) else (low, middle - 1)
        return low


def _scan(a: list[int], exponent: int, least: int, base: int) -> set[tuple[int, int, int]]:
    n, hashes = len(a), _Hashes(a, base)
    ahead, found = hashes.ahead, set()
    for reverse in (False, True):
        hashes.reach.clear()
        smaller = [n] * (n + 1)  # the next smaller suffix; up to it reaches the longest Lyndon word
        seen: dict[int, int] = {}  # period -> start of the last run of that period
        for i in range(n - 1, -1, -1):
            x, j = a[i], i + 1
            while j < n:
                y = a[j]
                if x == y:
                    k = ahead(i, j)
                    if j + k == n or (a[j + k] < a[i + k]) != reverse:
                        break
                elif (y < x) != reverse:
                    break
                j = smaller[j]
            smaller[i] = j
            p = j - i
            # the first root of a run of that exponent is followed by so many periods
            if j < n and a[j] == x and j + (exponent - 2) * p <= n and not (p in seen and seen[p] <= i):
                right = ahead(i, j)
                if right >= (exponent - 2) * p:
                    start, end = i - hashes.behind(i, j), j + right
                    seen[p] = start
                    if end - start >= max(least, exponent * p):
                        if a[start : end - p] != a[start + p : end] or (start and a[start - 1] == a[start + p - 1]) or (end < n and a[end] == a[end - p]):
                            raise _Collision
                        found.add((start, end - start, p))
    return found


def scan(a: list[int], exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small numbers, by start, then period."""
    for base in itertools.count(1_000_003, 1_000_002):
        try:
            return sorted(_scan(a, exponent, least, base))
        except _Collision:
            continue
    raise AssertionError


def stretches(a: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold runs: every word in one occurs in it `exponent` times."""
    place = np.arange(len(a))
    part = np.zeros(len(a), np.int64)
    for _ in range(_CUTS):
        if len(place) < least:
            return []
        _, which, count = np.unique(part * (int(a.max()) + 1) + a[place], return_inverse=True, return_counts=True)
        keep = count[which] >= exponent
        part = np.cumsum(np.diff(place[keep], prepend=-2) > 1) - 1 if keep.any() else np.zeros(0, np.int64)
        place = place[keep]
        size = np.bincount(part)[part] if len(part) else part
        whole = keep.all() and (size >= least).all()
        place, part = place[size >= least], part[size >= least]
        if whole:
            break
    if not len(place):
        return []
    opens = np.flatnonzero(np.diff(place, prepend=-2) > 1)
    closes = np.append(opens[1:], len(place)) - 1
    return list(zip(place[opens].tolist(), (place[closes] + 1).tolist(), strict=True))


def runs_of(words: list, exponent: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words that have `exponent` periods and `least` words or more."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    a = np.array(ids, np.int64)
    out = []
    for begin, end in stretches(a, exponent, least):
        out += [(begin + s, size, p) for s, size, p in scan(ids[begin:end], exponent, least)]
    return sorted(out)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one blank, each run cut to its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(f.name, pa.int64()) for f in _RUN])


def annotate(docs: DataFrame, text_col: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """Adds `n_words`, `runs` (start, length and period in words, by start, then period) and the `collapsed` text."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]
    fields = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024, text_col):
            counts, found, texts = [], [], []
            for text in batch.column(text_col):
                words = (text.as_py() or "").encode().split()  # bytes split at exactly these six blanks
                runs = runs_of(words, exponent, least)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(collapse(words, runs))
            table = {f.name: batch.column(f.name) for f in fields}
            table |= {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(found, pa.list_(_RUN_ARROW))}
            table["collapsed"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(table)

    return docs.mapInArrow(tidy(run), T.StructType([*fields, *added]))
