"""Periodic runs of words in each text, and the texts with their repetitions collapsed.

Four steps for each slice of texts, in a task; no text meets another, so nothing is shuffled.

1. Words become numbers. A run of ``least`` words or more, two periods or more, has ``least / 2`` places or more in a row whose
   words come again one period on. So every word of it lies under a gram of that many words which its text holds twice, and only
   the stretches under such grams go further; each run that counts lies in one of them whole.
2. Baier grouping (the first phase of his suffix sorter), once under the order of the words' numbers and once under the
   reverse: suffixes are grouped by their longest Lyndon prefix, whose length comes out without a suffix array.
3. By the runs theorem one of these Lyndon words is a root of each run. Longest common extensions to both
   sides of each candidate, by binary search on prefix hashes under two moduli, give its run.
4. Runs are checked word by word, and written down by start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import release, table
from .words import covered, mix, windows

_U = np.uint64
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
#: Bytes of texts that are taken together; a longer text is taken alone.
SLICE = 4 << 20
#: Moduli of the prefix hashes (primes below 2**31) and their bases.
MODULI = ((2147483647, 1000003), (2147483629, 69069069))


def lyndon_lengths(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that begins at each place, by Baier grouping.

    ``text``: numbers, small ones first in the order; several strings may stand one behind another, ``first`` has their beginnings.
    Groups are taken from the greatest down. Each suffix of the group is hung on the nearest suffix before it, in its string, of a
    smaller group. Suffixes of one group that have equally many hung on them move to a new group just above their own
    (more above fewer), and their Lyndon prefix grows by the taken group's as often.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    cuts = np.flatnonzero(np.diff(text[order])) + 1
    members = [part.tolist() for part in np.split(order, cuts)]
    g = len(members)
    size, below, above = [1] * g, list(range(-1, g - 1)), [*range(1, g), -1]
    numbers = np.empty(n, np.int64)
    numbers[order] = np.repeat(np.arange(g), np.diff(np.concatenate(([0], cuts, [n]))))
    group = numbers.tolist()
    before = np.arange(-1, n - 1)
    before[first] = -1
    before = before.tolist()
    back = list(range(n))  # a place whose group is still to come points to itself, others to an earlier place
    top = g - 1
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        members[top] = []
        for i in own:
            back[i] = before[i]
        hung: dict[int, int] = {}
        for i in own:
            j = back[i]
            while j >= 0 and (k := back[j]) != j:
                if k >= 0:
                    back[j] = back[k]
                j = k
            back[i] = j
            if j >= 0:
                hung[j] = hung.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in hung.items():
            moves.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moves, reverse=True):
            new, up = len(members), above[old]
            members.append(moves[times, old])
            size.append(size[old] + times * size[top])
            below.append(old)
            above.append(up)
            below[up] = above[old] = new
            for j in members[new]:
                group[j] = new
        top = below[top]
    return np.array(size, np.int64)[group]


class Extensions:
    """Longest common extensions of places of strings that stand one behind another; ``lo`` and ``hi`` bound each place's string."""

    def __init__(self, text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.lo, self.hi = lo, hi
        self.hashes = []
        for m, base in MODULI:
            powers = np.ones(len(text) + 1, np.int64)
            done, step = 1, base
            while done < len(powers):
                part = powers[: min(done, len(powers) - done)]
                powers[done : done + len(part)] = part * step % m
                done, step = 2 * done, step * step % m
            values = (mix(text.astype(np.uint64) + _U(base)) % _U(m)).astype(np.int64)
            self.hashes.append((m, powers, np.concatenate(([0], np.cumsum(values * powers[:-1] % m)))))

    def _equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        same = np.ones(len(i), bool)
        for m, powers, sums in self.hashes:
            same &= (sums[i + size] - sums[i]) % m * powers[j - i] % m == (sums[j + size] - sums[j]) % m
        return same

    def _longest(self, most: np.ndarray, equal: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = equal(middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on (``i < j``, in one string)."""
        return self._longest(self.hi[i] - j, lambda size: self._equal(i, j, size))

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``j``."""
        return self._longest(i - self.lo[i], lambda size: self._equal(i - size, j - size, size))


def find_runs(text: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of ``least`` words or more, and two periods or more, in strings that begin at ``first``."""
    none = np.zeros(0, np.int64)
    if not len(text):
        return none, none, none
    ends = np.append(first[1:], len(text))
    lo, hi = np.repeat(first, ends - first), np.repeat(ends, ends - first)
    reach = Extensions(text, lo, hi)
    place, found = np.arange(len(text)), []
    for ordered in (text, text.max() - text):
        period = lyndon_lengths(ordered, first)
        after = place + period
        inside = after < hi
        on = np.zeros(len(text), bool)
        on[inside] = text[place[inside]] == text[after[inside]]
        on |= (place > lo) & (text[place - 1] == text[after - 1])  # else nothing extends the root
        i, p = place[on], period[on]
        start = i - reach.left(i, i + p)
        found.append(np.stack((start, i + p + reach.right(i, i + p) - start, p), 1))
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[(runs[:, 1] >= least) & (runs[:, 1] >= 2 * runs[:, 2])]
    for s, size, p in runs.tolist():
        if not np.array_equal(text[s : s + size - p], text[s + p : s + size]):
            raise AssertionError(f"two hashes agree on different words: run {s, size, p}")
    return runs[:, 0], runs[:, 1], runs[:, 2]


def repeated(text: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie under a string of ``n`` words that their document holds twice or more (or whose 64-bit names collide)."""
    if len(text) < n:
        return np.zeros(len(text), bool)
    gram = windows(mix(text.astype(np.uint64) + _U(1)), n, 0x9E3779B97F4A7C15)
    whole = np.flatnonzero(doc[: len(gram)] == doc[n - 1 :])
    names = mix(gram[whole] ^ mix(doc[whole].astype(np.uint64) + _U(7)))
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    starts = np.zeros(len(text), bool)
    starts[whole[order[1:][same]]] = starts[whole[order[:-1][same]]] = True
    return covered(starts, n, len(text))


def runs_of(texts: list[list[bytes]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs in ``texts`` (lists of words), by text, start and period."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.concatenate([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts] or [np.zeros(0, np.int64)])
    doc, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    at = np.flatnonzero(repeated(words, doc, (least + 1) // 2))
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    first = np.concatenate(([0], np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1))
    start, length, period = find_runs(words[at], first, least)
    owner, place = doc[at[start]], at[start]
    start = place - begin[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def collapse(docs: DataFrame, least: int = 12, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """The runs of each text of ``docs(doc_id, text)`` and a digest of what is left without their repetitions.

    A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``) with smallest period q, at least ``least`` words and 2 q
    long, that no neighbouring word extends. Columns: ``n_runs``; ``start, length, period, exponent_milli`` of the longest run (ties: least start,
    then period; all null without a run); ``runs_sha256`` of the lines ``start,length,period`` by start, then period; ``collapsed_sha256`` of the kept words,
    joined by one space: those that no run contains after its first q words.

    ``arrange(doc_id, n)`` may put other words in place before (numbers of the text's ``n`` words, or None). A null text is empty:
    no runs and digests of empty strings. Repeated rows and doc_ids and null doc_ids are rows of their own; other columns are not read. An empty table gives an empty result.
    A text is taken whole, so memory follows the longest text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())
            cuts, total = [0], 0
            for k, size in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                if total and total + size > SLICE:
                    cuts.append(k)
                    total = 0
                total += size
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if a < b:
                    yield report(ids[a:b], column.slice(a, b - a))
        release()

    def report(ids: list[int | None], column: pa.Array) -> pa.RecordBatch:
        texts = [(t or b"").split() for t in column.to_pylist()]
        if arrange is not None:
            for k, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
                if (places := arrange(doc_id, len(words))) is not None:
                    texts[k] = [words[i] for i in places.tolist()]
        owner, start, length, period = runs_of(texts, least)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = []
        for k, words in enumerate(texts):
            s, z, q = (x[edges[k] : edges[k + 1]] for x in (start, length, period))
            best = (None,) * 4
            if len(s):
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, s + q, 1)
                np.add.at(steps, s + z, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                top = int(np.argmax(z))  # the first of the longest: by start, then period
                best = (int(s[top]), int(z[top]), int(q[top]), int(1000 * z[top] // q[top]))
            lines = "".join(f"{x},{y},{w}\n" for x, y, w in zip(s.tolist(), z.tolist(), q.tolist(), strict=True))
            rows.append((ids[k], len(s), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(work, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's periodic texts: about a tenth of the documents repeat a stretch of their words from some place on."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text; a null doc_id has no number, so its text stays as it is."""
    return collapse(table(spark, sf_dir, "documents"), 12, planted)
