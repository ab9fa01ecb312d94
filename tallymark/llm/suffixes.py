"""Substring dedup on bytes by per-shard suffix arrays.

Matches of ``window`` bytes are found in shards that hold all text with the same local minimum: of the
hashes of a window's inner ``GRAM``-byte strings the least names the window's shard, so equal windows
meet, and neighbouring windows, which mostly share it, travel as one piece. Four steps:

1. each chunk of documents sends the set of its windows' least hashes to the owners of the hash
   space, with the number of distinct pieces of each; owners report which of them several documents hold (windows with another
   occur in one document only), and which have many more pieces than chunks: a phrase that many otherwise different texts hold;
2. chunks send the pieces that are left, each distinct one once with its least doc_id. Pieces of such a frequent hash are
   cut into single windows and dealt by a hash of the whole window, so no hash is one owner's burden;
3. owners build suffix arrays of bounded shards of the distinct pieces by Larsson-Sadakane refinement in
   numpy, whose last groups are the suffixes with a common prefix of a window, and merge shards by binary search of their sorted
   window heads; each window gets the least doc_id in which it starts;
4. chunks mark the bytes under windows that start in a smaller doc_id.

Texts are shuffled once; steps 1, 2 and 4 read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import table, tidy
from .recompression import _blobs, _ids, _spread, owners_for, ranges
from .words import covered, mix

_U = np.uint64
GRAM = 16
#: A least hash is frequent if its distinct pieces, counted by chunk, are more than this, which is about a shard, and twice the chunks that hold it.
FREQUENT = 1 << 14
#: Bytes of pieces that an owner sorts at once: small arrays stay in the cache.
RANGE = 256 << 10
#: Stretches of a text whose common prefixes are taken side by side, and the least bytes of each.
STRANDS, STRETCH = 8192, 128


def _loads(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each place as a number (``data`` has eight bytes to spare)."""
    n = len(data) - 8
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):  # every eighth place lies as the numbers of one array do
        out[k::8] = np.frombuffer(data, order + "u8", (n - k + 7) // 8, k)
    return out


def minima(data: np.ndarray, window: int) -> np.ndarray:
    """The least gram hash in each window that begins in ``data``, whose last ``window`` bytes are padding."""
    eight = _loads(data, "<")
    with np.errstate(over="ignore"):
        least = mix(eight[:-8] * _U(0x9E3779B97F4A7C15) + eight[8:])
    need, have = window - GRAM + 1, 1
    while 2 * have <= need:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[: len(least) - (need - have)], least[need - have :]) if need > have else least


class Bytes:
    """A chunk's texts as bytes: ``data`` (padded), ``begin`` and ``end`` of each, and whether a window begins at a place."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.size, self.window = int(sizes.sum()), window
        self.data = np.frombuffer(b"".join(texts) + bytes(window + 16), np.uint8)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        fits = sizes >= window
        edges = np.zeros(self.size + 1, np.int8)
        edges[self.begin[fits]] += 1
        edges[self.end[fits] - window + 1] -= 1
        self.valid = np.cumsum(edges[:-1], dtype=np.int8) > 0
        self.minima = minima(self.data, window)[: self.size]

    def runs(self, mask: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(start, length)`` of the longest runs of marked windows with one least hash; ``single`` windows are runs of their own."""
        on = np.concatenate(([False], mask, [False]))
        change = np.concatenate(([True], self.minima[1:] != self.minima[:-1], [True])) if len(mask) else np.array([True])
        if single is not None and len(mask):
            change[:-1] |= single
            change[1:] |= single
        edge = np.flatnonzero((on[1:] != on[:-1]) | (on[1:] & change))
        start = edge[on[1:][edge]]
        stop = edge[np.searchsorted(edge, start) + 1] if len(start) else start
        return start, stop - start

    def names(self, at: np.ndarray, single: np.ndarray | None = None) -> np.ndarray:
        """The least hashes at ``at``, spread evenly over 64 bits again (minima crowd near zero); for ``single`` windows a hash of all their bytes."""
        out = mix(self.minima[at] ^ _U(0xA5A5A5A5A5A5A5A5))
        if single is not None:
            own = single[at]
            out[own] = self.hashes(at[own])
        return out

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of the whole window at each place."""
        eight = np.lib.stride_tricks.as_strided(self.data, (len(self.data) - 8, 8), (1, 1))
        out = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in [*range(0, self.window - 8, 8), self.window - 8]:
                out = mix(out * _U(0x9E3779B97F4A7C15) + np.ascontiguousarray(eight[at + k]).view("<u8")[:, 0])
        return out

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, at, side="right")


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes of ``text`` by their first ``depth`` bytes."""
    return sorted_suffixes(text, depth)[0]


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes of ``text`` by their first ``depth`` bytes, at least 8, and which of them differ there from the one before.

    Larsson-Sadakane: suffixes are grouped by their first 8 bytes; groups of more than one are refined by
    the rank of the suffix as many bytes on as they are sorted by, which doubles that number. The last step goes on by what is
    missing to ``depth``, so its groups are those whose common prefixes reach it.
    """
    n = len(text)
    first = _loads(np.concatenate((text, np.zeros(16, np.uint8))), ">")[:n]
    new = np.ones(n, bool)
    if not text.all():  # the padding must not equal zeros of the text: shorter suffixes come first
        full = np.minimum(n - np.arange(n), 8)
        sa = np.lexsort((full, first))
        new[1:] = (first[sa][1:] != first[sa][:-1]) | (full[sa][1:] != full[sa][:-1])
    else:
        sa = np.argsort(first)
        first = first[sa]
        new[1:] = first[1:] != first[:-1]
    done = 8
    rank = np.empty(n, np.int64)
    while done < depth:
        head = np.flatnonzero(new)
        if len(head) == n:
            break
        size = np.diff(np.append(head, n))
        group = np.repeat(head, size)
        rank[sa] = group
        at = np.flatnonzero(np.repeat(size > 1, size))
        step = min(done, depth - done)
        to = sa[at] + step
        key = group[at] * (n + 1) + np.where(to < n, rank[np.minimum(to, n - 1)] + 1, 0)
        order = np.argsort(key)
        sa[at] = sa[at][order]
        key = key[order]
        new[at[1:]] |= key[1:] != key[:-1]
        done += step
    return sa, new


def common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """The common prefix of each suffix in ``sa`` with the one before it, up to ``limit``, by Kasai's method.

    :func:`sorted_suffixes` tells which prefixes reach its depth, and the dedup needs no more; this gives their lengths, and tests hold one against the other.
    In text order a prefix is at most one shorter than that of the suffix one byte before, so each comparison goes on where the last
    one ended. That holds where the last prefix ended below the limit, to which ``sa`` is sorted; after others, among
    which the order of ``sa`` is open, it starts anew. Stretches of the text are walked side by side, eight bytes a comparison.
    """
    n = len(text)
    eight = _loads(np.concatenate((text, np.zeros(limit + 16, np.uint8))), ">")
    before = np.full(n, n)
    before[sa[1:]] = sa[:-1]
    step = max(STRETCH, -(-n // STRANDS))
    at = np.arange(0, n, step)
    prefix, h = np.zeros(n, np.int64), np.zeros(len(at), np.int64)
    for _ in range(min(step, n)):
        other = before[at]
        room = np.minimum(limit, n - np.maximum(at, other))
        h = np.minimum(np.where(h < limit, np.maximum(h - 1, 0), 0), room)
        go = np.flatnonzero(h < room)
        while len(go):
            x = eight[at[go] + h[go]] ^ eight[other[go] + h[go]]
            same = x == 0
            h[go] += np.where(same, 8, (63 - np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64)) // 8)
            go = go[same & (h[go] < room[go])]
        h = np.minimum(h, room)
        prefix[at] = h
        at = at + 1
        if at[-1] >= n:  # the last stretch may be shorter
            at, h = at[:-1], h[:-1]
    return prefix[sa]


def _heads(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The windows at ``at`` as comparable strings; the last byte keeps trailing zeros."""
    out = np.ones((len(at), window + 1), np.uint8)
    for k in range(0, len(at), 1 << 16):
        out[k : k + (1 << 16), :window] = text[at[k : k + (1 << 16), None] + np.arange(window)]
    return out.view(f"S{window + 1}")[:, 0]


def least_documents(pieces: list[bytes], docs: np.ndarray, window: int, shard_bytes: int) -> list[np.ndarray]:
    """For each piece, the least of ``docs`` in whose pieces each of its windows occurs."""
    shards, start, size = [], 0, 0
    for i, p in enumerate(pieces):
        if size and size + len(p) > shard_bytes:
            shards.append((start, i))
            start, size = i, 0
        size += len(p)
    shards.append((start, len(pieces)))
    sorted_shards = []
    for a, b in shards:
        text = np.frombuffer(b"".join(pieces[a:b]), np.uint8)
        sizes = np.fromiter((len(p) for p in pieces[a:b]), np.int64, b - a)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        # a window's group: neighbours in the array that share it; suffixes cut short by their piece stand between
        sa, new = sorted_suffixes(text, window)
        whole = left[sa] >= window
        group = np.cumsum(new) - 1
        places, group = sa[whole], group[whole]
        owner = np.repeat(docs[a:b], sizes)[places]
        head = np.flatnonzero(np.diff(group, prepend=-1))  # groups come in order
        at = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))
        least = np.minimum.reduceat(owner, head) if len(head) else owner
        sorted_shards.append((text, sizes, places, at, least))
    if len(shards) > 1:
        heads = []
        for text, _, places, at, _ in sorted_shards:
            some = np.empty(int(at.max()) + 1 if len(at) else 0, np.int64)
            some[at] = places
            heads.append(_heads(text, some, window))
        for i in range(len(heads)):
            for j in range(i + 1, len(heads)):
                if len(heads[i]) and len(heads[j]):
                    to = np.minimum(np.searchsorted(heads[j], heads[i]), len(heads[j]) - 1)
                    x = np.flatnonzero(heads[j][to] == heads[i])
                    low = np.minimum(sorted_shards[i][4][x], sorted_shards[j][4][to[x]])
                    sorted_shards[i][4][x] = low
                    sorted_shards[j][4][to[x]] = low
        # the first shard that holds a window met all others and knows the least; pass it on
        for i in range(len(heads)):
            for j in range(i + 1, len(heads)):
                if len(heads[i]) and len(heads[j]):
                    to = np.minimum(np.searchsorted(heads[j], heads[i]), len(heads[j]) - 1)
                    x = np.flatnonzero(heads[j][to] == heads[i])
                    sorted_shards[j][4][to[x]] = np.minimum(sorted_shards[j][4][to[x]], sorted_shards[i][4][x])
    out = []
    for _, sizes, places, at, least in sorted_shards:
        flat = np.zeros(int(sizes.sum()), np.int64)
        flat[places] = least[at]
        ends = np.cumsum(sizes)
        out += [flat[e - s : e - window + 1] for e, s in zip(ends, sizes, strict=True)]
    return out


def dedup(docs: DataFrame, window: int = 50, chunk_bytes: int = 4 << 20, shard_bytes: int = 1 << 20, frequent_pieces: int = FREQUENT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs(doc_id, text)``.

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts in a document with a
    smaller doc_id; strings are judged on the input and never cross documents. Null texts are empty;
    texts shorter than ``window`` keep all; repeated rows of one doc_id do not remove each other; rows with
    a null doc_id keep their bytes and remove none of others; other columns are ignored. Least hashes with more than
    ``frequent_pieces`` distinct pieces are dealt by window.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(size // chunk_bytes) + 1
    owners = owners_for(size)
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod(F.xxhash64("_row", F.spark_partition_id()), F.lit(chunks)))
    found_ddl = "owner long, chunk long, bytes binary, sizes binary, names binary, doc binary"
    found_schema = to_arrow_schema(T.StructType.fromDDL(found_ddl))
    out_ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out_schema = to_arrow_schema(T.StructType.fromDDL(out_ddl))

    def read(part):
        part = part.sort_by([("doc_id", "ascending"), ("_row", "ascending")])
        rank, no_id = _ids(part)
        b = Bytes(part.column("text").to_pylist(), window)
        for i in np.flatnonzero(no_id):
            b.valid[b.begin[i] : b.end[i]] = False
        return part, b, rank

    @tidy
    def reveal(_, part):
        part, b, _ = read(part)
        start, length = b.runs(b.valid)
        key, doc = b.names(start), b.docs(start)
        with np.errstate(over="ignore"):
            piece = mix(b.hashes(start) + mix(b.hashes(start + length - 1) + length.astype(np.uint64)))
        order = np.lexsort((piece, key))
        key, doc, piece = key[order], doc[order], piece[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        head, other = np.flatnonzero(new), new.copy()
        other[1:] |= piece[1:] != piece[:-1]
        if len(key):
            many = np.minimum(np.add.reduceat(other.astype(np.int64), head), 255)
            several = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
        else:
            many, several = doc, new
        key = key[new]
        blobs = _blobs(_spread(key, owners), (key & _U(0xFFFFFFFF)).astype("<u4"), many.astype(np.uint8), several, bits=1)
        chunk = part.column("chunk")[0].as_py()
        return pa.table({"owner": pa.array([o for o, _ in blobs], pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64()), **{c: pa.array([x[i] for _, x in blobs], pa.binary()) for i, c in enumerate(("names", "many", "several"))}})

    @tidy
    def report(part):
        sent = [np.frombuffer(x, "<u4") for x in part.column("names").to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(x)) for s, x in zip(part.column("several").to_pylist(), sent, strict=True)]).astype(bool)
        pieces = np.frombuffer(b"".join(part.column("many").to_pylist()), np.uint8)
        low = np.concatenate(sent)
        order = np.argsort(low)
        head = np.flatnonzero(np.concatenate(([True], low[order][1:] != low[order][:-1])))
        many = np.diff(np.append(head, len(low)))
        total = np.add.reduceat(pieces[order].astype(np.int64), head)
        shared, frequent = np.empty(len(low), bool), np.empty(len(low), bool)
        shared[order] = np.repeat((many > 1) | np.logical_or.reduceat(several[order], head), many)
        frequent[order] = np.repeat((total > frequent_pieces) & (total > 2 * many), many)
        ends = np.cumsum([len(x) for x in sent])
        masks = {c: pa.array([np.packbits(m[e - len(x) : e]).tobytes() for x, e in zip(sent, ends, strict=True)], pa.binary()) for c, m in (("mask", shared), ("frequent", frequent))}
        return pa.table({"chunk": part.column("chunk"), "owner": part.column("owner"), **masks})

    def marked(answers, key, mask):
        """Which of the chunk's own names, distinct and sorted as they were sent, the owners' ``mask`` marks."""
        owner, out = _spread(key, owners), np.zeros(len(key), bool)
        for o, m in zip(answers.column("owner").to_pylist(), answers.column(mask).to_pylist(), strict=True):
            i, j = np.searchsorted(owner, [o, o + 1])
            out[i:j] = np.unpackbits(np.frombuffer(m, np.uint8), count=j - i).astype(bool)
        return out

    def pieces_of(b, mask, single, rank):
        """Distinct pieces by name, their owners and names, the least rank of each, and each run's entry."""
        start, length = b.runs(mask, single)
        name = b.names(start, single)
        order = np.argsort(name, kind="stable")  # within a name by place, so by rank
        raw, entry, seen, ids = b.data.tobytes(), np.empty(len(start), np.int64), {}, []
        who = rank[b.docs(start)]
        for i, s, n in zip(order.tolist(), start[order].tolist(), length[order].tolist(), strict=True):
            piece = raw[s : s + n + window - 1]
            at = seen.get(piece)
            if at is None:
                at = seen[piece] = len(ids)
                ids.append(i)
            entry[i] = at
        ids = np.array(ids, np.int64)
        return list(seen), name[ids], who[ids], start, length, entry

    def under(b, start, length):
        """Which windows the runs hold."""
        edges = np.zeros(b.size + 1, np.int32)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + length, -1)
        return np.cumsum(edges[:-1]) > 0

    @tidy
    def verify(_, left, right):
        if not left.num_rows:
            return found_schema.empty_table()
        part, b, rank = read(left)
        start, length = b.runs(b.valid)
        key, at = np.unique(b.names(start), return_inverse=True)
        known, often = (marked(right, key, c)[at] for c in ("mask", "frequent"))
        mask, single = under(b, start[known], length[known]), under(b, start[often], length[often])
        pieces, name, who, *_ = pieces_of(b, mask, single, rank)
        owner = _spread(name, owners)
        sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        tail = np.append(head[1:], len(owner))[: len(head)]
        rows = [(int(owner[i]), b"".join(pieces[i:j]), sizes[i:j].astype("<u4").tobytes(), (name[i:j] >> _U(32)).astype("<u4").tobytes(), who[i:j].astype("<i8").tobytes()) for i, j in zip(head.tolist(), tail.tolist(), strict=True)]
        chunk = left.column("chunk")[0].as_py()
        rows.append((-1 - chunk, None, None, np.packbits(single).tobytes(), np.packbits(mask).tobytes()))  # the chunk's own note to itself
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))], schema=found_schema)

    @tidy
    def settle(part):
        owner = part.column("owner")
        if owner[0].as_py() < 0:
            return pa.table({"chunk": part.column("chunk"), "owner": owner, "runs": part.column("names"), "doc": part.column("doc")})
        raws = part.column("bytes").to_pylist()
        sizes, names, whos = ([np.frombuffer(x, t) for x in part.column(c).to_pylist()] for c, t in (("sizes", "<u4"), ("names", "<u4"), ("doc", "<i8")))
        ends = [np.cumsum(x.astype(np.int64)) for x in sizes]
        parts = sum(map(len, raws)) // RANGE + 1
        cuts = ranges(names, parts)
        found = [[] for _ in raws]
        for p in range(parts):  # ranges of names; one name's pieces may be more than a shard
            seen, least, entries = {}, [], []
            for raw, size, end, who, c in zip(raws, sizes, ends, whos, cuts, strict=True):
                mine = []
                i, j = c[p], c[p + 1]
                for n, e, d in zip(size[i:j].tolist(), end[i:j].tolist(), who[i:j].tolist(), strict=True):
                    piece = raw[e - n : e]
                    k = seen.setdefault(piece, len(least))
                    if k == len(least):
                        least.append(d)
                    elif d < least[k]:
                        least[k] = d
                    mine.append(k)
                entries.append(mine)
            if not seen:
                continue
            answer = least_documents(list(seen), np.array(least, np.int64), window, shard_bytes)
            for out, mine in zip(found, entries, strict=True):
                out += [answer[k] for k in mine]
        runs, docs_ = [], []
        for mine in found:
            flat = np.concatenate(mine)
            cut = np.zeros(len(flat), bool)
            cut[np.cumsum([0, *(len(x) for x in mine[:-1])])] = True  # each piece starts a run
            cut[1:] |= flat[1:] != flat[:-1]
            head = np.flatnonzero(cut)
            runs.append(np.diff(np.append(head, len(flat))).astype("<u4").tobytes())
            docs_.append(flat[head].astype("<i8").tobytes())
        return pa.table({"chunk": part.column("chunk"), "owner": owner, "runs": pa.array(runs, pa.binary()), "doc": pa.array(docs_, pa.binary())})

    @tidy
    def apply(_, left, right):
        if not left.num_rows:
            return out_schema.empty_table()
        part, b, rank = read(left)
        own = -1 - left.column("chunk")[0].as_py()
        answers = {o: (r, d) for o, r, d in zip(*(right.column(c).to_pylist() for c in ("owner", "runs", "doc")), strict=True)}
        single, mask = (np.unpackbits(np.frombuffer(x, np.uint8), count=b.size).astype(bool) for x in answers.pop(own))
        pieces, _, _, start, length, entry = pieces_of(b, mask, single, rank)
        none = np.zeros(0, np.int64)
        many = np.concatenate([none, *(np.frombuffer(answers[o][0], "<u4") for o in sorted(answers))]).astype(np.int64)
        least = np.repeat(np.concatenate([none, *(np.frombuffer(answers[o][1], "<i8") for o in sorted(answers))]), many)
        sizes = np.fromiter((len(p) - window + 1 for p in pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        at = np.repeat(start, length) + inside
        begins = np.zeros(b.size, bool)
        begins[at[least[np.repeat(first[entry], length) + inside] < np.repeat(rank[b.docs(start)], length)]] = True
        gone = covered(begins, window, b.size)
        upto = np.concatenate(([0], np.cumsum(gone)))
        edge = gone & ~np.concatenate(([False], gone[:-1]))
        heads = b.begin[b.begin < b.size]
        edge[heads] = gone[heads]
        spans = np.concatenate(([0], np.cumsum(edge)))
        kept = b.data[: b.size][~gone].tobytes()
        keep = np.arange(b.size + 1) - upto
        hashes = [hashlib.sha256(kept[keep[s] : keep[e]]).hexdigest() for s, e in zip(b.begin, b.end, strict=True)]
        return pa.table({"doc_id": part.column("doc_id"), "n_bytes": pa.array(b.end - b.begin, pa.int64()), "n_removed": pa.array(upto[b.end] - upto[b.begin], pa.int64()), "n_spans": pa.array(spans[b.end] - spans[b.begin], pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})

    by_chunk = rows.groupBy("chunk")
    masks = by_chunk.applyInArrow(reveal, "owner long, chunk long, names binary, many binary, several binary").groupBy("owner").applyInArrow(report, "chunk long, owner long, mask binary, frequent binary")
    found = by_chunk.cogroup(masks.groupBy("chunk")).applyInArrow(verify, found_ddl)
    answers = found.groupBy("owner").applyInArrow(settle, "chunk long, owner long, runs binary, doc binary")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(apply, out_ddl)


def op6_dedup_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP6_SQL = """
with d as (select doc_id, coalesce(hex(encode(text)), '') as h from documents),
p as (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) as i from d),
w as (select doc_id, i, case when length(h) // 2 >= i + 49 then substr(h, 2 * i - 1, 100) end as s, substr(h, 2 * i - 1, 2) as byte from p),
m as (select s, min(doc_id) as least from w where s is not null group by s having min(doc_id) < max(doc_id)),
b as (select w.doc_id, w.i, w.byte, m.least is not null and m.least < w.doc_id as begins from w left join m on w.s = m.s),
g as (select doc_id, i, byte, bool_or(begins) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from b),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as edge from g),
r as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where edge) as n_spans, string_agg(byte, '' order by i) filter (where not gone) as kept from e group by doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join r on d.doc_id = r.doc_id
"""
