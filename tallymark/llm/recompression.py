"""Substring dedup on words by recompression.

Every word gets a 64-bit name. Rounds of recompression then rename the text of every document:
runs of one word become one symbol (runs of longer symbols stay in their elements, or periodic text
would have no symbol starts), and adjacent symbols whose names lie in the left and the right
half of that round's alphabet become one symbol. A symbol's name is a hash of the names it
replaces, so all tasks give equal runs and pairs equal names without a shared dictionary, and equal
passages get the same symbols in their interior wherever they stand.

A passage of ``window`` words therefore holds, at a place that its own words determine, the start of a
symbol of the last round (see :func:`anchors`). Three exchanges follow.

1. *Reveal.* Each chunk of documents sends the names of the phrases at its symbol starts, as sets,
   to the owner of that part of the name space; owners report back those that several documents hold.
2. *Verify.* For windows that begin near a shared phrase (all others occur in one document only),
   chunks send a 128-bit name with the least doc_id in the chunk; owners return the least doc_id of all.
3. *Apply.* Each chunk marks the words under windows that begin in a smaller doc_id.

What one chunk sends is merged within the chunk first, so a passage that a third of all documents
share costs one record a chunk. Texts are shuffled once; the three steps read that same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import pack_columns, table, tidy, unpack_columns
from .words import Batch, covered, mix, windows

_U = np.uint64
ROUNDS = 3
#: Odd factors of the two lanes of a window's 128-bit name.
LANES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Owners of the name space from 64 MB of text to 4 GB; the bytes of text for each owner below and above that.
OWNERS, SMALL_BYTES, OWNER_BYTES = 256, 256 << 10, 16 << 20
#: Names that an owner settles at once.
SETTLE = 1 << 20


def _same_doc(batch: Batch, lag: int) -> np.ndarray:
    """Whether word i and word i + lag are of one document (False past the end)."""
    out = np.zeros(len(batch.doc), bool)
    if lag < len(out):
        out[: len(out) - lag] = batch.doc[lag:] == batch.doc[: len(out) - lag]
    return out


def symbol_starts(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, symbols)`` of the last round: the word where each symbol starts, and its name."""
    at, sym, of = np.arange(len(names)), names, doc
    with np.errstate(over="ignore"):
        for r in range(rounds):
            # runs of one word; a run of symbols pairs with itself nowhere (one side), so its elements stay symbols with starts
            if r == 0:
                new = np.ones(len(sym), bool)
                new[1:] = (sym[1:] != sym[:-1]) | (of[1:] != of[:-1])
                head = np.flatnonzero(new)
                length = np.diff(np.append(head, len(sym)))
                at, of, base = at[head], of[head], sym[head]
                sym = np.where(length > 1, mix(base ^ mix(length.astype(np.uint64) + _U(1000 + r))), base)
            # pairs of a left and a right symbol
            side = mix(sym + _U(r + 1)) & _U(1)
            pair = np.zeros(len(sym), bool)
            pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (of[1:] == of[:-1])
            second = np.zeros(len(sym), bool)
            second[1:] = pair[:-1]
            joined = sym.copy()
            joined[pair] = mix(sym[pair] * _U(0x9E3779B97F4A7C15) + mix(sym[np.flatnonzero(pair) + 1] + _U(r)))
            at, of, sym = at[~second], of[~second], joined[~second]
    return at, sym


def phrase_size(window: int) -> int:
    """Words from a symbol start that surely lie inside a window: see :func:`anchors`."""
    return window - 8


def anchors(names: np.ndarray, batch: Batch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)`` of the phrases by which passages of ``window`` words are found.

    Let no two adjacent words among words 0 to 8 of a window be equal. Words 1 to 7 are then single symbols
    of round one. Of two symbols in a row at most one is the second of a pair, and a symbol on the left side is
    none: so if the symbol at a certain start is of the left side, that start stays certain after the round, else
    the next one is. So the start of a symbol is certain, given the window alone, at word 1 or 2 in round
    one, at most 2 words on in round two and 4 more in round three, where symbols have at most 2 and 4 words:
    rounds two and three fold no runs, so this holds in periodic text too. That is word 8 at the latest, and
    the next ``window - 8`` words are inside; the names it takes to decide reach to word 8. If adjacent words
    j - 1 and j are equal, the place j itself is an anchor, with the phrase that begins there (j <= 8) or the one
    that ends there (j >= window - 9). Either way two equal windows share a phrase, and ``near`` below finds it.
    Windows must have at least 13 words.
    """
    n = phrase_size(window)
    starts, _ = symbol_starts(names, batch.doc)
    keys = windows(names, n, LANES[0])
    repeat = np.zeros(len(names), bool)
    repeat[1:] = (names[1:] == names[:-1]) & (batch.doc[1:] == batch.doc[:-1])
    repeat = np.flatnonzero(repeat)
    place = np.concatenate((starts, repeat, repeat[repeat >= n - 1] - (n - 1)))
    place = np.unique(place[place < len(keys)])
    place = place[_same_doc(batch, n - 1)[place]]
    return place, keys[place]


def _batch(table: pa.Table) -> tuple[pa.Table, Batch, np.ndarray]:
    """A chunk's rows in the same order each time, with their words."""
    rows = table.sort_by([("doc_id", "ascending"), ("_row", "ascending")])
    batch = Batch([t.encode() for t in rows.column("text").to_pylist()])
    return rows, batch, batch.names(1)


def _ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids (null: 0) and which of them are null."""
    ids = rows.column("doc_id")
    return ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy()


def _candidates(names: np.ndarray, batch: Batch, window: int, shared: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Places of the windows that hold a phrase which several documents hold; none in the texts to ``skip``."""
    place, key = anchors(names, batch, window)
    hit = np.zeros(len(names) + 1, np.int64)
    hit[place[np.isin(key, shared)]] = 1
    seen = np.concatenate(([0], np.cumsum(hit[:-1])))
    last = len(names) - window + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(last)
    near = seen[at + window - phrase_size(window) + 1] > seen[at]
    return at[near & _same_doc(batch, window - 1)[:last] & ~skip[batch.doc[:last]]]


def _distinct(names: np.ndarray, batch: Batch, at: np.ndarray, window: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows at ``at``: two name lanes, the least document rank, and each place's entry.

    Documents come by rank, so a stable sort leaves the least first. (Should two windows share one lane, an
    entry may come twice; its owner merges it.)
    """
    one = windows(names, window, LANES[0])[at]
    two = windows(mix(names + _U(7)), window, LANES[1])[at]
    order = np.argsort(one, kind="stable")
    a, b, d = one[order], two[order], rank[batch.doc[at]][order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(new) - 1
    return a[new], b[new], d[new], entry


def _spread(names: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each name: its high half scaled to the owners, so sorted names stay together."""
    return ((names >> _U(32)) * _U(owners) >> _U(32)).astype(np.int64)


def _blobs(owner: np.ndarray, *columns: np.ndarray, bits: int = 0) -> list[tuple[int, list[bytes]]]:
    """Sorted ``owner`` with its columns, as one record an owner; the last ``bits`` columns are flags, packed."""
    whole = len(columns) - bits
    head = np.flatnonzero(np.diff(owner, prepend=-1))
    tail = np.append(head[1:], len(owner))[: len(head)]
    return [(int(owner[a]), [c[a:b].tobytes() if i < whole else np.packbits(c[a:b]).tobytes() for i, c in enumerate(columns)]) for a, b in zip(head, tail, strict=True)]


def owners_for(size: int) -> int:
    """How many owners share the names of ``size`` bytes of text: independent of the chunks, and with a fixed load each.

    A chunk sends a row to each owner at most, so rows a step are OWNERS a chunk up to 4 GB of text and never more than names.
    """
    return max(min(OWNERS, int(size // SMALL_BYTES) + 1), int(size // OWNER_BYTES) + 1)


def ranges(sent: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """For each of the sorted arrays ``sent``, where ``parts`` even ranges of their common values begin and end."""
    some = [x for x in sent if len(x)]
    low, high = min(int(x[0]) for x in some), max(int(x[-1]) for x in some)
    edges = np.array([low + (high - low + 1) * k // parts for k in range(parts)], np.uint64)
    return [np.append(np.searchsorted(x, edges), len(x)) for x in sent]


def dedup(docs: DataFrame, window: int = 13, chunk_bytes: int = 4 << 20, carry: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null texts have no words; texts of fewer than ``window``
    words keep all; repeated rows of one doc_id are one document for this purpose, so they do not remove
    each other; rows with a null doc_id keep their words and remove none of others. Other columns are ignored.
    ``carry`` adds ``text`` (the kept words joined by one space, or the text itself where nothing goes) and
    ``rest``, a column of ``docs`` that goes along.

    Chunks hold about ``chunk_bytes`` of text, owners the names of about OWNER_BYTES, so both keep their size as the corpus
    grows. Equal rows are dealt to chunks by the partition they come from too, so no chunk gets them all.
    """
    if window < 13:
        raise ValueError("window must be at least 13 words")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *(["rest"] if carry else []))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(size // chunk_bytes) + 1
    rows = rows.withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("chunk", F.pmod(F.xxhash64("_row", F.spark_partition_id()), F.lit(chunks)))
    owners = owners_for(size)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    if carry:
        schema = schema.add("text", "string").add("rest", rows.schema["rest"].dataType)
    out_schema = to_arrow_schema(schema)
    found_ddl = "owner long, chunk long, a binary, b binary, doc binary"
    found_schema = to_arrow_schema(T.StructType.fromDDL(found_ddl))

    @tidy
    def reveal(_, part):
        _, batch, names = _batch(part)
        place, key = anchors(names, batch, window)
        doc = batch.doc[place]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        several = np.logical_or.reduceat(np.concatenate(([False], ~new[1:] & (doc[1:] != doc[:-1]))), np.flatnonzero(new)) if len(key) else new
        key = key[new]
        blobs = _blobs(_spread(key, owners), (key & _U(0xFFFFFFFF)).astype("<u4"), np.asarray(several, np.uint8), bits=1)
        chunk = part.column("chunk")[0].as_py()
        return pa.table({"owner": pa.array([o for o, _ in blobs], pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64()), "names": pa.array([b[0] for _, b in blobs], pa.binary()), "several": pa.array([b[1] for _, b in blobs], pa.binary())})

    @tidy
    def report(part):
        sent = [np.frombuffer(x, "<u4") for x in part.column("names").to_pylist()]
        low = np.concatenate(sent)
        several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)) for b, x in zip(part.column("several").to_pylist(), sent, strict=True)]).astype(bool)
        order = np.argsort(low)
        new = np.ones(len(low), bool)
        new[1:] = low[order][1:] != low[order][:-1]
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(low)))
        shared = np.empty(len(low), bool)
        shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(several[order], head), size)
        ends = np.cumsum([len(x) for x in sent])
        masks = [np.packbits(shared[e - len(x) : e]).tobytes() for x, e in zip(sent, ends, strict=True)]
        return pa.table({"chunk": part.column("chunk"), "owner": part.column("owner"), "mask": pa.array(masks, pa.binary())})

    def shared_of(masks, key):
        """The chunk's own names, sorted as they were sent, that the masks mark."""
        key = np.unique(key)
        owner = _spread(key, owners)
        out = []
        for o, m in zip(masks["owner"], masks["mask"], strict=True):
            a, b = np.searchsorted(owner, [o, o + 1])
            out.append(key[a:b][np.unpackbits(np.frombuffer(m, np.uint8), count=b - a).astype(bool)])
        return np.concatenate(out) if out else key[:0]

    @tidy
    def verify(_, left, right):
        if not left.num_rows:
            return found_schema.empty_table()
        part, batch, names = _batch(left)
        rank, no_id = _ids(part)
        known = shared_of(right.to_pandas(), anchors(names, batch, window)[1])
        at = _candidates(names, batch, window, known, no_id)
        a, b, d, _ = _distinct(names, batch, at, window, rank)
        blobs = _blobs(_spread(a, owners), a.astype("<u8"), b.astype("<u8"), d.astype("<i8"))
        places = np.zeros(len(names), bool)
        places[at] = True
        chunk = left.column("chunk")[0].as_py()
        blobs.append((-1 - chunk, [None, None, np.packbits(places).tobytes()]))  # the chunk's own note to itself
        columns = [pa.array([o for o, _ in blobs], pa.int64()), pa.array([chunk] * len(blobs), pa.int64()), *(pa.array([x[i] for _, x in blobs], pa.binary()) for i in range(3))]
        return pa.Table.from_arrays(columns, schema=found_schema)

    @tidy
    def settle(part):
        if part.column("owner")[0].as_py() < 0:
            return part.select(["chunk", "owner", "doc"])
        one, two, docs_ = ([np.frombuffer(x, t) for x in part.column(c).to_pylist()] for c, t in (("a", "<u8"), ("b", "<u8"), ("doc", "<i8")))
        least = [np.empty(len(x), "<i8") for x in one]
        parts = sum(map(len, one)) // SETTLE + 1
        cuts = ranges(one, parts)
        for k in range(parts):
            at = [slice(c[k], c[k + 1]) for c in cuts]
            a, b, d = (np.concatenate([x[i] for x, i in zip(xs, at, strict=True)]) for xs in (one, two, docs_))
            if not len(a):
                continue
            order = np.argsort(a)
            same = a[order][1:] == a[order][:-1]
            if (b[order][1:][same] != b[order][:-1][same]).any():
                order = np.lexsort((b, a))
                same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
            head = np.flatnonzero(np.concatenate(([True], ~same)))
            low = np.empty(len(a), "<i8")
            low[order] = np.repeat(np.minimum.reduceat(d[order], head), np.diff(np.append(head, len(a))))
            ends = np.cumsum([i.stop - i.start for i in at])
            for x, i, e in zip(least, at, ends, strict=True):
                x[i] = low[e - (i.stop - i.start) : e]
        return pa.table({"chunk": part.column("chunk"), "owner": part.column("owner"), "doc": pa.array([x.tobytes() for x in least], pa.binary())})

    @tidy
    def apply(_, left, right):
        if not left.num_rows:
            return out_schema.empty_table()
        part, batch, names = _batch(left)
        rank, _ = _ids(part)
        answers = dict(zip(right.column("owner").to_pylist(), right.column("doc").to_pylist(), strict=True))
        places = answers.pop(-1 - left.column("chunk")[0].as_py())
        at = np.flatnonzero(np.unpackbits(np.frombuffer(places, np.uint8), count=len(names)))
        _, _, d, entry = _distinct(names, batch, at, window, rank)
        least = np.concatenate([d[:0], *(np.frombuffer(answers[o], "<i8") for o in sorted(answers))])
        begins = np.zeros(len(names), bool)
        begins[at[least[entry] < rank[batch.doc[at]]]] = True
        gone = covered(begins, window, len(names))
        n_words = np.diff(batch.first)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[batch.first])
        texts = kept_texts(batch, ~gone)
        out = {"doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        if carry:
            before = part.column("text").to_pylist()
            out |= {"text": pa.array([t.decode() if n else b for t, n, b in zip(texts, removed, before, strict=True)], pa.string()), "rest": part.column("rest")}
        return pa.table(out)

    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.applyInArrow(reveal, "owner long, chunk long, names binary, several binary")
    masks = sent.groupBy("owner").applyInArrow(report, "chunk long, owner long, mask binary")
    found = by_chunk.cogroup(masks.groupBy("chunk")).applyInArrow(verify, found_ddl)
    answers = found.groupBy("owner").applyInArrow(settle, "chunk long, owner long, doc binary")
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(apply, schema)


def kept_texts(batch: Batch, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    edges = np.zeros(len(batch.data) + 1, np.int8)
    edges[batch.starts[keep]] += 1
    edges[batch.ends[keep] + 1] -= 1  # with the byte after the word
    mask = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    data = batch.data.copy()
    data[batch.ends] = 0x20
    flat = data[mask].tobytes()
    upto = np.concatenate(([0], np.cumsum((batch.ends + 1 - batch.starts) * keep)))[batch.first].tolist()
    return [flat[a:b].rstrip(b" ") for a, b in zip(upto, upto[1:], strict=False)]


def op2_dedup_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the words that repeat an earlier document's passage.

    Texts that lose all their words go.
    """
    out = dedup(pack_columns(docs), carry=True).filter("n_removed < n_words or n_words = 0")
    return unpack_columns(out, docs.columns, counted=True)


OP2_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13),
k as (select doc_id, i, array_to_string(w[i:i+12], ' ') as s from p),
m as (select s, min(doc_id) as d from k group by s having min(doc_id) < max(doc_id)),
g as (select distinct k.doc_id, unnest(range(k.i, k.i + 13)) as i from k join m on k.s = m.s and k.doc_id > m.d),
r as (select doc_id, list(i) as gone from g group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string([x for x, j in w if gone is null or not list_contains(gone, j)], ' ')) as kept_sha256
from w left join r on w.doc_id = r.doc_id
"""
