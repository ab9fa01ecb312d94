from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm import chat, mixing, packing, quality, recompression, simhash, suffixes
from tallymark.llm.words import Batch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, chunk string, _row string"


def passage(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "x", "y") for r in rows], DOCS)


HARD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, passage(30)), (6, "pre " + passage(20) + " post"), (7, passage(30)), (7, passage(30)),
    (8, "a " * 40), (9, "b " + "a " * 13), (10, passage(12)), (11, passage(13)), (12, passage(5000, 100)), (13, passage(40, 4000) + " x"), (14, "é" * 60), (15, "x" + "é" * 60),
    (None, passage(30)), (16, "a\x0bb\x0cc " * 20), (17, "\x00" * 120), (18, "\x00" * 60),
]


def words_removed(rows, n=13):
    first, out = {}, []
    parts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    for d, w in parts:
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                first[k] = min(d, first.get(k, d))
    for d, w in parts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def bytes_removed(rows, n=50):
    first, out = {}, []
    parts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in parts:
        if d is not None:
            for i in range(len(b) - n + 1):
                first[b[i : i + n]] = min(d, first.get(b[i : i + n], d))
    for d, b in parts:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if d is not None and first[b[i : i + n]] < d:
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, n=60):
    """Short texts over few words, with copied passages, so that windows overlap and repeat."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        t = list(rng.choice(["a", "b", "c", "aa", "dd"], rng.integers(0, 60)))
        if texts and rng.random() < 0.7:
            o = texts[rng.integers(len(texts))]
            k = rng.integers(0, len(o) + 1)
            t = t[:5] + o[k : k + rng.integers(5, 40)] + t[5:]
        texts.append(t)
    return [(int(d), " ".join(t)) for d, t in zip(rng.permutation(n), texts)]


@pytest.mark.parametrize("rows", [HARD, random_rows(1), random_rows(2, 90)], ids=["hard", "random", "more"])
@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_recompression_is_exact(spark, rows, chunk):
    got = recompression.dedup(docs(spark, rows), chunk_bytes=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == words_removed(rows)


@pytest.mark.parametrize("rows", [HARD, random_rows(3)], ids=["hard", "random"])
@pytest.mark.parametrize("chunk, shard, frequent", [(300, 200, 1024), (1 << 20, 1 << 20, 1024), (2000, 1 << 20, 3)])
def test_suffix_arrays_are_exact(spark, rows, chunk, shard, frequent):
    got = suffixes.dedup(docs(spark, rows), chunk_bytes=chunk, shard_bytes=shard, frequent_pieces=frequent).collect()
    assert sorted((tuple(r) for r in got), key=str) == bytes_removed(rows)


def test_a_phrase_in_many_texts_is_no_owners_burden(spark):
    """A phrase too short to match on its own in 3,000 otherwise different texts, and a few real repeats around it: exact, and no name has many pieces."""
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    junk = lambda n: "".join(rng.choice(letters, n))
    rows = [(i, junk(80) + "the very common line that opens all such texts" + junk(80)) for i in range(3000)]
    rows += [(3000 + i, "x" + rows[7 * i][1][30:150] + "y") for i in range(50)]
    got = suffixes.dedup(docs(spark, rows), chunk_bytes=1 << 16, frequent_pieces=500).collect()
    assert sorted((tuple(r) for r in got), key=str) == bytes_removed(rows)
    b = suffixes.Bytes([t.encode() for _, t in rows], 50)
    start, length = b.runs(b.valid)
    names, many = np.unique(b.names(start), return_counts=True)
    hot = np.isin(b.names(start), names[many > 500])
    assert hot.any()
    single = np.zeros(b.size, bool)
    for s, n in zip(start[hot], length[hot]):
        single[s : s + n] = True
    assert np.unique(b.names(b.runs(b.valid, single)[0], single), return_counts=True)[1].max() <= 500


def test_rows_of_an_exchange_grow_with_the_input():
    """A chunk of 4 MB meets OWNERS owners up to 4 GB, and always a row holds many names."""
    assert recompression.owners_for(0) == 1 and recompression.owners_for(64 << 20) == recompression.owners_for((4 << 30) - 1) == recompression.OWNERS
    size = 1 << 40
    rows = size // (4 << 20) * recompression.owners_for(size)
    assert rows < size / 20  # a name for 20 bytes of text


def test_ranges_cover_all_names():
    sent = [np.array([1, 5, 9], np.uint64), np.zeros(0, np.uint64), np.array([5, 2**64 - 1], np.uint64)]
    for parts in (1, 2, 7):
        cuts = recompression.ranges(sent, parts)
        assert all(c[0] == 0 and c[-1] == len(x) and (np.diff(c) >= 0).all() and len(c) == parts + 1 for c, x in zip(cuts, sent))


def test_equal_rows_are_dealt_to_several_chunks(spark):
    rows = [(1, passage(40))] * 200 + [(2, passage(60))]
    d = docs(spark, rows).repartition(8)
    assert sorted(tuple(r) for r in recompression.dedup(d, chunk_bytes=2000).collect()) == words_removed(rows)
    assert sorted(tuple(r) for r in suffixes.dedup(d, chunk_bytes=2000).collect()) == bytes_removed(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=60), st.integers(0, 12), st.integers(0, 12))
def test_equal_windows_share_a_phrase(words, left, right):
    """The guarantee behind the candidate filter: a 13-word window has a common phrase in any two contexts."""
    window = words[:13]
    one = ["p%d" % (i % 3) for i in range(left)] + [f"x{w}" for w in window] + [f"x{w}" for w in words[13:]]
    two = [f"x{w}" for w in words[13:]] + [f"x{w}" for w in window] + ["q%d" % (i % 2) for i in range(right)]
    found = []
    for text, at in ((one, left), (two, len(words) - 13)):
        batch = Batch([" ".join(text).encode()])
        place, key = recompression.anchors(batch.names(1), batch, 13)
        inside = (place >= at) & (place + recompression.phrase_size(13) <= at + 13)
        found.append(set(zip((place[inside] - at).tolist(), key[inside].tolist())))
    assert found[0] & found[1]


def test_copies_of_periodic_passages_go(spark):
    import duckdb

    rows = []
    for period in (2, 3, 4):
        for k in range(12):
            text = " ".join(f"p{period}{k}{i % period}" for i in range(40 + 5 * k))
            rows += [(len(rows), text), (len(rows) + 1, text if k % 2 else f"x{period}{k} {text} y")]
    got = sorted(tuple(r) for r in recompression.dedup(docs(spark, rows)).collect())
    base = duckdb.connect()
    base.execute("create table documents (doc_id bigint, text varchar)")
    base.executemany("insert into documents values (?, ?)", rows)
    assert got == sorted(base.execute(recompression.OP2_SQL).fetchall()) == sorted(words_removed(rows))
    assert all(r[2] >= 40 for r in got if r[0] % 2)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 3), st.sampled_from([1, 3, 4]), st.sampled_from([1, 7, 128]))
def test_suffix_array_sorts(data, alphabet, times, stretch):
    suffixes.STRETCH = stretch
    text = np.frombuffer((bytes(b % alphabet for b in data) + b"\x01") * times, np.uint8)
    if not len(text):
        return
    raw, sa = text.tobytes(), suffixes.suffix_array(text, 64)
    keys = [raw[i : i + 64] for i in sa]
    assert keys == sorted(keys)
    lcp = suffixes.common_prefixes(text, sa, 50)
    suffixes.STRETCH = 128
    for i in range(1, len(sa)):
        a, b = raw[sa[i - 1] :], raw[sa[i] :]
        n = next((k for k in range(min(len(a), len(b), 50)) if a[k] != b[k]), min(len(a), len(b), 50))
        assert lcp[i] == n


def test_empty_tables(spark):
    none = docs(spark, HARD).limit(0)
    assert recompression.dedup(none).count() == 0
    assert suffixes.dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert packing.pack(packing.tokenize(none)).count() == 0
    a, b = mixing.mix(none)
    assert a.count() == 0 and b.count() == 0
    assert chat.render(chat.fold(spark.createDataFrame([], "conv_id long, seq long, message long, kind string, role string, text string"))).count() == 0


# ---- SimHash --------------------------------------------------------------------------------------


def reference_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    base = passage(200)
    rows = [*HARD, (30, base), (31, base + " extra"), (32, base.upper()), (33, "other " + base)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [reference_print(t) for _, t, *_ in rows]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64) for r in got) == sorted((d if d is not None else -1, p) for (d, *_), p in zip(rows, prints))
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (d, *_), l in zip(rows, label):
        if d is not None:
            least[l] = min(d, least.get(l, d))
    want = sorted((str(d), str(least.get(l))) for (d, *_), l in zip(rows, label))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


BIG = [(2**60 + 1, passage(30)), (2**60 + 3, passage(30, 500)), (None, "x"), (2**60 + 5, passage(30))]


def test_large_ids_beside_a_null_stay_exact(spark):
    d = docs(spark, BIG).coalesce(1)
    assert sorted(str(r.doc_id) for r in simhash.near_duplicates(d).collect()) == sorted(str(r[0]) for r in BIG)
    assert {r.component_id for r in simhash.near_duplicates(d).collect()} == {2**60 + 1, 2**60 + 3, None}
    assert sorted(str(r.doc_id) for r in packing.pack(packing.tokenize(d)).collect()) == sorted(str(r[0]) for r in BIG)
    assert sorted(str(r.doc_id) for r in packing.pack_stage(spark, d, "").collect()) == sorted(str(r[0]) for r in BIG)
    assert sorted(str(r.doc_id) for r in simhash.dedup_stage(spark, d, "").collect()) == sorted(str(r[0]) for r in BIG[:3])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 3), st.integers(0, 12))
def test_trie_connects_what_pairs_connect(seeds, budget, depth):
    rng = np.random.default_rng(len(seeds))
    prints = {s >> depth for s in seeds}
    for s in list(prints):
        for _ in range(3):
            prints.add(s ^ (1 << int(rng.integers(0, 64 - depth))))
    a = np.array(sorted(prints), np.uint64)
    i, j = simhash.trie_pairs(a, a, depth, budget, True)
    close = np.bitwise_count(a[:, None] ^ a[None, :]) <= budget
    assert close[i, j].all()

    def components(links):
        label = list(range(len(a)))
        for _ in range(len(a)):
            for x, y in links:
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert components(list(zip(i.tolist(), j.tolist()))) == components(list(zip(*(x.tolist() for x in np.nonzero(close)))))


@pytest.mark.parametrize("node_size", [1, 4, 1024])
def test_linking_is_the_same_at_any_node_size(spark, node_size):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(-(2**63), 2**63 - 1, 60).tolist())
    fps |= {f ^ (1 << int(rng.integers(62))) for f in list(fps)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tallymark.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(simhash.link_fingerprints(df, 2, node_size)).collect()}
    nodes = sorted(fps)
    label = {f: f for f in nodes}
    for _ in nodes:
        for x in nodes:
            for y in nodes:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                    label[x] = label[y] = min(label[x], label[y])
    assert {f: got.get(f, f) for f in nodes} == label


def test_of_each_group_one_document_stays(spark):
    rows = [(5, passage(100)), (3, passage(100)), (3, passage(100)), (9, passage(50, 500)), (None, passage(100)), (None, "alone")]
    out = simhash.dedup_stage(spark, docs(spark, rows), "")
    assert out.columns == docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]


def test_documents_of_null_or_equal_ids_stay(spark):
    rows = [(None, passage(40)), (None, passage(40, 100)), (None, passage(40, 200)), (None, passage(40)), (4, passage(40, 300)), (4, passage(40, 400)), (5, passage(40, 500)), (None, passage(40, 500))]
    out = simhash.dedup_stage(spark, docs(spark, rows), "")
    want = [(None, passage(40)), (None, passage(40, 100)), (None, passage(40, 200)), (4, passage(40, 300)), (4, passage(40, 400)), (5, passage(40, 500))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_texts_of_jaccard_four_fifths_link(spark):
    """Edited copies go at 0.8 or more and stay below; copies that meet only through a third go with it."""
    rows = []
    for k in range(30):
        base = [f"w{k}x{i}" for i in range(100)]
        rows.append((2 * k, " ".join(base)))
        for at in (10, 50)[: 1 + k % 2]:
            base[at] = "changed"
        rows.append((2 * k + 1, " ".join(base)))
    far = [f"z{i}" for i in range(100)]
    rows += [(100, " ".join(far)), (101, " ".join(["q"] * 30 + far[30:]))]
    hub = [f"h{i}" for i in range(100)]
    rows += [(200 + k, " ".join(hub[: 10 * k + 5] + ["new", "one"] + hub[10 * k + 7 :])) for k in range(1, 9)] + [(300, " ".join(hub))]
    assert all(0.8 <= jaccard(rows[2 * k][1], rows[2 * k + 1][1]) < 1 for k in range(30)) and jaccard(rows[60][1], rows[61][1]) < 0.8
    hubs = [r[1] for r in rows if 200 < r[0] < 300]
    assert all(jaccard(a, b) < 0.8 for a in hubs for b in hubs if a != b) and all(jaccard(a, rows[-1][1]) >= 0.8 for a in hubs)
    kept = sorted(r.doc_id for r in simhash.dedup_stage(spark, docs(spark, rows), "").collect())
    assert kept == [*range(0, 60, 2), 100, 101, 201]


def test_the_trie_links_what_bands_miss(spark):
    """Texts of Jaccard 0.8 and one fingerprint that share no band of min-hashes meet in the trie; equal fingerprints of other sets stay apart."""
    from tallymark.llm import similar

    rows = []
    for k in (11642, 15436, 20118):
        tail = "a " * 400 + " ".join(f"s{k}w{i}" for i in range(7))
        rows += [(k, tail + " x"), (k + 1, tail + " y")]
    for (_, a), (_, b) in zip(rows[::2], rows[1::2]):
        bands = similar.signatures(*similar.shingle_sets([a, b], 5))[2]
        assert jaccard(a, b) == 0.8 and simhash.fingerprint(a, 5) == simhash.fingerprint(b, 5) and not (bands[0] == bands[1]).any()
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    assert sorted(r.doc_id for r in simhash.dedup_stage(spark, docs(spark, rows), "").collect()) == [11642, 15436, 20118]


# ---- mixing ---------------------------------------------------------------------------------------


def test_targets_share_what_caps_leave(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    caps, weight, level = {"a": 200, "b": 20, "c": 2000, None: 0}, {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * 1110
    fixed = {}
    while True:  # the rule as stated: fix what is above its cap, share the rest anew
        rest = {s: w for s, w in weight.items() if s not in fixed}
        share = {s: (level - sum(fixed.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: caps[s] for s in rest if share[s] > caps[s]}
        if not over:
            break
        fixed |= over
    want = fixed | share
    assert {s: pytest.approx(t) for s, t in want.items()} == got


def test_mix_is_near_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), ["a", "b", "c", "d", None][int(rng.integers(5))]) for i in range(400)] + [(None, None, "a"), (7, "x y", "b"), (7, "x y", "b")]
    found, pieces = mixing.mix(docs(spark, rows))
    found, pieces = found.collect(), pieces.collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] += r.size
    for s, (taken, target, size) in by.items():
        assert abs(taken - target) <= 0.5, s
    assert sum(t[1] for t in by.values()) == pytest.approx(1.5 * sum(t[2] for t in by.values()))
    spans = {}
    for p in pieces:
        spans.setdefault((p.key, p.twin, p.epoch), []).append((p.from_word, p.to_word))
    for s in spans.values():  # a document's pieces follow each other
        s.sort()
        assert all(a[1] == b[0] for a, b in zip(s, s[1:]))
    for n in (3, 7):  # however the table is split
        again = sorted(tuple(r) for r in mixing.mix(docs(spark, rows).repartition(n))[0].fillna(-1).fillna("").collect())
        assert again == sorted(tuple(r) for r in spark.createDataFrame(found).fillna(-1).fillna("").collect())


@pytest.mark.parametrize("block", [1, 64, 4096])
def test_small_sources_reach_their_targets(spark, block):
    """Tiny sources beside a huge one, with blocks far larger than they are; repeated rows and one source without words."""
    rows = [(i, "w " * 900, "big") for i in range(60)] + [(100 + i, "v " * (7 + i), f"tiny{i}") for i in range(9)] + [(200, None, "none")] + [(300, "u u", "same")] * 2500
    found, pieces = mixing.mix(docs(spark, rows), slots=1, max_block=block)
    by = {}
    for r in found.collect():
        assert r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert len(by) == 12 and all(abs(t - target) <= 0.5 for t, target in by.values())
    assert found.filter("source = 'same'").count() == 2500
    blocks = pieces.groupBy("slot", "source").count().collect()
    assert {r.source for r in blocks} == set(by) - {"none"}


def test_schedule_is_low_discrepancy(spark):
    goals = spark.createDataFrame([("a", 500.0), ("b", 300.0), ("c", 200.0)], "source string, target double")
    rows = sorted(mixing.schedule(goals, 1).collect())
    assert len(rows) == 1000
    for source, n in (("a", 500), ("b", 300), ("c", 200)):
        assert sorted(r["rank"] for r in rows if r.source == source) == list(range(n))
    seen = {"a": 0, "b": 0, "c": 0}
    for i, r in enumerate(rows):
        seen[r.source] += 1
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(seen[s] - share * (i + 1)) < 5


def test_mix_stage_cuts_to_the_words_taken(spark):
    rows = [(i, passage(20 + i), "ab"[i % 2]) for i in range(30)] + [(40, None, "a"), (None, "x y z", None)] + [(50, "p q", "a")] * 5
    d = docs(spark, rows)
    out = mixing.mix_stage(spark, d, "")
    assert out.columns == d.columns
    taken = sum(r.taken for r in mixing.mix(d)[0].collect())
    assert taken == round(sum(r.target for r in mixing.mix(d)[0].select("source", "target").distinct().collect()))
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) == taken


# ---- packing --------------------------------------------------------------------------------------


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_hold_the_tokenizers_ids(spark):
    texts = [None, "", "hello world", "<|endoftext|> x", "é\x00\n\n  tabs\t", "word " * 3000, "日本語" * 700]
    rows = packing.pack(packing.tokenize(docs(spark, list(enumerate(texts))))).collect()
    for d, text in enumerate(texts):
        ids = ids_of(text)
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and mine[0].start == 0
        assert all(r.length == 1024 for r in mine[1:]) and sum(r.length for r in mine) == len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), min_size=1))
def test_rounds_are_best_fit_decreasing(counts):
    place, seen = {}, {}
    for length, a, b, first, each, offset in packing.rounds(counts, 16):
        assert a == seen.get(length, 0)
        seen[length] = b
        for r in range(a, b):
            place.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * length, length))
    assert seen == counts
    for s in place.values():
        s.sort()
        assert s[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 16
    bins = []
    for length in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fit = [b for b in bins if b[0] >= length]
        if fit:
            min(fit)[0] -= length
        else:
            bins.append([16 - length])
    assert len(place) == len(bins)


def test_sequences_are_gapless(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i * 37 % 1024) for i in range(500)] + [(1, 0, 38)], "doc_id long, piece int, length long")
    by = {}
    for r in packing.pack(pieces).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and sum(x[1] for x in s) <= 1024
    total = sum(1 + i * 37 % 1024 for i in range(500)) + 38
    assert len(by) <= 1.05 * total / 1024 + 1


# ---- chats ----------------------------------------------------------------------------------------


def test_edits_and_regenerations_fold(spark):
    events = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", None, "lo"), (1, 3, 1, "delta", "assistant", "wrong"), (1, 4, 1, "regenerate", None, None),
        (1, 5, 1, "delta", None, "right"), (1, 6, 0, "edit", None, "Hi"), (1, 7, 0, "delta", None, "!"), (1, 8, 2, "delta", "user", "gone"), (1, 9, 2, "regenerate", "user", "x"), (None, 1, 0, None, None, "n"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(df.repartition(5)).collect()}
    assert got == {(1, 0): ("user", "Hi!"), (1, 1): ("assistant", "right"), (1, 2): ("user", ""), (None, 0): (None, "n")}


def folded(events):
    """The messages of a log, folded event by event."""
    kinds = {"edit": 0, "regenerate": 1}

    def order(e):
        return (e[1] is not None, e[1] or 0), kinds.get(e[3], 2), (e[4] is not None, e[4] or ""), e[5] or ""

    out = {}
    for e in sorted(events, key=order):
        conv, _, message, kind, role, text = e
        was = out.get((conv, message), (None, ""))
        text = text or ""
        if kind == "edit":
            now = text
        elif kind == "regenerate":
            now = ""
        else:
            now = was[1] + text
        out[conv, message] = (role if role is not None else was[0], now)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_fold_of_random_logs(spark, seed):
    """Deltas, edits and regenerations with ties, missing roles, texts and numbers, against a plain fold; then the loss mask."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    events = []
    for _ in range(400):
        seq = None if rng.random() < 0.05 else int(rng.integers(0, 60))
        events.append((pick(1, 2, 3, None), seq, int(rng.integers(0, 6)), pick("delta", "delta", "delta", "edit", "regenerate", None, "odd"), pick("user", "assistant", None, None), pick("a", "b<|", "[INST]", "", None)))
    events += events[:40]  # repeated events
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string").repartition(5)
    messages = chat.fold(df).cache()
    want = folded(events)
    assert {(r.conv_id, r.message): (r.role, r.text) for r in messages.collect()} == want
    back = {}
    for r in chat.read_back(chat.render(messages)).collect():
        back.setdefault(r.conv_id, []).append((r.position, r.role, r.text, r.learned))
    for conv, turns in back.items():
        mine = [want[k] for k in sorted(k for k in want if k[0] == conv)]
        assert [(r, t, x or "") for _, r, t, x in sorted(turns)] == [(r or "", t, t if r == "assistant" else "") for r, t in mine]


def test_conversations_come_back_from_their_log(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * (t + c) + "é") for c in range(3) for t in range(7)] + [(9, 0, None, None), (9, 1, "assistant", "")]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"}
    got = sorted(((r.conv_id, r.message - 1, r.role, r.text) for r in chat.fold(log).collect()), key=str)
    assert got == sorted(((c, t, r, x or "") for c, t, r, x in rows), key=str)


def test_texts_survive_the_template(spark):
    rng = np.random.default_rng(3)
    atoms = ["<", "|", "\\", "[", "INST]", "/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", chat.START, chat.END, chat.NEWLINE, "\n", "x", "é", "$1", "😀"]
    texts = ["".join(rng.choice(atoms, rng.integers(0, 9))) for _ in range(300)] + [None, ""]
    roles = ["assistant", "user", None, "odd\nrole <|im_end|>"]
    rows = [(i // 7, i % 7, roles[i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold(chat.conversation_events(df))).cache()
    back = {(r.conv_id, r.position): r for r in chat.read_back(formatted).collect()}
    assert len(back) == len(rows)
    for c, t, role, text in rows:
        r = back[c, t]
        assert (r.role, r.text) == (role or "", text or "")
        assert (r.learned or "") == ((text or "") if role == "assistant" else "")
    for r in formatted.collect():
        turns = [x for x in rows if x[0] == r.conv_id]
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(turns)
        assert not re.search(r"\[/?INST\]|</?s>|<</?SYS>>", r.formatted)
        for s, learned in zip(r.loss_spans, (x for x in turns if x[2] == "assistant"), strict=True):
            assert len(r.formatted[s.start : s.end]) >= len(learned[3] or "")


CLASHES = ["row", "epoch", "a", "b", "size", "nth", "chunk", "_row", "_id", "kept", "log_weight", "gumbel_key", "fp", "component_id", "rest", "source", "n_words", "quality"]


@pytest.mark.parametrize("stage", [quality.quality_stage, simhash.dedup_stage, recompression.dedup_stage, mixing.mix_stage])
def test_stages_keep_clashing_columns(spark, stage, tmp_path):
    d = spark.createDataFrame([(i, passage(30 + i, 100 * i), *[f"{c}{i}" if c != "source" else "s" for c in CLASHES], 7) for i in range(12)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES) + ", n_chars long")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, d, str(tmp_path))
    assert out.dtypes == d.dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHES if c != "source")
    if stage is mixing.mix_stage or stage is recompression.dedup_stage:
        assert all(r.n_chars == len(r.text) for r in rows)
    assert stage(spark, d.limit(0), str(tmp_path)).count() == 0


def test_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = chat.read_back(chat.render(chat.fold(chat.conversation_events(df)))).orderBy("position").collect()
    assert [(r.role, r.text) for r in rows] == [("", ""), ("assistant", "b"), ("user", "a"), ("user", "a")]


def test_plans_of_native_operators_have_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.render(chat.fold(chat.conversation_events(df))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_blocks_find_what_hubs_leave(spark, monkeypatch):
    """Texts that share one long passage, so that many share buckets, with near copies among them; without hubs, blocks alone connect all."""
    from tallymark.llm import similar

    rng = np.random.default_rng(4)
    common = passage(60, 9000)
    rows = []
    for k in range(40):
        own = [f"o{k}x{i}" for i in range(int(rng.integers(20, 120)))]
        rows.append((len(rows), common + " " + " ".join(own)))
        own[len(own) // 2] = "changed"
        rows.append((len(rows), common + " " + " ".join(own)))
    rows += [(len(rows) + k, passage(k)) for k in range(8)]
    label = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(i):
                if jaccard(rows[i][1], rows[j][1]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    want = {}
    for (d, _), l in zip(rows, label):
        want.setdefault(l, set()).add(d)
    df = docs(spark, rows).select(F.col("doc_id").alias("key"), "doc_id", "text")
    for rounds, nodes in ((0, 4096), (0, 16), (1, 16), (3, 4096)):
        monkeypatch.setattr(similar, "ROUNDS", rounds)
        monkeypatch.setattr(similar, "BLOCK_NODES", nodes)
        monkeypatch.setattr(similar, "BLOCK_BYTES", 1024 * nodes)
        got = {}
        for r in similar.similar(df).collect():
            got.setdefault(r.component, set()).add(r.doc_id)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), rounds


def test_variants_of_one_form_link_as_all_pairs_do(spark):
    """Two words of 100 differ in each text, so most pairs share buckets and few are similar enough."""
    from tallymark.llm import similar

    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        w = [f"w{i}" for i in range(100)]
        for c in rng.choice(100, 2, replace=False):
            w[c] = f"x{k}c{c}"
        rows.append((k, " ".join(w)))
    label = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    while any(label[i] != label[j] for i, j in close):
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    df = docs(spark, rows).select(F.col("doc_id").alias("key"), "doc_id", "text")
    got = {r.doc_id: r.component for r in similar.similar(df).collect()}
    groups = lambda of: sorted(sorted(i for i in range(len(rows)) if of[i] == c) for c in {of[i] for i in range(len(rows))})
    assert close and groups(got) == groups(label)


def test_sketches_never_differ_in_more_bits_than_sets_in_shingles():
    from tallymark.llm import similar

    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:top], n, replace=False)) for top, n in ((100, 1), (200, 60), (200, 90), (300, 200), (3000, 2000), (3000, 2500), (6000, 5000))]
    maps = similar.sketches(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])))
    for a, x in zip(sets, maps):
        for b, y in zip(sets, maps):
            w = min(len(x), len(y))
            p, q = (np.bitwise_xor.reduce(z.reshape(-1, w), axis=0) for z in (x, y))
            assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))


def test_near_copies_of_the_given_documents_go(spark):
    """Recall of pairs of Jaccard 0.8 or more, by brute force over shared shingles."""
    from itertools import combinations

    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null")
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))) for r in d.collect()}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    close = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    for _ in range(4):
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
    kept = {r.doc_id for r in simhash.dedup_stage(spark, d, sf).collect()}
    near = [p for p in close if sets[p[0]] != sets[p[1]]]
    assert len(near) >= 10 and kept == set(label.values())
