from __future__ import annotations

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import components, licenses, metric_join, quality, topk

VECTORS = "vec_id long, embedding array<float>, label int, cell int, node int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], VECTORS)


def clustered(seed=0, n=300, dim=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    x = [centers[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0.02, 0.3, 2.0]) for _ in range(n)]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(n + k, rows[5][1]) for k in range(20)]  # copies
    rows += [(400, None), (401, [0.0] * dim), (402, [1.0] * (dim - 1) + [None]), (403, [1.0] * (dim - 1) + [math.nan]), (404, []), (405, [math.inf] * dim), (406, [1.0] * 3), (5, rows[5][1])]
    return rows


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v or [])


def brute_links(rows, threshold):
    dim = max(len(v) for _, v in rows if v)
    x = np.array([(v + [0.0] * (dim - len(v))) if good(v) else [0.0] * dim for _, v in rows])
    norm = np.sqrt((x * x).sum(axis=1))
    u = np.divide(x, norm[:, None], where=norm[:, None] > 0, out=np.zeros_like(x))
    g = u @ u.T >= threshold
    g[norm == 0] = g[:, norm == 0] = False
    np.fill_diagonal(g, False)
    return g


@pytest.mark.parametrize("sizes", [(2048, 16384), (16, 50), (4, 7)])
def test_range_join_is_exact(spark, sizes):
    rows = clustered()
    got = metric_join.near_duplicates(vectors(spark, rows), 0.9, *sizes).collect()
    g = brute_links(rows, 0.9)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(g, label[None, :], len(rows)).min(axis=1))
        if (new == label).all():
            break
        label = new
    least = [min(rows[j][0] for j in np.flatnonzero(label == label[i])) for i in range(len(rows))]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((rows[i][0], int(g[i].sum()), least[i]) for i in range(len(rows)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_without_links(spark):
    assert metric_join.near_duplicates(vectors(spark, [(1, None)]).limit(0)).count() == 0
    rows = metric_join.near_duplicates(vectors(spark, [(1, None), (2, [0.0])])).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("tile, shard, k", [(1024, 4096, 5), (3, 7, 5), (2, 3, 1)])
def test_top_k_is_exact(spark, tile, shard, k):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.integers(-3, 4, 6).tolist()) for i in rng.permutation(120)] + [(500, [1] * 5)]
    df = spark.createDataFrame(rows, "id long, values array<bigint>")
    got = topk.search(df.filter("id % 10 = 0"), df, k, tile, shard).collect()
    want = []
    for q, v in rows:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q and len(w) == len(v))[:k]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_large_components_stay_exact():
    a = np.array([[2**40, 3], [-(2**40), 1]], np.int64)
    b = np.array([[5, 2**20], [2**21, 7]], np.int64)
    assert topk.product(a, b).tolist() == [[5 * 2**40 + 3 * 2**20, 2**61 + 21], [-5 * 2**40 + 2**20, -(2**61) + 7]]


def test_few_candidates_give_all(spark):
    df = spark.createDataFrame([(0, [1]), (1, [2]), (2, None)], "id long, values array<bigint>").filter("values is not null")
    assert [tuple(r) for r in topk.search(df.filter("id = 0"), df, 5).collect()] == [(0, 1, 1, 2)]
    assert topk.search(df.limit(0), df, 5).count() == 0


@pytest.mark.parametrize("held, few", [(1 << 22, 1 << 27), (200, 1 << 27), (64, 1)])
def test_top_k_over_many_cells(spark, monkeypatch, held, few):
    """Ties, shared ids, other dimensions and wide components, in one block of queries and in several."""
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "FEW", few)
    rng = np.random.default_rng(7)
    rows = [(int(i), (rng.integers(-2, 3, 4) * 10 ** int(rng.integers(0, 2) * 8)).tolist()) for i in range(150)]
    rows += [(i, [1, 1, 1, 1]) for i in range(200, 260)] + [(10, [2, 0, 1, 1]), (10, [2, 0, 1, 1]), (11, [2, 2, 2, 2]), (20, [3]), (21, [-1]), (22, [2**40])]
    df = spark.createDataFrame(rows, "id long, values array<bigint>").repartition(3)
    got = [tuple(r) for r in topk.search(df.filter("id % 10 = 0"), df, 3, 4, 9).collect()]
    want = []
    for q in sorted({i for i, _ in rows if i % 10 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in rows if i == q for c, w in rows if c != q and len(w) == len(v))[:3]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    assert sorted(got) == want


def test_top_k_broadcasts_nothing(spark):
    """A tile of queries was copied to each group, 537 MB for 61,582 vectors, and Spark broadcast the copies."""
    df = spark.range(300).selectExpr("id", "array(id % 7, id % 11) as values")
    found = topk.search(df.filter("id % 10 = 0"), df, 2)
    assert found.count() == 60
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan


def test_blocks_of_a_search_follow_the_rows(spark):
    """Queries travelled once for each of four times the shuffle partitions, however few rows there were."""
    cells = lambda q, c, dim: topk._grid(*(spark.range(n).select("id", F.array_repeat(F.lit(1), dim).alias("values")) for n in (q, c)), 5)
    assert cells(0, 0, 1) == (1, 4) and cells(20, 1000, 64) == (1, 4)
    high, wide = cells(200_000, 1000, 64)
    assert -(-200_000 // high) * (64 + 10) <= topk.HELD * 1.01 and high * wide < 8


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)] + [(50, 39)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


@pytest.mark.parametrize("task_edges", [8, 1 << 16])
def test_components_are_the_same_whatever_a_task_holds(spark, task_edges):
    rng = np.random.default_rng(3)
    names = rng.permutation(400)
    chain = list(zip(names[:299].tolist(), names[1:300].tolist()))
    edges = [*chain, *((int(names[300]), int(x)) for x in names[301:380]), (7, 7), *chain[:20], *((b, a) for a, b in chain[20:40])]
    df = spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long").repartition(40)
    got = {r.node: r.component for r in components.connected_components(df, task_edges).collect()}
    want = {x: min(group) for group in (names[:300].tolist(), names[300:380].tolist()) for x in group}
    assert got == want


def test_few_links_need_no_rounds(spark):
    names = np.random.default_rng(4).permutation(600).tolist()
    df = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long").repartition(60)
    context = spark.sparkContext
    context.setJobGroup("few links", "")
    found = components.connected_components(df).collect()
    jobs = context.statusTracker().getJobIdsForGroup("few links")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component for r in found} == {0} and len(found) == 600
    assert len(jobs) <= 6


# ---- quality --------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, quality string, kept string, log_weight string"


def corpus(spark, n=120):
    rng = np.random.default_rng(2)
    words = ["the", "of", "and", "to", "river", "stone", "walks", "old", "house", "light"]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(words, rng.integers(1, 80)).tolist()
        junk = i % 4 == 3
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."))
        if i % 2 or i % 3 == 0:
            labels.append((i, 0 if junk else 1))
    docs = spark.createDataFrame([(i, t, "q", "k", "l") for i, t in rows], DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    """Documents without a label are judged by a model that never saw theirs."""
    docs, labels = corpus(spark, 400)
    seen = {r.doc_id for r in labels.collect()}
    got = {r.doc_id: r.kept for r in quality.classify(docs.select("doc_id", "text"), labels).collect()}
    right = [got[i] == (i % 4 != 3) for i in got if i not in seen]
    assert len(right) > 100 and np.mean(right) >= 0.95


def test_models_and_weights_against_plain_counting(spark):
    docs, labels = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}

    def grams(text):
        t = re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]+", text)
        out = [quality.ngrams([w.encode()])[0][0] for w in t]
        return out + [quality.ngrams([f"{a} {b}".encode()])[0][2] for a, b in zip(t, t[1:])]

    of = {i: grams(t) for i, t in texts.items()}
    raw, target = {}, {}
    for i, g in of.items():
        for x in g:
            raw[x] = raw.get(x, 0) + 1
            if i in good:
                target[x] = target.get(x, 0) + 1
    rate = sum(target.values()) / sum(raw.values())
    want = {i: sum(math.log((target.get(x, 0) + 8) / (raw[x] * rate + 8)) for x in g) * min(1, 16 / max(len(g), 1)) for i, g in of.items()}
    got = {r.doc_id: r.log_weight for r in quality.classify(docs.select("doc_id", "text"), labels).collect()}
    assert got == pytest.approx(want)


def test_inclusion_follows_the_weights(spark):
    """Over many seeds each document is kept as often as sampling without replacement by weight keeps it, which no bar on the weight does."""
    docs, labels = corpus(spark, 40)
    narrow = docs.select("doc_id", "text")
    base = quality.scores(narrow, labels, k=12)[0].orderBy("doc_id").toPandas()
    rng, n = np.random.default_rng(0), 4000
    keys = base["log_weight"].to_numpy() + rng.gumbel(size=(n, 40))
    expected = (np.argsort(np.argsort(-keys, axis=1), axis=1) < 12).mean(axis=0)
    model, times = quality.fit(narrow, labels, 20000, 8.0), 400
    noise = narrow.crossJoin(spark.range(times).select(F.col("id").cast("int").alias("seed"))).select("doc_id", "seed", (-F.log(-F.log((F.shiftrightunsigned(F.xxhash64("seed", "doc_id", "text"), 11) + 0.5) / float(1 << 53)))).alias("g")).toPandas()
    g = noise.pivot(index="seed", columns="doc_id", values="g").to_numpy()
    kept = np.argsort(np.argsort(-(base["log_weight"].to_numpy() + g), axis=1), axis=1) < 12
    assert np.abs(kept.mean(axis=0) - expected).max() < 0.12
    one = quality.weigh(narrow, model, 16.0, 7).orderBy("doc_id").toPandas()
    assert one["gumbel_key"].to_numpy() == pytest.approx(base["log_weight"].to_numpy() + noise[noise.seed == 7].sort_values("doc_id")["g"].to_numpy())
    bars = sorted(base["log_weight"])[-12]
    assert any({r.doc_id for r in quality.classify(narrow, labels, k=12, seed=s).filter("kept").collect()} != set(base[base.log_weight >= bars].doc_id) for s in range(3))


@pytest.mark.parametrize("k", [0, 1, 50, 120, 500])
def test_k_rows_are_kept(spark, k):
    docs, labels = corpus(spark)
    assert quality.classify(docs.select("doc_id", "text"), labels, k=k).filter("kept").count() == min(k, 120)


def test_gumbel_top_k_against_a_sort(spark):
    docs, labels = corpus(spark)
    rows = quality.classify(docs.select("doc_id", "text"), labels).collect()
    k = sum(r.kept for r in rows)
    best = sorted(rows, key=lambda r: (-r.gumbel_key, r.doc_id))[:k]
    assert {r.doc_id for r in best} == {r.doc_id for r in rows if r.kept}
    again = {r.doc_id: r.gumbel_key for r in quality.classify(docs.select("doc_id", "text").repartition(7), labels).collect()}
    assert again == {r.doc_id: r.gumbel_key for r in rows}


@pytest.mark.parametrize("k", [1, 17, 200, 399, 400])
def test_bar_is_the_kth_row(spark, k):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(rng.choice([rng.normal(), 0.0, 1e9 * rng.normal()]))) for i in range(400)]
    key, doc = quality.bar_of(spark.createDataFrame(rows, "doc_id long, gumbel_key double"), k, bins=8)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[k - 1]
    assert (key, doc) == (want[1], want[0])


def test_quality_edge_cases(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(900, None, "", "", ""), (901, "", "", "", ""), (None, "the river", "", "", ""), (5, "the river", "", "", ""), (902, "the of and " * 20000, "", "", "")], DOCS)
    both = docs.unionByName(odd)
    out = quality.classify(both.select("doc_id", "text"), labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")))
    assert out.count() == 125
    assert {r.doc_id: r.log_weight for r in out.collect() if r.doc_id in (900, 901)} == {900: 0.0, 901: 0.0}
    twice = docs.unionByName(docs.limit(30)).select("doc_id", "text")
    assert quality.classify(twice, labels.unionByName(labels)).count() == 150
    assert quality.classify(both.select("doc_id", "text"), labels.limit(0)).filter("kept").count() == 125  # no labels: all stay
    assert quality.classify(both.limit(0).select("doc_id", "text"), labels).count() == 0


def test_ngrams_count_all_tokens():
    bucket, doc = quality.ngrams([b"a b!! a", b"", b"x x"])
    assert np.bincount(doc, minlength=3).tolist() == [4 + 3, 0, 2 + 1]
    assert len(set(bucket[doc == 0][:4])) == 3


# ---- licences -------------------------------------------------------------------------------------

CLEAN = ["The river runs by the old house.", "A public road of the general kind", "he was granted free permission to copy software", "by the by, version two of the story", "Sie kam mit dem Zug.", "MIT!! EREIN!! UNG!!"] * 8


def scan(spark, texts):
    model = licenses.fit(CLEAN)
    df = spark.createDataFrame([(i, t, "f", "l") for i, t in enumerate(texts)], "doc_id long, text string, family string, line string")
    return {r.doc_id: r for r in licenses.scan(df, model).collect()}


def test_notices_and_their_absence(spark):
    texts = [
        "Some text.\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.\nmore", "x\nLicensed under the Apache License, Version 2.0.\ny",
        "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: BSD-2-Clause", "All rights reserved.", None, "", "the public road by the house\nof the general version", "She renewed her licence plate.",
        "word " * 20000 + "\nReleased under the MIT License.", "Released under the MIT License.\nReleased under the MIT License.",
    ]
    got = scan(spark, texts)
    assert [got[i].family for i in range(len(texts))] == ["MIT", "GPL", "Apache-2.0", "CC-BY-NC", "CC-BY", "BSD", "Proprietary", *["unknown"] * 4, "MIT", "MIT"]
    assert all(got[i].confirmed == (got[i].family != "unknown") for i in got)
    assert got[12].n_notices == 2 and got[7].probability == 0


def test_held_out_wordings(spark):
    said = {"MIT": "This software is distributed under the MIT license", "Apache-2.0": "Published under the Apache License 2.0", "GPL": "You may redistribute this under the GNU General Public License", "CC-BY-SA": "Shared under CC BY-SA 3.0"}
    got = scan(spark, list(said.values()))
    assert [got[i].family for i in range(len(said))] == list(said)


def test_notices_in_the_sample_are_no_negatives(spark):
    said = [(family, notice) for family, notices in licenses.TEMPLATES.items() for notice in notices] + [("Proprietary", "All rights reserved.")]
    texts = [f"{CLEAN[i % len(CLEAN)]}\n{notice}" for i, (_, notice) in enumerate(said)] + CLEAN[:6]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(licenses.sample_paragraphs(df, 200, 2000))
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    assert [(got[i].family, got[i].confirmed) for i in range(len(said))] == [(family, True) for family, _ in said]
    assert all(got[i].family == "unknown" for i in range(len(said), len(texts)))


def plain_scan(text, model, agreement=0.5):
    """The scan in plain Python: ``family, probability, n_notices, suspected``."""
    confirmed, found = [], []
    for place, line in enumerate((text or "").split("\n")):
        g = licenses.grams(licenses.tokens(line))
        known = [x for x in g if x in model.weights]
        z = [b + sum(model.weights[x][i] for x in known) / math.sqrt(max(len(g), 1)) for i, b in enumerate(model.bias)]
        p = [math.exp(x) / sum(map(math.exp, z)) for x in z][:-1]
        if max(p) < model.bar or not any(" " in x for x in known):
            continue
        family = model.classes[p.index(max(p))]
        hit = (max(p), -place, family)
        found.append(hit)
        if any(max(len(g & t) / len(t), len(g & t) / len(g)) >= agreement for t in (licenses.grams(licenses.tokens(n)) for n in licenses.TEMPLATES[family])):
            confirmed.append(hit)
    top = max(confirmed, default=(0.0, 0, licenses.UNKNOWN))
    return top[2], round(top[0], 6), len(confirmed), None if confirmed or not found else max(found)[2]


def check_against_plain(df, model):
    texts = [r.text for r in df.collect()]
    got = sorted((r.family, round(r.probability, 5), r.n_notices, str(r.suspected)) for r in licenses.scan(df, model).collect())
    want = sorted((f, round(p, 5), n, str(s)) for f, p, n, s in (plain_scan(t, model) for t in texts))
    assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-5)


def test_scan_against_plain_scoring(spark):
    """Every paragraph of whole texts."""
    rng = np.random.default_rng(6)
    notices = [n for ns in licenses.TEMPLATES.values() for n in ns]
    words = sorted({w for n in notices for w in n.split()}) + ["river", "stone", "of", "the", "house"] * 9
    texts = []
    for _ in range(300):
        lines = [" ".join(rng.choice(words, rng.integers(0, 14))) for _ in range(rng.integers(0, 4))]
        if rng.random() < 0.5:
            cut = notices[rng.integers(len(notices))].split()
            lines.append(" ".join(cut[rng.integers(0, 3) :][: rng.integers(1, 30)]))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "\n\n"])], "doc_id long, text string")
    check_against_plain(df, licenses.fit(CLEAN))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the provided tables")
def test_query_against_plain_scoring(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licenses.fit(licenses.sample_paragraphs(docs, 400, 3000))
    check_against_plain(docs.select("doc_id", "text"), model)


def test_a_notice_common_in_the_sample_names_only_its_documents(spark):
    """One-sentence documents of which every tenth holds one family's notice."""
    for family in ("BSD", "Proprietary", "GPL"):
        notice = licenses.TEMPLATES[family][0]
        rng = np.random.default_rng(8)
        words = ["the", "river", "of", "and", "source", "in", "old", "house", "forms", "are", "met", "with", "public", "this", "work", "light"]
        texts = [" ".join(rng.choice(words, 9)) + "." + (("\n" if i % 20 else " ") + notice if i % 10 == 0 else "") for i in range(400)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.family for r in licenses.scan(df, licenses.fit(licenses.sample_paragraphs(df, 200, 2000))).collect()}
        assert all(got[i] == licenses.UNKNOWN for i in got if i % 10)
        assert np.mean([got[i] == family for i in got if i % 10 == 0]) >= 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the provided tables")
def test_planted_notices_are_found(spark):
    said = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: {said[x] for x in (r.text or "").split("\n") if x in said} for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in licenses.op4_license_scan(spark, sf).collect()}
    for family in said.values():
        mine = [i for i in want if want[i] == {family}]
        assert mine and np.mean([got[i].family == family and got[i].confirmed for i in mine]) >= 0.95, family
    assert all(got[i].family == licenses.UNKNOWN for i in want if not want[i])


def test_scan_of_repeated_and_no_rows(spark):
    model = licenses.fit(CLEAN)
    df = spark.createDataFrame([(1, "Released under the MIT License.")] * 3 + [(None, "x")], "doc_id long, text string")
    out = licenses.scan(df, model)
    assert sorted((str(r.doc_id), r.family, r.n_notices) for r in out.collect()) == [("1", "MIT", 1)] * 3 + [("None", "unknown", 0)]
    assert licenses.scan(df.limit(0), model).count() == 0
    assert not re.search("Python|Pandas|ArrowEval", out._jdf.queryExecution().toString())


def test_model_without_a_sample():
    model = licenses.fit([])
    assert model.classes[-1] == licenses.UNKNOWN and model.weights


def test_sample_is_bounded(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.format_string("a%1$d\nb%1$d\nc%1$d", "id").alias("text"))
    assert len(licenses.sample_paragraphs(df, 10, 15)) == 15
