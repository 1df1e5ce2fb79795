import random
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tagloom.operators import clusters, features, scoring, svm


@pytest.fixture(scope="module")
def corpus(spark):
    """Two tags over 60 documents; a few documents hold no kept term."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    pairs, counts = [], []
    for q in range(60):
        topic = q % 2
        pool = words[:18] if topic else words[12:]
        if q % 20 == 7:
            counts.append((q, f"once{q}", 2))
        else:
            for w in rng.sample(pool, rng.randint(2, 8)):
                counts.append((q, w, rng.randint(1, 4)))
        pairs += [("odd", topic, q), ("even", 1 - topic, q)]
    p = spark.createDataFrame(pairs, "tag string, label int, q_id long")
    t = spark.createDataFrame(counts, "q_id long, term string, tf long")
    return p, t


def test_tf_idf_golden(spark):
    pairs = spark.createDataFrame([("t", 1, i) for i in range(5)], "tag string, label int, q_id long")
    counts = [(0, "spark", 2), (0, "java", 1), (1, "spark", 1), (2, "spark", 1), (3, "spark", 1)]
    counts += [(i, "java", 1) for i in range(1, 5)] + [(4, "rare", 9), (3, "rare", 1), (2, "rare", 1)]
    w = features.weigh(pairs, spark.createDataFrame(counts, "q_id long, term string, tf long"))
    assert rows(w.idf.select("term", "df", "idf")) == [("java", 5, 1.0), ("spark", 4, 1.25)]
    x = {r.term: r.x for r in w.features.where("q_id = 0").collect()}
    assert x["spark"] == pytest.approx(2 / 3 * 1.25) and x["java"] == pytest.approx(1 / 3)
    assert w.members.count() == 5


def test_features_do_not_depend_on_shards(spark, corpus):
    wide = features.weigh(*corpus)
    narrow = features.weigh(*corpus, docs_per_shard=7)
    assert narrow.members.select("shard").distinct().count() > 4
    pick = ["tag", "q_id", "term", F.round("x", 12)]
    assert rows(wide.features.select(*pick)) == rows(narrow.features.select(*pick))
    assert rows(wide.idf.select("tag", "term", "idf")) == rows(narrow.idf.select("tag", "term", "idf"))


def test_svm_golden(spark):
    pairs = spark.createDataFrame([("t", 1, 1), ("t", 0, 2)], "tag string, label int, q_id long")
    members = features.in_shards(pairs)
    feats = members.select("tag", "shard", "q_id", F.when(F.col("q_id") == 1, "a").otherwise("b").alias("term"), F.lit(1.0).alias("x"))
    idf = spark.createDataFrame([("t", "a", 1, 1.0), ("t", "b", 1, 1.0)], "tag string, term string, df long, idf double")
    got = {r.term: r.w for r in svm.train(features.Weighted(members, idf, feats)).collect()}
    assert got["a"] == pytest.approx(1.07504825, abs=1e-8)
    assert got["b"] == pytest.approx(-1.07504825, abs=1e-8)


def test_svm_in_rounds_equals_in_task(spark, corpus):
    w = features.weigh(*corpus, docs_per_shard=11)
    in_task = {(r.tag, r.term): r.w for r in svm.train(w).collect()}
    spread = {(r.tag, r.term): r.w for r in svm.train(w, entries_per_task=0).collect()}
    assert in_task.keys() == spread.keys()
    assert all(spread[k] == pytest.approx(v, abs=1e-9) for k, v in in_task.items())


def test_svm_equals_published_trainer(spark, corpus):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.regression import LabeledPoint

    w = features.weigh(*corpus)
    ids = {t: i for i, t in enumerate(sorted(r.term for r in w.idf.where("tag = 'odd'").collect()))}
    entries = {}
    for r in w.features.where("tag = 'odd'").collect():
        entries.setdefault(r.q_id, {})[ids[r.term]] = r.x
    points = [
        LabeledPoint(r.label, Vectors.sparse(len(ids), entries.get(r.q_id, {})))
        for r in w.members.where("tag = 'odd'").collect()
    ]
    model = SVMWithSGD.train(spark.sparkContext.parallelize(points, 2), 20, convergenceTol=0.0)
    ours = {r.term: r.w for r in svm.train(w).where("tag = 'odd'").collect()}
    assert all(ours[t] == pytest.approx(model.weights[i], abs=1e-9) for t, i in ids.items())


def test_margins_and_accuracy(spark, corpus):
    w = features.weigh(*corpus)
    scored = svm.margins(w, svm.train(w))
    assert scored.count() == 120
    assert scored.where("q_id in (7, 27, 47) and margin <> 0").count() == 0
    assert all(r.accuracy > 0.8 for r in svm.accuracy(scored).collect())
    tie = spark.createDataFrame([("t", 0, 0.0), ("t", 1, 0.0)], "tag string, label int, margin double")
    assert svm.accuracy(tie).first().accuracy == 0.5
    report = svm.evaluate(w).collect()
    assert {r.tag for r in report} == {"odd", "even"} and all(0 < r.n_test < 60 for r in report)


def score(text, model, tags, k):
    """Brute force: every tag, 0.0 where nothing is shared."""
    out = []
    for tag in tags:
        known = {t: (w, i) for g, t, w, i in model if g == tag}
        kept = [t for t in text.split() if t in known]
        value = sum(known[t][0] * known[t][1] for t in kept) / len(kept) if kept else 0.0
        out.append((tag, value))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:k]


@pytest.mark.parametrize("k, shards", [(3, 1), (3, 5), (20, 3)])
def test_recommend_against_brute_force(spark, k, shards):
    rng = random.Random(9)
    vocab = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]
    tags = [f"tag{i:02d}" for i in range(12)]
    model = [(t, w, rng.uniform(-1, 1), rng.uniform(1, 4)) for t in tags for w in rng.sample(vocab, 2)]
    texts = {q: " ".join(rng.choices(vocab, k=rng.randint(0, 5))) for q in range(25)} | {99: "unknown words"}
    got = scoring.recommend(
        spark.createDataFrame(list(texts.items()), "q_id long, content string"),
        spark.createDataFrame(model, "tag string, term string, w double, idf double"), k, shards=shards,
    )
    best = {}
    for r in got.orderBy("q_id", "rank").collect():
        best.setdefault(r.q_id, []).append((r.tag, pytest.approx(r.score, abs=1e-12)))
    assert best == {q: score(t, model, tags, k) for q, t in texts.items()}


def test_recommend_keeps_to_the_route(spark):
    model = spark.createDataFrame(
        [("a", "alpha", 1.0, 1.0), ("b", "alpha", 2.0, 1.0), ("c", "beta", 1.0, 1.0)],
        "tag string, term string, w double, idf double",
    )
    q = spark.createDataFrame([(1, "alpha", 0), (2, "alpha", 1), (3, "alpha", 2)], "q_id long, content string, route int")
    routes = spark.createDataFrame([(0, "a"), (0, "c"), (1, "b"), (1, "unmodelled")], "route int, tag string")
    got = rows(scoring.recommend(q, model, 5, route_tags=routes).select("q_id", "rank", "tag", "score"))
    assert got == [(1, 1, "a", 1.0), (1, 2, "c", 0.0), (2, 1, "b", 2.0)]


def nearest(doc, cents):
    def dist(c):
        return sum((doc.get(t, 0) - c.get(t, 0)) ** 2 for t in {*doc, *c})
    return min(cents, key=lambda i: (round(dist(cents[i]), 12), i))


def sparse_points(spark, seed, n=40):
    rng = random.Random(seed)
    docs = {q: {f"t{rng.randint(0, 9)}": rng.uniform(0, 2) for _ in range(rng.randint(0, 4))} for q in range(n)}
    feats = spark.createDataFrame(
        [(q % 3, q, t, x) for q, d in docs.items() for t, x in d.items()], "shard int, q_id long, term string, x double"
    )
    ids = spark.createDataFrame([(q,) for q in docs], "q_id long")
    cents = {c: {f"t{i}": rng.uniform(0, 1) for i in rng.sample(range(10), 3)} for c in range(5)}
    table = spark.createDataFrame([(c, t, v) for c, d in cents.items() for t, v in d.items()], "cluster_id int, term string, v double")
    return docs, feats, ids, cents, table


@pytest.mark.parametrize("seed", [1, 2])
def test_assign_and_step_against_brute_force(spark, seed):
    docs, feats, ids, cents, table = sparse_points(spark, seed)
    want = {q: nearest(d, cents) for q, d in docs.items()}
    got = {r.q_id: r.cluster_id for r in clusters.assign(feats, ids, table).collect()}
    assert got == want
    moved = {}
    for c in cents:
        members = [docs[q] for q in docs if want[q] == c]
        if members:
            for t in {t for d in members for t in d}:
                moved[c, t] = pytest.approx(sum(d.get(t, 0) for d in members) / len(members))
        else:
            moved |= {(c, t): v for t, v in cents[c].items()}
    step = {(r.cluster_id, r.term): r.v for r in clusters.lloyd_step(feats, ids, table).collect()}
    assert step == moved


def test_fit_finds_separate_groups(spark):
    data = [(0, q, t, 1.0 + q / 1000) for q in range(12) for t in (("a", "b") if q % 2 else ("y", "z"))]
    feats = spark.createDataFrame(data, "shard int, q_id long, term string, x double")
    ids = feats.select("q_id").distinct()
    cents = clusters.fit(feats, ids, 2, max_iter=5, runs=3)
    placed = {r.q_id: r.cluster_id for r in clusters.assign(feats, ids, cents).collect()}
    assert len({placed[q] for q in range(0, 12, 2)}) == 1
    assert len({placed[q] for q in range(1, 12, 2)}) == 1
    assert placed[0] != placed[1]


def test_start_against_brute_force(spark):
    docs, feats, ids, _, _ = sparse_points(spark, 5, n=120)
    full = {q: v for q, v in docs.items() if v}
    k, seed = 4, 7

    def draw(q, r):
        return int(md5(f"{seed}:{r}:{q}".encode()).hexdigest()[:8], 16) / 2**32

    def dist(a, b):
        return sum((a.get(t, 0) - b.get(t, 0)) ** 2 for t in {*a, *b})

    found = [min(full, key=lambda q: (draw(q, 0), q))]
    for r in (1, 2):
        far = {q: min(dist(v, docs[c]) for c in found) for q, v in full.items()}
        total = sum(far.values())
        new = sorted((draw(q, r), q) for q, d in far.items() if draw(q, r) * total < 2 * k * d and d > 1e-9)
        found += [q for _, q in new]
    assert len(found) > k
    weight = Counter(min(range(len(found)), key=lambda c: (round(dist(v, docs[found[c]]), 6), c)) for v in docs.values())
    taken = [max(range(len(found)), key=lambda c: (weight[c], -c))]
    while len(taken) < k:
        gain = [weight[c] * min(round(dist(docs[found[c]], docs[found[t]]), 6) for t in taken) for c in range(len(found))]
        taken.append(max(range(len(found)), key=lambda c: (gain[c], -c)))
    got = defaultdict(dict)
    for r in clusters.seeds(clusters.pack(feats), ids, k, seed).collect():
        got[r.cluster_id][r.term] = r.v
    assert [got[c] for c in range(k)] == [docs[found[t]] for t in taken]


def test_start_with_few_distinct_documents(spark):
    feats = spark.createDataFrame([(0, q, "a", 1.0) for q in range(9)], "shard int, q_id long, term string, x double")
    ids = spark.range(12).select(F.col("id").alias("q_id"))
    cents = clusters.fit(feats, ids, 5, max_iter=3)
    assert rows(cents.select("term", "v")) == [("a", pytest.approx(0.75))]
    assert clusters.fit(feats.where("false"), ids, 3, max_iter=2).count() == 0


def test_rounds_leave_the_features_where_they_lie(spark):
    """Above the placed, cached documents a round exchanges centroid rows, sums and ids only."""
    _, feats, ids, _, table = sparse_points(spark, 2, n=60)
    packed = clusters.pack(feats.repartition(4, "shard")).persist()
    packed.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (clusters.nearest(packed, ids, table), packed.groupBy("shard").cogroup(
                clusters._shipped(packed, table).groupBy("shard")).applyInArrow(lambda a, b: a.select(["q_id"]), "q_id long")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan
            side = plan[plan.index("FlatMapCoGroupsInArrow"):]
            first = side[: side.index("InMemoryTableScan")]
            assert "Exchange" not in first, first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        packed.unpersist()


def test_vectors_hold_every_document(spark):
    docs, feats, ids, _, _ = sparse_points(spark, 3, n=10)
    numbers = spark.createDataFrame([(f"t{i}", i) for i in range(10)], "term string, term_id int")
    got = {r.q_id: r.features for r in clusters.to_vectors(feats, ids, numbers, 10).collect()}
    for q, d in docs.items():
        assert dict(zip((f"t{i}" for i in got[q].indices), got[q].values)) == d


def test_cluster_tags(spark):
    placed = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "q_id long, cluster_id int")
    bridge = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c"), (9, "d")], "q_id long, tag string")
    assert rows(clusters.cluster_tags(placed, bridge)) == [(0, "a"), (0, "b"), (1, "c")]
    assert rows(clusters.cluster_sizes(placed)) == [(0, 2), (1, 1)]


def test_kmeans_fit_query_asks_for_a_whole_fit(spark, tmp_path, monkeypatch):
    """all starts, each until its centroids rest, not a few rounds of one start."""
    from inspect import signature

    from tagloom.catalog import queries as Q

    texts = [(q, f"title\nred fox {'blue sea' if q % 2 else 'green tree'}", "en", "s", 9) for q in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fit, asked = clusters.fit, []

    def seen(*args, **named):
        bound = signature(fit).bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return clusters.seeds(*args[:2], named["k"], 1)

    monkeypatch.setattr(clusters, "fit", seen)
    assert sum(r.n_docs for r in Q.kmeans_fit(spark, str(tmp_path)).collect()) == 18  # two are held out
    assert [(a["k"], a["max_iter"], a["tol"], a["runs"]) for a in asked] == [(6, 1000, 1e-6, 3)]
    spark.catalog.clearCache()


def test_fit_keeps_the_first_of_runs_that_end_alike(spark, monkeypatch):
    feats = spark.createDataFrame([(0, q, "ab"[q % 2], 1.0) for q in range(8)], "shard int, q_id long, term string, x double")
    ids = feats.select("q_id").distinct()
    starts = [{0: "a", 1: "b"}, {0: "b", 1: "a"}]
    monkeypatch.setattr(clusters, "seeds", lambda packed, docs, k, seed, **more: spark.createDataFrame(
        [(c, t, 1.0) for c, t in starts[seed - 1].items()], "cluster_id int, term string, v double"))
    found = clusters.fit(feats, ids, 2, runs=2)
    assert rows(found.select("cluster_id", "term", "v")) == [(0, "a", 1.0), (1, "b", 1.0)]
