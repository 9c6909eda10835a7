"""The bank on sequences of one's own: nodes, pathways, routers, projections; stores; evaluation and search; classifiers on held-out vectors."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import nodes, stores
from tidegauge.operators import classifiers, mining, neighbours
from tidegauge.plans import beliefs, evaluator, search
from tidegauge.sources.tables import obs_events, table

FOLDER = "/root/testdata/sf0.001"


def sequences(spark, n=3, length=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, t, float(v)) for s in range(n) for t, v in enumerate(np.cumsum(rng.standard_normal(length)) + 10 * s)]
    return spark.createDataFrame(rows, "series_id long, t long, x0 double"), rows


# ------------------------------------------------------------------ nodes
def test_input_is_validated(spark):
    for bad in ([], [[1.0], [float("nan")]], np.zeros((2, 2, 2)), [float("inf")]):
        with pytest.raises(ValueError):
            nodes.validate(bad, spark)
    assert nodes.validate([1.0, 2.0], spark).count() == 2
    df, _ = sequences(spark)
    with pytest.raises(ValueError, match="lacks"):
        nodes.validate(df.drop("x0"))
    with pytest.raises(ValueError, match="finite"):
        nodes.validate(df.withColumn("x0", F.when(F.col("t") == 3, None).otherwise(F.col("x0"))))
    with pytest.raises(ValueError, match="empty"):
        nodes.validate(df.where("t < 0"))


def test_a_node_fits_predicts_and_transforms(spark):
    df, rows = sequences(spark)
    node = nodes.create("difference", name="step")
    assert node.is_transformer and not node.fitted and node.metadata()["name"] == "step"
    out = {(r["series_id"], r["t"]): r["x0"] for r in node.fit(df).transform(df).collect()}
    value = {(s, t): v for s, t, v in rows}
    assert all(out[s, t] == pytest.approx(value[s, t] - value[s, t - 1], abs=1e-5) for s, t in out if t)
    got = nodes.create("naive_mean_forecast").process(df).collect()
    assert {r["series_id"] for r in got} == {0, 1, 2}
    for r in got:
        b = r["belief"]
        assert b["type"] == "forecast" and b["source"] == "naive_mean_forecast" and b["schema_version"] == beliefs.VERSION and 0 <= b["confidence"] <= 1
        mean = np.mean([v for s, _, v in rows if s == r["series_id"]])
        assert any(abs(float(v) - mean) < 1e-3 for v in b["payload"].values())
    with pytest.raises(NotImplementedError):
        nodes.create("naive_mean_forecast").transform(df)
    with pytest.raises(KeyError):
        nodes.create("no_such_operator")


def test_the_bank_is_ordered_and_described():
    bank = nodes.default_bank()
    at = [nodes.LAYERS.index(b.layer) for b in bank]
    assert at == sorted(at) and len(bank) == len(nodes.all_node_types()) > 200
    assert set(nodes.layers()) <= set(nodes.LAYERS) and "kalman_filter" in nodes.by_layer("probability")
    assert nodes.role("difference") == "feature" and nodes.out_kind("difference") == "transform"
    assert nodes.role("ucb_bandit") == "terminal" and nodes.out_kind("nothing") == "unknown"
    assert nodes.node_cost("lstm_forecaster") == "high" and nodes.node_cost("garch_forecast") == "med" and nodes.node_cost("cumsum") == "low"
    assert nodes.compatible("difference", "kalman_filter") and not nodes.compatible("kalman_filter", "difference") and not nodes.compatible("ucb_bandit", "ucb_bandit")
    assert nodes.genome_card("difference")["is_transformer"] is True


@pytest.mark.parametrize("layer", ["signal", "sequence", "probability", "equation"])
def test_operators_run_on_any_sequences(spark, layer):
    df, _ = sequences(spark, 2, 50)
    names = [x for x in nodes.by_layer(layer) if nodes.node_cost(x) == "low"][::9]
    for name in names:
        assert nodes.create(name).predict(df).count() >= 1, name


# ------------------------------------------------------------------ pathways
def test_a_pathway_of_the_bank(spark):
    df, _ = sequences(spark)
    got = nodes.run(df, ["difference", "zscore_anomaly_belief", "kalman_filter", "threshold_policy"])
    assert [r["node"] for r in got.select("step", "node").distinct().orderBy("step").collect()] == ["difference", "zscore_anomaly_belief", "kalman_filter", "threshold_policy"]
    plain = nodes.create("kalman_filter").result(df).collect()
    diff = nodes.create("kalman_filter").result(nodes.create("difference").transform(df)).collect()
    assert sorted(map(str, plain)) != sorted(map(str, diff))  # the transformer's rows went on
    with pytest.raises(ValueError, match="forward"):
        list(nodes.hops(df, ["kalman_filter", "difference"]))


def test_routers(spark, tmp_path):
    pool = ["difference", "zscore_anomaly", "kalman_filter", "theta_forecast", "threshold_policy"]
    path = nodes.route(nodes.HeuristicRouter(), pool)
    assert path[0] == "difference" and nodes.role(path[-1]) == "terminal" and len(set(path)) == len(path)
    rep = stores.PathwayReputation(spark, str(tmp_path / "rep"))
    rep.record(["difference", "theta_forecast"], outcomes=[1.0] * 30)
    assert nodes.ReputationRouter(rep).choose(["difference"], nodes.candidates(["difference"], pool, jump=9)) == "theta_forecast"
    assert nodes.LLMRouter(lambda _: 'I take {"next": "kalman_filter"}').choose(["difference"], ["kalman_filter", "theta_forecast"]) == "kalman_filter"
    assert nodes.LLMRouter(lambda _: "no idea").choose([], ["difference"]) == "difference"
    assert nodes.LLMRouter(lambda _: '{"next": null}').choose([], ["difference"]) is None


# ------------------------------------------------------------------ beliefs
def test_projections_and_migrations(spark):
    one = spark.range(1)
    b = lambda kind, **p: beliefs.belief(kind, "s", F.lit(0.25), **{k: F.lit(v) for k, v in p.items()})
    cases = [(b("forecast", estimate=2.5, other=9.0), 2.5), (b("anomaly", n_anomalies=3, fraction=0.5), 0.5), (b("signal", note="x", level=7.0), 7.0), (b("riddle", a="none"), 0.0), (b("equation", r2=float("nan"), coef=4.0), 4.0)]
    row = one.select(*[nodes.belief_to_vector(c).alias(f"v{i}") for i, (c, _) in enumerate(cases)], beliefs.to_dict(cases[0][0]).alias("j")).first()
    for i, (_, want) in enumerate(cases):
        assert row[f"v{i}"] == [want, 0.25]
    assert json.loads(row["j"])["payload"]["estimate"] == "2.5"
    assert set(nodes.assert_projection_completeness()["dedicated"]) | set(nodes.assert_projection_completeness()["fallback"]) == set(beliefs.REQUIRED)
    beliefs.register_migration("-1", "0.0", lambda x: F.when(x["type"] == "forecast", F.map_concat(x["payload"], F.create_map(F.lit("value"), F.lit("5")))).otherwise(x["payload"]))
    try:
        old = F.struct(F.lit("forecast").alias("type"), F.create_map(F.lit("k"), F.lit("1")).alias("payload"), F.lit(0.5).alias("confidence"), F.lit("s").alias("source"), F.lit("-1").alias("schema_version"))
        got = one.select(beliefs.migrated(old).alias("b")).first()["b"]
        assert got["schema_version"] == "0.1" and got["payload"] == {"k": "1", "estimate": "5"}
        assert beliefs.has_migration_path("-1", "0.1") and not beliefs.has_migration_path("0.1", "-1")
        with pytest.raises(ValueError):
            beliefs.register_migration("2", "2", None)
    finally:
        del beliefs.MIGRATIONS["-1"]


# ------------------------------------------------------------------ stores
def test_leaderboard(spark, tmp_path):
    lb = stores.Leaderboard(spark, str(tmp_path / "lb"))
    assert lb.count() == 0 and lb.best() is None
    a, b = search.DAGSpec([["mean"]]), search.DAGSpec([["mean", "drift"]], "stacked")
    first = lb.record(a, {"crps_skill": 0.1, "mean_crps": 2.0, "n": 5}, dsr=0.5)
    lb.record(a, {"crps_skill": 0.3, "mean_crps": 1.0}, dsr=0.99)
    lb.record(b, {"crps_skill": 0.2, "mean_crps": 0.5}, "other")
    assert lb.count() == 3 and lb.get(first)["n_eval"] == 5 and lb.get("none") is None
    assert [r["crps_skill"] for r in lb.top().collect()] == [0.3, 0.2]
    assert [r["mean_crps"] for r in lb.top(metric="mean_crps").collect()] == [0.5, 1.0]
    assert [r["dsr"] for r in lb.top(metric="dsr", dedupe=False).collect()] == [0.99, 0.5]
    assert lb.best(dataset_id="other")["combiner"] == "stacked"
    s = lb.summary()
    assert (s["n_runs"], s["n_specs"], s["n_beat_baseline"], s["n_dsr_significant"], s["best_skill"]) == (3, 2, 3, 1, 0.3)
    with pytest.raises(ValueError):
        lb.top(metric="luck")


def test_reputation(spark, tmp_path):
    rep = stores.PathwayReputation(spark, str(tmp_path / "rep"))
    assert rep.edge_score("a", "b") is None and rep.pathway_score(["a", "b"]) == 0.0
    one = rep.record(["a", "b", "c"], outcomes=[0.1, 0.2, 0.3])["score"]
    two = rep.record(["a", "b", "d"], report={"ucb": 4.0, "sharpe": 1.0})["score"]
    rep.record(["x", "y"], outcomes=[1.0], regime="calm")
    w = [0.95**2, 0.95, 1.0]
    want = (0.1 * w[0] + 0.2 * w[1] + 0.3 * w[2]) / sum(w) + math.sqrt(2 * math.log(sum(w) + 1) / sum(w))
    assert one == pytest.approx(want) and two == 4.0
    assert rep.edge_score("a", "b") == pytest.approx((one + two) / 2) and rep.edge_score("b", "c") == pytest.approx(one)
    assert [tuple(r["pathway"]) for r in rep.leaderboard().collect()][0] == ("a", "b", "d")
    assert rep.known_regimes() == ["all", "calm"]
    assert rep.to_dict()["edges"]["a->b"] == round(max(one, two), 4)


def test_vectors_features_and_knowledge(spark, tmp_path):
    vs = stores.VectorStore(spark, str(tmp_path / "vs"))
    rows = spark.createDataFrame([("a", "t1", "s1", [3.0, 4.0]), ("b", "t2", "s2", [0.0, 2.0]), ("c", "t3", "s1", [0.0, 0.0])], "id string, text string, source string, vector array<double>")
    vs.add(rows)
    vs.add(rows.where("id = 'b'").withColumn("text", F.lit("new")))
    assert len(vs) == 3 and {r["text"] for r in vs.passages().collect()} == {"t1", "new", "t3"}
    got = vs.search([0.0, 1.0], 2).collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [("b", 1.0), ("a", 0.8)]
    assert [r["id"] for r in vs.search([0.0, 1.0], 1, F.col("source") == "s1").collect()] == ["a"]
    again = stores.VectorStore.load(spark, vs.save(str(tmp_path / "copy")))
    assert len(again) == 3
    calls = []

    def factory(df):
        calls.append(1)
        return df.withColumn("y", F.col("x0") * 2)

    df, _ = sequences(spark)
    fs = stores.FeatureStore(spark, str(tmp_path / "fs"))
    assert fs.get_or_compute(df, factory).count() == fs.get_or_compute(df.orderBy(F.desc("t")), factory).count() == 180 and len(calls) == 1
    fs.get_or_compute(df.where("t > 0"), factory)
    assert len(calls) == 2
    kb = stores.KnowledgeBase(spark, str(tmp_path / "kb"), 64)
    kb.ingest(spark.createDataFrame([(1, "blue whales sing low songs", "sea"), (2, "été en forêt", "land"), (3, None, "land")], "doc_id long, text string, source string"))
    assert kb.retrieve("whales sing", 1).first()["id"] == "1#0"
    assert kb.retrieve("whales sing", 5, source="land").count() == 1
    key = kb.remember("the market opens at nine")
    assert kb.recall("market opens", 1).first()["id"] == key
    kb.remember("Q: when does it open? A: " + "it opens at nine in the morning on every working day", kind="chat_qa")
    kb.remember("Q: short? A: yes", kind="chat_qa")
    assert kb.consolidate() == 1 and kb.consolidate() == 0


# ------------------------------------------------------------------ evaluation and search
def test_reports_against_plain_formulas(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    series = {s: rng.normal(0.05 * s, 1, 80) for s in range(4)}
    df = spark.createDataFrame([(s, t, float(v)) for s, x in series.items() for t, v in enumerate(x)], "series_id long, t long, o double")
    got = {r["series_id"]: r for r in evaluator.evaluate(df).collect()}
    for s, x in series.items():
        sd = x.std(ddof=1) + 1e-12
        sr = x.mean() / sd
        skew, kurt = (((x - x.mean()) / sd) ** 3).mean(), (((x - x.mean()) / sd) ** 4).mean()
        scale = math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr)
        bar = evaluator.expected_max_sharpe(4, (1 + sr * sr / 2) / 80)
        cdf = NormalDist().cdf
        assert got[s]["psr"] == pytest.approx(cdf(sr * math.sqrt(79) / scale), abs=1e-6)
        assert got[s]["dsr"] == pytest.approx(cdf((sr - bar) * math.sqrt(79) / scale), abs=1e-6)
        curve = np.cumsum(x)
        assert got[s]["neg_drawdown"] == pytest.approx(-(np.maximum.accumulate(curve) - curve).max())
        assert got[s]["stability"] == pytest.approx(np.corrcoef(curve, np.arange(80))[0, 1] ** 2)
        assert got[s]["ucb"] == pytest.approx(stores.fading_score(x))
    one = evaluator.evaluate(df, n_trials=1).where("series_id = 3").first()
    assert one["dsr"] == pytest.approx(one["psr"])
    assert evaluator.expected_max_sharpe(1, 1.0) == 0.0


def test_selection_gates(spark):
    rows = [(0, 1.0, 1.0, -1.0, 0.5, 1), (1, 2.0, 2.0, -2.0, 0.6, 1), (2, 0.5, 0.5, -3.0, 0.1, 1), (3, 3.0, 3.0, -4.0, 0.9, 0)]
    df = spark.createDataFrame(rows, "series_id long, mean double, sharpe double, neg_drawdown double, stability double, passed int")
    got = lambda **k: {r["series_id"]: r["admitted"] for r in evaluator.select(df, **k).collect()}
    assert got() == {0: 1, 1: 1, 3: 0}
    assert got(anchors=spark.createDataFrame([(0, 1), (1, 0)], "series_id long, anchored int")) == {0: 1, 1: 0, 3: 0}
    assert got(pbo=0.8) == {0: 0, 1: 0, 3: 0}


def test_walk_forward_keeps_the_future_away(spark):
    df, rows = sequences(spark, 1, 120)
    seen = []

    def candidate(history, tests):
        ends = {r["fold"]: r["e"] for r in history.groupBy("fold").agg(F.max("t").alias("e")).collect()}
        starts = {r["fold"]: r["s"] for r in tests.groupBy("fold").agg(F.min("t").alias("s")).collect()}
        seen.append(all(ends[f] < starts[f] - 1 for f in starts))
        return evaluator.directional(history, tests)

    out = evaluator.walk_forward(df, candidate).collect()
    assert seen == [True] and len({r["t"] for r in out}) == len(out) > 80


def test_fronts_by_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)
    left, want = set(range(150)), {}
    for level in range(3):
        front = {i for i in left if not any((x[j] >= x[i]).all() and (x[j] > x[i]).any() for j in left)}
        want |= {i: level for i in front}
        left -= front
    assert {r["id"]: r["front"] for r in neighbours.fronts(df, "id", ["a", "b", "c"], 3).collect()} == want


def test_combiners_use_the_past_alone(spark):
    df, _ = sequences(spark, 1, 90, seed=2)
    x = search.base_forecasts(df).toPandas().sort_values("t")
    for combiner in search.COMBINERS:
        spec = search.DAGSpec([["mean", "mean_5", "persistence"]], combiner)
        a, sd = search.combined(x, spec)
        y = x.copy()
        y.loc[y["t"] == 80, "x0"] += 100
        b, _ = search.combined(y, spec)
        before = (x["t"] <= 80).to_numpy()
        assert a[before] == pytest.approx(b[before], nan_ok=True) and (sd >= 0).all(), combiner
    p, y = np.random.default_rng(1).standard_normal((30, 2)), np.random.default_rng(2).standard_normal(30)
    got = search.ridge_predict(p, y)
    for t in (7, 29):
        c = p[:t] - p[:t].mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y[:t] - y[:t].mean()))
        assert got[t] == pytest.approx(y[:t].mean() + (p[t] - p[:t].mean(0)) @ w)


def test_normal_score_by_samples():
    rng = np.random.default_rng(0)
    s, t = rng.standard_normal(400_000), rng.standard_normal(400_000)
    for y in (-1.0, 0.3, 2.0):
        want = np.abs(1.5 * s + 0.5 - y).mean() - 0.5 * np.abs(1.5 * (s - t)).mean()
        assert search.crps_normal(np.array([0.5]), np.array([1.5]), np.array([y]))[0] == pytest.approx(want, abs=0.01)


def test_searches(spark, tmp_path):
    df, _ = sequences(spark, 4, 70)
    lb = stores.Leaderboard(spark, str(tmp_path / "lb"))
    s = search.DAGSearch(df, lb, pool=["persistence", "mean", "mean_5"], max_base=2, seed=1)
    spec = s.random_spec()
    assert search.DAGSpec.from_dict(json.loads(spec.signature())).signature() == spec.signature()
    for _ in range(20):
        spec = s.mutate(spec)
        assert 1 <= spec.n_nodes <= 2 and set(spec.layers[0]) <= set(s.pool) and spec.combiner in search.COMBINERS
        assert set(s.crossover(spec, s.random_spec()).layers[0]) <= set(s.pool)
    found = s.random_search(4)
    skills = [d["crps_skill"] for _, d in found]
    assert skills == sorted(skills, reverse=True) and lb.count() == len(found)
    assert s.hyperband_search(6)[0][1]["n"] > 0
    best = search.capstone(df, pool=["persistence", "mean"], max_base=2, search="random_search")
    assert best["verdict"] in ("PASS", "WEAK", "FAIL") and best["holdout"]["n"] > 0
    tried = search.plan_and_search(s, lambda _: 'Try [{"bases": ["mean", "nothing"]}, {"bases": ["nothing"]}]', 1)
    assert [x.layers for x, _ in tried] == [[["mean"]]]
    assert search.extract_json("so: {\"a\": [1, {\"b\": 2}]} end") == {"a": [1, {"b": 2}]} and search.extract_json("none {") is None


# ------------------------------------------------------------------ mining and learning
def test_patterns_against_other_miners(spark):
    from pyspark.ml.fpm import FPGrowth, PrefixSpan

    rows = mining.windows_of(spark, "/root/testdata/sf0.01").where("series_id < 3")
    for r in rows.groupBy("series_id").count().collect():
        own = rows.where(F.col("series_id") == r["series_id"])
        least = max(2, int(0.15 * r["count"]))
        ratio = (least - 0.5) / r["count"]
        sets = FPGrowth(itemsCol="i", minSupport=ratio).fit(own.select(F.array_distinct(F.array("s1", "s2", "s3", "s4")).alias("i"))).freqItemsets
        want = {"".join(sorted(map(str, x["items"]))): x["freq"] for x in sets.collect()}
        assert {x["pattern"]: x["support"] for x in mining.itemsets(own).collect()} == want
        seqs = PrefixSpan(minSupport=ratio, maxPatternLength=4).findFrequentSequentialPatterns(own.select(F.array(*[F.array(f"s{i}") for i in range(1, 5)]).alias("sequence")))
        want = {"".join(str(x[0]) for x in y["sequence"]): y["freq"] for y in seqs.collect() if all(len(x) == 1 for x in y["sequence"])}
        assert {x["pattern"]: x["support"] for x in mining.sequences(own).collect()} == want


def test_classifiers_on_held_out_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((4, 16)) * 1.5
    data = [(i, (centres[i % 4] + rng.standard_normal(16)).tolist(), i % 4) for i in range(400)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    train, rest = rows.where("vec_id % 20 > 3").repartition(3), rows.where("vec_id % 20 <= 3")
    truth = {r["vec_id"]: r["label"] for r in rest.collect()}
    for name in ("lda", "sgd_classifier", "adaboost", "extra_trees", "svm_classifier"):
        node = nodes.create(name)
        with pytest.raises(RuntimeError):
            node.predict(rest)
        with pytest.raises(ValueError):
            node.fit(train)
        got = node.fit(train, train.select("vec_id", "label")).result(rest.select("vec_id", "embedding"))
        right = sum(r["prediction"] == truth[r["vec_id"]] for r in got.collect()) / len(truth)
        assert right > 0.6, (name, right)


def test_moments_of_classes(spark):
    rows = table(spark, FOLDER, "embeddings")
    pdf = rows.toPandas()
    for label, (n, s, q) in classifiers.class_moments(rows).items():
        a = np.stack(pdf[pdf["label"] == label]["embedding"].to_numpy()).astype(float)
        assert n == len(a) and s == pytest.approx(a.sum(0)) and q == pytest.approx(a.T @ a)


def test_queries_take_tables(spark):
    assert obs_events(spark, {"events": table(spark, FOLDER, "events")}).count() == obs_events(spark, FOLDER).count()
