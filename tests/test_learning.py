"""Trees of many keys, their contributions, and the models that have no SQL twin, against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

FEATURES = ["f0", "f1", "f2"]


def _plain_fit(x, y, trees, depth, step, bins):
    edges = [list(dict.fromkeys(np.quantile(x[:, f], i / bins) for i in range(1, bins))) for f in range(x.shape[1])]
    start, model = y.mean(), []
    r = y - start
    for _ in range(trees):
        tree, node, value = {}, np.ones(len(x), int), np.zeros(len(x))
        for level in range(depth):
            for name in range(1 << level, 2 << level):
                here, best = node == name, (0.0,)
                for f, b in ((f, e) for f in range(x.shape[1]) for e in edges[f]):
                    low, high = here & (x[:, f] <= b), here & (x[:, f] > b)
                    if low.any() and high.any():
                        gain = round(r[low].sum() ** 2 / low.sum() + r[high].sum() ** 2 / high.sum() - r[here].sum() ** 2 / here.sum(), 9)
                        if gain > best[0]:
                            best = (gain, f, b, r[low].mean(), r[high].mean(), low.sum(), high.sum())
                if len(best) > 1:
                    tree[name] = best[1:]
            for name in range(1 << level, 2 << level):
                if name in tree:
                    f, e, low, high, *_ = tree[name]
                    here, right = node == name, x[:, f] > e
                    node[here], value[here] = (2 * name + right)[here], np.where(right, high, low)[here]
        r = r - step * value
        model.append(tree)
    return start, model


def _value(tree, x, known):
    """The tree's value at ``x`` where only the ``known`` features are told: others follow the shares of rows."""

    def at(node, value):
        if node not in tree:
            return value
        f, e, low, high, n, m = tree[node]
        ways = [(2 * node, low, n), (2 * node + 1, high, m)]
        if f in known:
            return at(*ways[int(x[f] > e)][:2])
        return sum(at(*w[:2]) * w[2] for w in ways) / (n + m)

    return at(1, 0.0)


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 3))
    x[:, 2] = np.round(x[:, 2])
    y = x[:, 0] * 2 + np.where(x[:, 1] > 0, 1, -1) * x[:, 2] + r.standard_normal(300) * 0.1
    keys = ["a" if i % 3 else "b" if i % 2 else None for i in range(300)]
    rows = spark.createDataFrame([(i, k, *map(float, v), float(t)) for i, (k, v, t) in enumerate(zip(keys, x, y))], "id long, k string, f0 double, f1 double, f2 double, y double")
    return rows, x, y, keys


def test_grouped_trees_and_contributions(data):
    """Every key's trees are those of a plain fit of its rows; contributions are Shapley values over all subsets of features."""
    from tidemark.operators import grouped_trees as G

    rows, x, y, keys = data
    forest = G.fit(rows, "k", FEATURES, "y", trees=2, depth=3, bins=6)
    made = {r["row_id"]: r["prediction"] for r in G.score(forest, rows, "k", "id").collect()}
    shap = {(r["row_id"], r["feature"]): r["value"] for r in G.contributions(forest, rows, "k", "id").collect()}
    assert len(made) == 300 and len(shap) == 900
    for key in ("a", "b", None):
        mine = np.array([i for i in range(300) if keys[i] == key])
        start, model = _plain_fit(x[mine], y[mine], 2, 3, 0.1, 6)
        whole = lambda i, known: sum(0.1 * _value(t, x[i], known) for t in model)
        assert np.allclose([made[i] for i in mine], [start + whole(i, {0, 1, 2}) for i in mine])
        for i in mine[:25]:
            for f in range(3):
                others = [j for j in range(3) if j != f]
                want = sum(
                    math.factorial(n) * math.factorial(2 - n) / 6 * (whole(i, {*s, f}) - whole(i, set(s))) for n in range(3) for s in itertools.combinations(others, n)
                )
                assert abs(shap[i, FEATURES[f]] - want) < 1e-9
            assert abs(sum(shap[i, f] for f in FEATURES) - (made[i] - start - whole(i, set()))) < 1e-9


def test_many_keys_in_few_jobs(spark):
    """A thousand keys take no more jobs than one."""
    from tidemark.operators import grouped_trees as G

    rows = spark.range(8000).selectExpr("id % 1000 as k", "id", "cast(id * 7919 % 1013 as double) as f0", "(id * 7919 % 1013) * (id % 1000) / 1000.0D as y")
    jobs = {}
    for name, some in (("one", rows.where("k = 7")), ("all", rows)):
        spark.sparkContext.setJobGroup(name, name)
        forest = G.fit(some, "k", ["f0"], "y", trees=1, depth=2, bins=4)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    assert forest.table.count() == 1000 and jobs["all"] <= jobs["one"] + 15


def test_niche_policy_and_online_scores(spark, data):
    """Own trees from 300 rows, trees on residuals from 30, none below; the incremental model's weights are a plain loop's."""
    from tidemark.operators import models as L
    from tidemark.streaming.blocks import online_weights

    r = np.random.default_rng(6)
    x = r.standard_normal((420, 1))
    name = lambda i: "many" if i < 330 else "some" if i < 400 else "few" if i < 410 else None
    rows = spark.createDataFrame([(i, name(i), float(x[i, 0]), float(x[i, 0] * 2 + (3 if 330 <= i < 400 else 0))) for i in range(420)], "id long, niche string, f0 double, y double")
    made = L.niche_scores(rows, ["f0"], "y", "id", base_trees=2, trees=3, depth=2).toPandas()
    assert dict(made.groupby("niche").policy.first()) == {"many": "scratch", "some": "fine_tune", "few": "fail"} and len(made) == 420
    assert (made.own.notna() == made.policy.isin(["scratch", "fine_tune"])).all()
    some = made[made.niche == "some"]
    assert ((some.y - some.own) ** 2).sum() < ((some.y - some.base) ** 2).sum()
    weights = {w["niche"]: w["online"] for w in online_weights(rows.where("niche is not null").withColumn("seq", F.col("id")), ["f0"], "y", block=50).collect()}
    w = np.zeros(2)
    for i in range(330):
        v = np.array([x[i, 0], 1.0])
        w += 0.5 * (x[i, 0] * 2 - w @ v) * v / (1 + v @ v)
    assert np.allclose(weights["many"], w) and set(weights) == {"many", "some", "few"}
    scored = rows.where("id < 5").withColumn("w", F.array(*[F.lit(float(c)) for c in w])).withColumn("p", L.online_score(F.col("w"), ["f0"])).toPandas()
    assert np.allclose(scored.p, scored.f0 * w[0] + w[1])
    best = spark.createDataFrame([(1.0, 2.0, True, 3.0), (None, 2.0, False, 3.0), (1.0, 2.0, True, None)], "own double, base double, drift boolean, online double")
    found = L.best_available({"niche": F.col("own"), "base": F.col("base")}, F.col("drift"), F.col("online"))
    assert [tuple(b) for b in best.select(found["score"], found["source"]).collect()] == [(3.0, "online"), (2.0, "base"), (1.0, "niche")]


def test_targets_formats_components_and_report(spark):
    """Known data: five targets that follow a feature, formats that tell themselves by one, components by the covariance, errors by hand."""
    from tidemark.config import METRICS
    from tidemark.operators import models as L

    rows = spark.range(200).selectExpr("id", "id % 10 as f0", "if(id % 10 < 5, 'reel', 'story') as content_format", "id % 10 + 1 as engagement", "timestamp_seconds(1700000000 + id * 3600) as at", *[f"ln(1 + id % 10) * {i + 1} as log_{m}" for i, m in enumerate(METRICS)])
    made = L.score_targets(L.five_targets(rows, ["f0"], trees=3, depth=4), rows, ["f0"]).toPandas()
    for m in METRICS:
        assert np.allclose(made[f"pred_{m}"], np.expm1(np.maximum(made[f"pred_log_{m}"], 0))) and np.abs(made[f"pred_log_{m}"] - made[f"log_{m}"]).mean() < np.abs(made[f"log_{m}"] - made[f"log_{m}"].mean()).mean() / 3
    with pytest.raises(ValueError):
        L.five_targets(rows.limit(20), ["f0"])
    first = L.recommended(L.format_recommender(rows, ["f0"], "engagement"), rows).toPandas()
    assert all(r["recommended"][0]["format"] == "story" and abs(sum(x["probability"] for x in r["recommended"]) - 1) < 1e-9 for _, r in first[first.f0 > 5].iterrows())
    v = np.random.default_rng(0).standard_normal((60, 4)) @ np.diag([5, 1, 0.5, 0.1]) + 7
    vectors = spark.createDataFrame([(i, [float(c) for c in a]) for i, a in enumerate(v)], "id long, v array<double>")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    model = L.principal_components(vectors, "v", 2)
    got = np.array([r["c"] for r in model.transform(vectors.withColumn("_v", array_to_vector("v"))).select("id", vector_to_array("components").alias("c")).orderBy("id").collect()])
    centred = v - v.mean(axis=0)
    want = centred @ np.linalg.eigh(np.cov(centred.T))[1][:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want))
    report = L.retrain_report(rows.withColumn("y", F.col("f0") * 2.0), ["f0"], "y", "at", 3).first()
    late = [2.0 * (i % 10) for i in range(200) if i > 199 - 72]
    assert report["test_rows"] in (len(late), len(late) + 1) and report["mae"] < 2.0


def test_ensemble(spark):
    """No model below thirty rows or without a score; at fifty rows it has half of 0.95."""
    from tidemark.operators.models import ensemble

    rows = spark.createDataFrame([(2.0, 1.0, 29), (2.0, 1.0, 50), (None, 1.0, 500), (2.0, 1.0, 10_000), (2.0, 1.0, None)], "m double, h double, n long")
    made = ensemble(F.col("m"), F.col("h"), F.col("n"))
    got = [(round(a, 6), round(s, 6), e) for a, s, e in rows.select(made["alpha"], made["score"], made["explained_by"]).collect()]
    assert got == [(0, 1, "heuristic"), (0.475, 1.475, "heuristic"), (0, 1, "heuristic"), (0.95, 1.95, "model"), (0, 1, "heuristic")]


def test_sentiment_by_hand(spark):
    """Boosters and negations reach three words; a negation farther off does nothing."""
    from tidemark.functions.text import lexicon_sentiment

    texts = {1: "bueno", 2: "muy bueno", 3: "no es muy bueno", 4: "no one two three bueno", 5: "triste!!", 6: "", 7: None, 8: "words only"}
    rows = spark.createDataFrame(list(texts.items()), "id long, caption string")
    lexicon = spark.createDataFrame([("bueno", 2.0), ("triste", -2.0)], "word string, valence double")
    made = {r["id"]: r for r in lexicon_sentiment(rows, lexicon, "id", "caption").collect()}
    whole = lambda s: s / math.sqrt(s * s + 15)
    want = {1: whole(2.0), 2: whole(2.293), 3: whole(2.293 * -0.74), 4: whole(2.0), 5: whole(-2.584), 6: 0.0, 7: 0.0, 8: 0.0}
    assert all(abs(made[i]["compound"] - w) < 1e-9 for i, w in want.items()) and len(made) == 8
    assert made[1]["pos"] == 1 and made[6]["neu"] == 1 and abs(made[3]["neg"] - 2.69682 / 5.69682) < 1e-6


def test_compared_weights_keep_a_prediction_one_row(spark):
    """Sets meet a prediction as one array: the join makes no more rows than there are predictions. Ties go to the later name."""
    from tidemark.config import METRICS
    from tidemark.operators import models as L

    rows = spark.range(0, 50, 1, 2).select("id", *[(F.col("id") % (3 + i) * 1.0).alias(f"log_{m}") for i, m in enumerate(METRICS)])
    sets = {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [5.0, 1.0, 1.0, 1.0, 1.0], "c": [5.0, 1.0, 1.0, 1.0, 1.0]}
    made = L.compare_weights(rows.union(rows.where("id = 7")), spark.createDataFrame([(n, *w) for n, w in sets.items()], "name string, " + ", ".join(f"{m} double" for m in METRICS)), "id")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and "collect_list" in plan
    found = {r["id"]: (r["best"], r["best_rpi"], r["range"]) for r in made.collect()}
    assert len(found) == 50
    for i in range(50):
        index = {n: min(max(sum(w[j] * (i % (3 + j)) for j in range(5)) / sum(w) * 15, 0), 100) for n, w in sets.items()}
        best = max(index, key=lambda n: (round(index[n], 9), n))
        assert found[i][0] == best and np.allclose(found[i][1:], (index[best], max(index.values()) - min(index.values())))


def test_five_targets_are_fitted_on_cells(spark):
    """Rows of equal bins are one row of the fits, with their number and means; the models are those of the rows themselves."""
    from pyspark.ml.regression import GBTRegressor

    from tidemark.config import METRICS
    from tidemark.operators import models as L

    rows = spark.range(3000).selectExpr("id", "id % 7 as f0", "id % 5 as f1", *[f"(id % 7) * {i + 1}.0D + (id % 5) * (id % 11) as log_{m}" for i, m in enumerate(METRICS)])
    sizes, fit = [], GBTRegressor._fit
    GBTRegressor._fit = lambda self, dataset: (sizes.append(dataset.count()), fit(self, dataset))[1]
    try:
        models = L.five_targets(rows, ["f0", "f1"], trees=2, depth=3)
    finally:
        GBTRegressor._fit = fit
    assert sizes == [35] * 5
    made = L.score_targets(models, rows, ["f0", "f1"]).orderBy("id").toPandas()
    for m in METRICS:
        plain = L.regression(rows, ["f0", "f1"], f"log_{m}", trees=2, depth=3).transform(rows).orderBy("id").toPandas()
        assert np.allclose(made[f"pred_log_{m}"], plain.prediction)


def _shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_feedback_is_dealt_once(spark):
    """The learner over a table shuffles a row once; events and blocks are few beside the rows. Niches of all sizes are learned."""
    from tidemark.streaming.feedback import satisfaction_learned

    rows = spark.range(40_000).selectExpr("if(id % 100 = 0, concat('small', id % 7000), 'large') as niche", "id * 7919 % 40009 as seq", "id % 21 / 10.0D - 1 as x", "element_at(array('viral', 'good', 'flop'), int(1 + id % 3)) as label")
    known = _shuffled(spark)
    made = satisfaction_learned(rows, ["x"]).where("event = 'evaluate'").groupBy("niche").agg(F.max("samples").alias("n")).collect()
    assert {r["niche"]: r["n"] for r in made if r["niche"] == "large"} == {"large": 39_600}
    assert sum(n for k, n in _shuffled(spark).items() if k not in known) < 60_000


def test_classifier_sees_cells(spark):
    """Rows of equal bins and label are one row of the fit; the measures are those of the rows scored one by one."""
    from pyspark.ml.classification import GBTClassifier

    from tidemark.operators import models as L

    rows = spark.range(3000).selectExpr("id % 7 as f0", "id % 5 as f1", "double(id % 7 + id % 5 > 3 + id % 3) as high")
    sizes, fit = [], GBTClassifier._fit
    GBTClassifier._fit = lambda self, dataset: (sizes.append(dataset.count()), fit(self, dataset))[1]
    try:
        made = L.classifier(rows, rows, ["f0", "f1"])
    finally:
        GBTClassifier._fit = fit
    assert len(sizes) == 1 and 35 < sizes[0] <= 70
    plain = made["model"].transform(rows).toPandas()
    assert abs(made["accuracy"] - (plain.prediction == plain.high).mean()) < 1e-9 and abs(made["majority"] - max(plain.high.mean(), 1 - plain.high.mean())) < 1e-9
    score = np.array([p[1] for p in plain.probability])
    good, bad = score[plain.high == 1][:, None], score[plain.high == 0][None, :]
    assert abs(made["auc"] - ((good > bad).mean() + (good == bad).mean() / 2)) < 1e-9


def test_quantiles_order_only_the_ranges_of_their_places(spark, monkeypatch):
    """Of many distinct values only ranges that hold a wanted place are ordered, and none is numbered; a key without the place has NULL."""
    from tidemark.operators import ranks

    r = np.random.default_rng(8)
    data = [(None if i % 5 == 0 else "one" if i == 1 else "many", float(v)) for i, v in enumerate(np.round(r.standard_normal(3000), 3))]
    rows = spark.createDataFrame(data, "k string, v double")
    monkeypatch.setattr(ranks, "_AT_ONCE", 10)
    monkeypatch.setattr(ranks, "numbered", None)
    counted = ranks.Counted(rows, "v", ["k"])
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    made = {m["k"]: (m["n"], m["q"]) for m in counted.quantiles(shares).collect()}
    for key in (None, "one", "many"):
        mine = [v for k, v in data if k == key]
        assert made[key][0] == len(mine) and np.allclose(made[key][1], np.quantile(mine, shares))
    assert np.allclose(counted.quantiles(shares, []).first()["q"], np.quantile([v for _, v in data], shares))
    assert {m["k"]: m["p"] is None for m in counted.at(["k"], {"p": F.lit(5)}).collect()} == {None: False, "one": True, "many": False}


def test_trees_grow_on_cells(spark, monkeypatch):
    """A key's rows of equal bins are one row of the residuals, which keep the number of rows."""
    from tidemark.operators import grouped_trees as G

    kept, save = [], G.Steps.save
    monkeypatch.setattr(G.Steps, "save", lambda self, df: (kept.append(save(self, df)), kept[-1])[1])
    drop = G.Steps.drop
    monkeypatch.setattr(G.Steps, "drop", lambda self, *t: (sizes.extend(x.count() for x in t), drop(self, *t))[1])
    sizes: list[int] = []
    rows = spark.range(3000).selectExpr("id", "id % 2 as k", "double(id % 7) as f0", "double(id % 5) as f1", "double(id % 7 * 3 + id % 11) as y")
    forest = G.fit(rows, "k", ["f0", "f1"], "y", trees=1, depth=2, bins=8)
    assert sizes and max(sizes) <= 70
    assert all(s["n_left"] + s["n_right"] == 1500 for m in forest.table.collect() for s in m["splits"] if s["node"] == 1)


def test_events_are_not_shuffled(spark):
    """With an event for every row, rows are still shuffled once; the events meet their blocks' sums where they were measured."""
    from tidemark.streaming.feedback import learned, status

    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 'small', 'large') as niche", "id * 7919 % 30011 as seq", "id % 21 / 10.0D - 1 as x", "id % 13 / 6.0D as y")
    known, size = _shuffled(spark), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")  # the events are larger, the blocks are not
    try:
        made = status(learned(rows, ["x"], ["y"], every=1)).collect()
    finally:
        spark.conf.set(size, before)
    assert {r["niche"]: r["samples"] for r in made} == {"small": 10_000, "large": 20_000}
    assert sum(n for k, n in _shuffled(spark).items() if k not in known) < 40_000


def test_ranges_of_feedback_follow_its_rows(spark, monkeypatch):
    """A task orders a bounded number of rows, whatever the session's number of partitions; many niches in a range, rows that lack
    a value and a large niche give the weights of a plain loop, and the session's bound of batches stays."""
    from tidemark.streaming import blocks as B

    monkeypatch.setattr(B, "_RANGE", 1000, raising=False)
    monkeypatch.setattr(B, "_TOGETHER", 300, raising=False)
    r = np.random.default_rng(9)
    made = [("large" if i % 2 else f"small{i % 34}" if i % 3 else None, int(i * 7919 % 30_011 // 2), float(a), None if i % 11 == 0 else math.nan if i % 13 == 0 else float(b)) for i, (a, b) in enumerate(r.standard_normal((30_000, 2)))]
    rows, key = spark.createDataFrame(made, "niche string, seq long, x double, y double"), "spark.sql.execution.arrow.maxBytesPerBatch"
    bound, kept = spark.conf.get(key), [m for m in made if m[3] is not None and m[3] == m[3]]
    blocks = B._Blocks(rows, ["x"], ["y"], 0.5, 70)
    assert spark.conf.get(key) == bound
    ranges = blocks.packed.groupBy("part").agg(F.sum("n").alias("n")).toPandas()
    assert ranges.n.sum() == len(kept) and ranges.n.max() < 1500 and blocks.packed.where("n > 70").count() == 0
    found = {w["niche"]: w["online"] for w in B.online_weights(rows, ["x"], "y", block=70).collect()}
    assert len(found) == len({m[0] for m in kept})
    for niche in found:
        w = np.zeros(2)
        for _, _, a, b in sorted((m for m in kept if m[0] == niche), key=lambda m: m[1:]):
            v = np.array([a, 1.0])
            w += 0.5 * (b - w @ v) * v / (1 + v @ v)
        assert np.allclose(found[niche], w)
