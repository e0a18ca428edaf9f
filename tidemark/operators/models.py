"""Training and scoring with Spark ML: engagement models, recommenders, reductions, and explanations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tidemark.config import KPI, METRICS, Weights
from tidemark.functions.metrics import log_index, relative_score
from tidemark.operators.evaluation import confidence
from tidemark.operators.near_rows import near_rows
from tidemark.operators.ranks import Counted, quantiles, with_place
from tidemark.operators.tables import Steps


def assembled(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


def _gbt(label: str, weight: str | None, trees: int, depth: int, seed: int, prediction: str = "prediction") -> GBTRegressor:
    made = GBTRegressor(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, predictionCol=prediction)
    return made.setWeightCol(weight) if weight else made


def regression(rows: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """ML-01: gradient-boosted trees on assembled features."""
    return Pipeline(stages=[assembled(features), _gbt(label, weight, trees, depth, seed)]).fit(rows)


def niche_scores(rows: DataFrame, features: list[str], label: str, ident: str, niche: str = "niche", least: int = 30, scratch: int = 300, base_trees: int = 20, trees: int = 20, depth: int = 4) -> DataFrame:
    """ML-01/02: every row scored by the base model and by its niche's own: (ident, niche, ``base``, ``own``, ``policy``).

    A niche of ``scratch`` rows gets its own trees, one of ``least`` gets trees on the residuals of the base model, and a smaller one
    none. All niches' trees are grown in the same jobs (``grouped_trees``), so their number doesn't matter.
    """
    from tidemark.operators import grouped_trees as G

    steps = Steps(rows.sparkSession, "niches")
    base = regression(rows, features, label, trees=base_trees, depth=depth)
    scored = base.transform(rows).select(ident, niche, *[f for f in features if f not in (ident, niche)], label, F.col("prediction").alias("base"))
    there = rows.where(F.col(niche).isNotNull()).groupBy(niche).agg(F.count("*").alias("_n"))
    policy = F.when(F.col("_n") >= scratch, "scratch").when(F.col("_n") >= least, "fine_tune").otherwise("fail")
    known = steps.save(scored.join(there, niche, "left").withColumn("policy", F.when(F.col(niche).isNotNull(), policy)).drop("_n"))
    residual = known.withColumn("_y", F.when(F.col("policy") == "scratch", F.col(label)).otherwise(F.col(label) - F.col("base")))
    own = G.score(G.fit(residual.where("policy in ('scratch', 'fine_tune')"), niche, features, "_y", trees, depth), known, niche, ident)
    made = known.join(own.withColumnRenamed("row_id", ident), ident, "left")
    return made.withColumn("own", F.when(F.col("policy") == "scratch", F.col("prediction")).when(F.col("policy") == "fine_tune", F.col("base") + F.col("prediction"))).drop("prediction")


def five_targets(rows: DataFrame, features: list[str], least: int = 50, **settings) -> dict[str, PipelineModel]:
    """ML-03: one fit for each metric's logarithm, on one table of cells of equal bins with their weight and mean logarithms, which
    is all that trees of squared error see of their rows. Models share all stages but the last. Rows are read twice."""
    steps = Steps(rows.sparkSession, "targets")
    binned = _bins(rows, features)
    names = binned.getOutputCols()
    means = [F.avg(f"log_{m}").alias(f"log_{m}") for m in METRICS]
    cells = steps.save(_in_cells(binned, rows).agg(F.count("*").cast("double").alias("_w"), *means))
    if (cells.agg(F.sum("_w")).first()[0] or 0) < least:
        raise ValueError(f"five targets need {least} rows")
    options = {"trees": 10, "depth": 4, "seed": 42} | settings
    shared = assembled(names)
    kept = shared.transform(cells)
    fit = lambda m: _gbt(f"log_{m}", "_w", options["trees"], options["depth"], options["seed"], f"pred_log_{m}").fit(kept)
    made = {m: PipelineModel([binned, shared, fit(m)]) for m in METRICS}
    steps.clear()
    return made


def score_targets(models: dict[str, PipelineModel], rows: DataFrame, features: list[str], weights: Weights = KPI, baseline: bool = False) -> DataFrame:
    """ML-21: five predicted logarithms, what they stand for, the weighted index, and the score against columns avg_*."""
    made = PipelineModel(next(iter(models.values())).stages[:-1]).transform(rows)
    for model in models.values():
        made = model.stages[-1].transform(made)
    values = {f"pred_{m}": F.expm1(F.greatest(F.col(f"pred_log_{m}"), F.lit(0.0))) for m in METRICS}
    made = made.withColumns(values).withColumn("weighted_rpi", log_index(weights, prefix="pred_log_"))
    return (made.withColumn("relative_score", relative_score("pred_")) if baseline else made).drop("features", *[f"_bin_{f}" for f in features])


_BINS = 32  # as Spark's trees have by themselves


def _bins(rows: DataFrame, features: list[str]) -> Bucketizer:
    """Features to at most 32 bins ``_bin_*``: a bin for each value where there are few, else between exact quantiles of all rows."""
    values = rows.select(F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "v")).where(~F.isnan("v"))
    counted = Counted(values, "v", ["f"])
    few = [r["f"] for r in counted.rows.groupBy("f").count().where(F.col("count") <= _BINS).collect()]
    edges = {r["f"]: r["q"] for r in counted.quantiles([i / _BINS for i in range(1, _BINS)]).where(~F.col("f").isin(few)).collect()}
    for r in counted.rows.where(F.col("f").isin(few)).orderBy("f", "_v").collect():
        edges.setdefault(r["f"], []).append(r["_v"])
    counted.clear()
    splits = [[-math.inf, *(sorted(set(edges.get(i, [0.0])))[i in few and len(edges[i]) > 1 :]), math.inf] for i in range(len(features))]
    return Bucketizer(splitsArray=splits, inputCols=features, outputCols=[f"_bin_{f}" for f in features], handleInvalid="keep")


def _in_cells(binned: Bucketizer, rows: DataFrame, *by: str) -> GroupedData:
    """Rows grouped by their bins and ``by``. The sum drops what Bucketizer notes of its columns: trees would take bins as names
    without an order."""
    return binned.transform(rows).groupBy(*[(F.col(b) + 0.0).alias(b) for b in binned.getOutputCols()], *by)


def growth(rows: DataFrame, features: list[str], label: str, fold: str, weight: str | None = None, seed: int = 42) -> dict:
    """ML-04/20: scaling, folds by a column, a weighted fit: the model, its cross-validated error and the features by importance.

    Rows are read once. Trees of squared error see no more of rows of equal bins and fold than their weight and mean, so such
    rows are one cell, and fits pass over cells, whose number ends with the bins'. Errors are those of the single rows.
    """
    steps = Steps(rows.sparkSession, "growth")
    kept = steps.save(rows.where(F.col(label).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), F.col(fold).alias("_fold"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")))
    binned = _bins(kept, features)
    names = binned.getOutputCols()
    y, w = F.col("_y"), F.col("_w")
    cells = binned.transform(kept).groupBy(*names, "_fold").agg(F.count("*").alias("_n"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q"), F.sum(w).alias("_w"), (F.sum(w * y) / F.sum(w)).alias("_y"))
    cells = steps.save(cells)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    pipe = Pipeline(stages=[assembled(names, "raw"), scaler, _gbt("_y", "_w", 10, 3, seed)])
    folds = [r[0] for r in cells.where("_fold is not null").select("_fold").distinct().orderBy("_fold").collect()]
    if len(folds) < 2:
        raise ValueError("cross-validation needs two folds")
    p = F.col("prediction")
    error = F.sqrt(F.greatest(F.sum(F.col("_q") - 2 * p * F.col("_s") + F.col("_n") * p * p), F.lit(0.0)) / F.sum("_n"))
    fit = lambda part: pipe.fit(part.where("_w > 0"))
    errors = [fit(cells.where(F.col("_fold") != f)).transform(cells.where(F.col("_fold") == f)).agg(error).first()[0] for f in folds]
    model = PipelineModel([binned, *fit(cells).stages])
    steps.clear()
    ranked = sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
    return {"model": model, "cv_rmse": float(np.mean(errors)), "importances": ranked[:20]}


def classifier(rows: DataFrame, test: DataFrame, features: list[str], label: str = "high", seed: int = 42) -> dict:
    """ML-05: a classifier of high engagement with its area under the curve, accuracy, and that of the majority.

    Rows of equal bins and label are one weighted cell to the trees and to the measures, so only binning passes over rows.
    """
    steps = Steps(rows.sparkSession, "classifier")
    binned = _bins(rows, features)
    names = binned.getOutputCols()
    celled = lambda part: steps.save(_in_cells(binned, part, label).agg(F.count("*").cast("double").alias("_w")))
    grown = Pipeline(stages=[assembled(names), GBTClassifier(labelCol=label, featuresCol="features", weightCol="_w", maxIter=10, maxDepth=3, seed=seed)]).fit(celled(rows))
    scored = grown.transform(celled(test))
    accuracy = MulticlassClassificationEvaluator(labelCol=label, weightCol="_w", metricName="accuracy").evaluate(scored)
    share = scored.agg(F.sum(F.col(label) * F.col("_w")) / F.sum("_w")).first()[0] or 0.0
    auc = BinaryClassificationEvaluator(labelCol=label, weightCol="_w").evaluate(scored)
    steps.clear()
    return {"model": PipelineModel([binned, *grown.stages]), "auc": auc, "accuracy": accuracy, "majority": max(share, 1 - share)}


def format_recommender(rows: DataFrame, features: list[str], by: str = "engagement", fmt: str = "content_format", seed: int = 42) -> PipelineModel:
    """ML-06: a forest over the formats of rows above the median."""
    good = rows.where(F.col(by) > F.lit(quantiles(rows, by, [0.5])[0]).cast("double"))
    names = StringIndexer(inputCol=fmt, outputCol="_format", stringOrderType="alphabetAsc", handleInvalid="skip")
    return Pipeline(stages=[names, assembled(features), RandomForestClassifier(labelCol="_format", featuresCol="features", numTrees=20, maxDepth=5, seed=seed)]).fit(good)


def recommended(model: PipelineModel, rows: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` formats of each row with their probabilities."""
    labels = model.stages[0].labels
    made = PipelineModel(model.stages[1:]).transform(rows)
    pairs = F.zip_with(vector_to_array("probability"), F.array(*[F.lit(x) for x in labels]), lambda p, f: F.struct((-p).alias("p"), f.alias("format")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, top), lambda x: F.struct(x["format"].alias("format"), (-x["p"]).alias("probability")))
    return made.withColumn("recommended", best).drop("features", "rawPrediction", "probability", "prediction")


def ensemble(model: Column, heuristic: Column, n: Column) -> dict[str, Column]:
    """ML-07: a batch's scores, ``alpha`` of the model's and the rest of the heuristic one's, by the model's training rows ``n``;
    without a model's score the heuristic one."""
    alpha = F.when(model.isNull(), 0.0).otherwise(confidence(n))
    return {"alpha": alpha, "score": alpha * F.coalesce(model, F.lit(0.0)) + (1 - alpha) * heuristic, "explained_by": F.when(alpha >= 0.5, "model").otherwise("heuristic")}


def online_score(weights: Column, features: list[str]) -> Column:
    """The incremental model's prediction: features and a constant against its weights."""
    values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features], F.lit(1.0))
    return F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def best_available(candidates: dict[str, Column], drifting: Column, online: Column) -> dict[str, Column]:
    """ML-11: the first score there is, the online one under drift, and where it comes from."""
    source = F.lit(None).cast("string")
    for name, score in reversed(candidates.items()):
        source = F.when(score.isNotNull(), name).otherwise(source)
    use = drifting & online.isNotNull()
    return {"score": F.when(use, online).otherwise(F.coalesce(*candidates.values())), "source": F.when(use, "online").otherwise(source)}


def feature_confidence(features: list[str]) -> Column:
    """ML-12: the share of features that aren't 0, as 60 to 95."""
    there = sum((F.when(F.coalesce(F.col(f), F.lit(0.0)) != 0, 1).otherwise(0) for f in features), F.lit(0)) / len(features)
    return F.least(F.greatest(60 + there * 35, F.lit(60.0)), F.lit(95.0))


@dataclass
class Reducer:
    """ML-14: a truncated singular value decomposition, not centred."""

    components: DenseMatrix
    explained: list[float]

    def transform(self, rows: DataFrame, vector: str, out: str = "reduced") -> DataFrame:
        columns = self.components.toArray().T.tolist()
        dot = lambda c: F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in c]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return rows.withColumn(out, F.array(*[dot(c) for c in columns]))


def reducer(rows: DataFrame, vector: str, k: int, least: int = 10) -> Reducer | None:
    """ML-14/22: fitted on rows that have the vector; None with too few. The Gram matrix is summed over partitions."""
    there = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(vector).cast("array<double>").alias("v"))
    total = there.count()
    if total < least:
        return None
    made = _gram(there).collect()
    width = made[0]["width"]
    gram = np.zeros((width, width))
    for r in made:
        gram[r["i"]] = r["row"]
    values, vectors = np.linalg.eigh(gram)
    best = np.argsort(-values)[:k]
    whole = float(np.trace(gram))
    return Reducer(DenseMatrix(width, len(best), vectors[:, best].ravel(order="F")), [float(max(values[i], 0.0) / whole) for i in best])


def _gram(vectors: DataFrame) -> DataFrame:
    """The Gram matrix of vectors ``v`` as its rows (i, row, width): summed in each task over Arrow batches, then over tasks.
    Its size is that of the vectors, whatever their number."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(total))), "row": total.tolist()}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    parts = vectors.mapInArrow(partial, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda c: c["x"])
    return sums.groupBy("i").agg(row.alias("row"), F.count("*").cast("int").alias("width"))


def reduced_or_zero(rows: DataFrame, vector: str, fitted: Reducer | None, k: int, out: str) -> DataFrame:
    """ML-22: reduced vectors, zeros where a row or the reducer is missing."""
    zeros = F.array(*[F.lit(0.0)] * k)
    if fitted is None:
        return rows.withColumn(out, zeros)
    made = fitted.transform(rows.withColumn("_v", F.col(vector).cast("array<double>")), "_v", out)
    return made.withColumn(out, F.when(F.col(vector).isNotNull() & (F.size(vector) > 0), F.col(out)).otherwise(zeros)).drop("_v")


def principal_components(rows: DataFrame, vector: str, k: int = 10) -> PipelineModel:
    """ML-19: centred components; Spark's PCA doesn't subtract the mean when it transforms, so a scaler does."""
    made = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="components")]).fit(made)


def training_records(rows: DataFrame, features: list[str], at: str = "posted_at") -> DataFrame:
    """ML-17: records with time parts, an encoded type, and features that are never NULL."""
    from tidemark.functions.cleaning import encoded, hour_and_day
    from tidemark.functions.text import aligned

    made = rows.withColumns(hour_and_day(F.col(at)) | {"post_type": encoded(F.col("content_format"))})
    keep = [c for c in made.columns if c not in features]
    return aligned(made, features, keep)


def smote(minority: DataFrame, ident: str, features: list[str], wanted: int, k: int = 5, seed: int = 42) -> DataFrame:
    """LAB-07: ``wanted`` synthetic rows between a minority row and one of its ``k`` nearest (``near_rows``); a lone row is copied.

    Rows take turns in the order of keyed hashes; a row's turns are made in place, so nothing is ordered or limited as a whole.
    """
    from tidemark.operators.sampling import keyed

    total = minority.count()
    near = near_rows(minority, ident, features, k).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "near_id"))).alias("near"))
    turns = with_place(minority.withColumn("_hash", keyed(ident, seed)), "_hash", ident, "_turn").drop("_hash")
    times = F.floor((F.lit(wanted) - 1 - F.col("_turn")) / max(total, 1)) + 1
    rows = turns.where(F.col("_turn") < wanted).join(near.withColumnRenamed("row_id", ident), ident, "left")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    draw = lambda n: keyed(ident, "copy", n, seed) % 1_000_001 / 1_000_000
    chosen = F.try_element_at("near", (F.floor(draw(0) * F.size("near") * 0.999999) + 1).cast("int"))["near_id"]
    picked = copies.withColumns({"_other": F.coalesce(chosen, F.col(ident)), "_u": draw(1)})
    other = minority.select(F.col(ident).alias("_other"), *[F.col(f).alias(f"_{f}") for f in features])
    made = picked.join(other, "_other").withColumns({f: F.col(f) + F.col("_u") * (F.col(f"_{f}") - F.col(f)) for f in features})
    return made.select(ident, "copy", *features, F.col("_other").alias("towards"), F.lit(True).alias("is_synthetic"))


def compare_weights(predictions: DataFrame, weights: DataFrame, ident: str = "post_id") -> DataFrame:
    """TOP-13: the index of each prediction (log_*) under each weight set (name and five weights), the best set and the range.

    Weight sets are a dimension of a few rows: they meet each prediction as one array, so a prediction stays one row.
    """
    sets = weights.agg(F.collect_list(F.struct("name", *METRICS)).alias("_sets"))

    def index(w: Column) -> Column:
        amount = sum((F.col(f"log_{m}") * w[m] for m in METRICS), F.lit(0.0)) / sum((w[m] for m in METRICS), F.lit(0.0)) * 15
        return F.struct(F.least(F.greatest(amount, F.lit(0.0)), F.lit(100.0)).alias("rpi"), w["name"].alias("name"))

    scored = predictions.crossJoin(F.broadcast(sets)).select(ident, F.transform("_sets", index).alias("_all"))  # one row of sets
    scored = scored.select(ident, F.array_max("_all").alias("_most"), F.array_min("_all").alias("_least"))
    # An ident is one row as a rule; where it has more, the best and the least of all of them count.
    made = scored.groupBy(ident).agg(F.max("_most").alias("m"), F.min("_least.rpi").alias("l"))
    return made.select(ident, F.col("m.name").alias("best"), F.col("m.rpi").alias("best_rpi"), (F.col("m.rpi") - F.col("l")).alias("range"))


def retrain_report(rows: DataFrame, features: list[str], label: str, at: str, days: int = 7) -> DataFrame:
    """ML-15: split by time, fit, and the errors of the model beside the mean's, in one row."""
    from tidemark.operators.evaluation import errors, mean_predictor
    from tidemark.operators.sampling import split_by_time

    split = split_by_time(rows, at, days)
    model = regression(split.where("not is_test"), features, label, trees=5, depth=3)
    scored = model.transform(split.where("is_test")).select(F.col(label).alias("y"), F.col("prediction").alias("p"))
    own = scored.agg(*[c.alias(k) for k, c in errors().items()], F.count("*").alias("test_rows"))
    return own.crossJoin(mean_predictor(split.where("not is_test").select(F.col(label).alias("y")), scored))
