"""Supervised and unsupervised learning over all vectors at once, distributed by pyspark.ml or by sums of outer products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import table


#: name -> function of training rows (vec_id, embedding, label) that gives a function of rows (vec_id, embedding[, label]) to (vec_id[, label], prediction)
MODELS: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]] = {}


def model(name: str, doc: str):
    """Registers a fit function as a model of the bank, and as a query that fits and predicts all vectors."""

    def add(fit):
        MODELS[name] = fit

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
            return fit(rows)(rows)

        run.__name__, run.__doc__ = name, doc
        query(None, name, layer="decision", supervised=True)(run)
        return fit

    return add


def featured(rows: DataFrame) -> DataFrame:
    """(vec_id, label, features, y) for pyspark.ml; rows without a label column have none."""
    from pyspark.ml.functions import array_to_vector

    more = [F.col("label"), F.col("label").cast("double").alias("y")] if "label" in rows.columns else []
    return rows.select("vec_id", *more, array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(table(spark, sf_dir, "embeddings"))


def predicted(model, rows: DataFrame) -> DataFrame:
    keep = [c for c in ("vec_id", "label") if c in rows.columns]
    return model.transform(rows).select(*keep, F.col("prediction").cast("int").alias("prediction"))


def classifier(name: str, make, doc: str) -> None:
    def fit(rows: DataFrame):
        fitted = make().setLabelCol("y").fit(featured(rows))
        return lambda new: predicted(fitted, featured(new))

    model(name, doc)(fit)


def one_against_rest(make):
    from pyspark.ml.classification import OneVsRest

    return lambda: OneVsRest(classifier=make(), parallelism=4)


def _ml():
    from pyspark.ml import classification

    return classification


classifier("logistic_regression", lambda: _ml().LogisticRegression(maxIter=50, regParam=0.001), "Multinomial logistic regression.")
classifier("decision_tree", lambda: _ml().DecisionTreeClassifier(maxDepth=5, seed=0), "A tree.")
classifier("random_forest", lambda: _ml().RandomForestClassifier(numTrees=20, maxDepth=5, seed=0), "Trees on redrawn rows and drawn columns.")
classifier("bagging", lambda: _ml().RandomForestClassifier(numTrees=10, maxDepth=5, seed=0, featureSubsetStrategy="all"), "Trees on redrawn rows and all columns, by the mean of their shares.")
classifier("gradient_boosting", lambda: one_against_rest(lambda: _ml().GBTClassifier(maxIter=5, maxDepth=3, seed=0))(), "Boosted trees, one class against the rest.")
classifier("hist_gradient_boosting", lambda: one_against_rest(lambda: _ml().GBTClassifier(maxIter=5, maxDepth=3, seed=0, maxBins=16))(), "Boosted trees on histograms of sixteen bins, one class against the rest.")
classifier("gaussian_nb", lambda: _ml().NaiveBayes(modelType="gaussian"), "Gaussian naive Bayes.")
classifier("mlp_classifier", lambda: _ml().MultilayerPerceptronClassifier(layers=[64, 32, 10], maxIter=40, seed=0), "One hidden layer of 32, for 64 numbers and ten classes.")


def votes_of(rows: DataFrame, predictions: list[DataFrame], weights: list[float]) -> DataFrame:
    """The class of most weight over tables (vec_id, prediction); of equal ones the lowest."""
    every = None
    for p, w in zip(predictions, weights):
        p = p.select("vec_id", F.col("prediction").alias("c"), F.lit(float(w)).alias("w"))
        every = p if every is None else every.union(p)
    best = every.groupBy("vec_id", "c").agg(F.sum("w").alias("w")).groupBy("vec_id").agg(F.min_by("c", F.struct(-F.round("w", 9), "c")).alias("prediction"))
    keep = [c for c in ("vec_id", "label") if c in rows.columns]
    return rows.select(*keep).join(best, "vec_id").select(*keep, F.col("prediction").cast("int").alias("prediction"))


@model("adaboost", "Multi-class AdaBoost (SAMME): shallow trees on reweighted rows, votes by the log odds of being right.")
def _adaboost(rows: DataFrame, rounds: int = 6, depth: int = 3):
    from pyspark.ml.classification import DecisionTreeClassifier

    train = featured(rows).withColumn("w", F.lit(1.0))
    r = train.agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).first()
    n, classes = r["n"], r["k"]
    trees, says = [], []
    for _ in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, labelCol="y", weightCol="w", seed=0).fit(train)
        wrong = tree.transform(train).withColumn("wrong", (F.col("prediction") != F.col("y")).cast("double"))
        s = wrong.agg(F.sum(F.col("w") * F.col("wrong")).alias("e"), F.sum("w").alias("w")).first()
        error = min(max(s["e"] / s["w"], 1e-9), 1 - 1e-9)
        say = float(np.log((1 - error) / error) + np.log(max(classes - 1, 1)))
        if say <= 0:
            break
        trees.append(tree)
        says.append(say)
        total = s["w"] + s["e"] * (np.exp(say) - 1)
        train = wrong.withColumn("w", F.col("w") * F.exp(F.col("wrong") * say) * (n / total)).select(*train.columns)
    return lambda new: votes_of(new, [predicted(t, featured(new).drop("label")) for t in trees], says)


@model("extra_trees", "Extremely randomised trees: each tree sees every column at three cuts drawn between its least and greatest value, on all rows.")
def _extra_trees(rows: DataFrame, n_trees: int = 8, cuts: int = 3):
    from pyspark.ml.classification import RandomForestClassifier

    dims = rows.select(F.size("embedding").alias("d")).first()["d"]
    ends = rows.agg(*[F.min(F.col("embedding")[j]).alias(f"a{j}") for j in range(dims)], *[F.max(F.col("embedding")[j]).alias(f"b{j}") for j in range(dims)]).first()
    low, high = np.array([ends[f"a{j}"] for j in range(dims)], float), np.array([ends[f"b{j}"] for j in range(dims)], float)
    rng = np.random.default_rng(0)
    drawn = [rng.uniform(low, high, (cuts, dims)) for _ in range(n_trees)]

    def cut(df: DataFrame, at: np.ndarray) -> DataFrame:
        bits = F.concat(*[F.zip_with(F.col("embedding").cast("array<double>"), F.array(*[F.lit(float(v)) for v in row]), lambda x, c: (x >= c).cast("double")) for row in at])
        return df.withColumn("embedding", bits)

    trees = [RandomForestClassifier(numTrees=1, maxDepth=8, bootstrap=False, featureSubsetStrategy="onethird", labelCol="y", seed=i).fit(featured(cut(rows, at))) for i, at in enumerate(drawn)]
    return lambda new: votes_of(new, [predicted(t, featured(cut(new, at)).drop("label")) for t, at in zip(trees, drawn)], [1.0] * n_trees)


@model("sgd_classifier", "Linear hinge loss, one class against the rest, by stochastic gradients: every task passes over its rows, and the tasks' weights are averaged after each of five rounds.")
def _sgd(rows: DataFrame, rounds: int = 5, rate: float = 0.01, penalty: float = 1e-4):
    names = np.array(sorted(r["label"] for r in rows.select("label").distinct().collect()))  # classes
    dims = rows.select(F.size("embedding").alias("d")).first()["d"]
    w = np.zeros((dims + 1, len(names)))
    for k in range(rounds):
        step = rate / (1 + k)

        def part(batches: Iterator[pd.DataFrame], w=w, step=step) -> Iterator[pd.DataFrame]:
            own, n = w.copy(), 0
            for pdf in batches:
                if not len(pdf):
                    continue
                a = np.column_stack([np.stack(pdf["embedding"].to_numpy()).astype(float), np.ones(len(pdf))])
                y = np.where(pdf["label"].to_numpy()[:, None] == names, 1.0, -1.0)
                for i in range(len(a)):
                    short = (y[i] * (a[i] @ own) < 1) * y[i]
                    own = own * (1 - step * penalty) + step * np.outer(a[i], short)
                n += len(a)
            if n:
                yield pd.DataFrame({"n": [n], "w": [own.ravel().tolist()]})

        got = rows.select("embedding", "label").mapInPandas(part, "n bigint, w array<double>")
        mean = got.select("n", F.posexplode("w").alias("j", "x")).groupBy("j").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).orderBy("j").collect()  # as many numbers as the model has
        w = np.array([r["x"] for r in mean]).reshape(w.shape)
    return lambda new: scored_by(new, lambda a: (names, a @ w[:-1] + w[-1]))


@model("svm_classifier", "Support vectors with a radial kernel by 256 random Fourier features, one class against the rest.")
def _svm(rows: DataFrame, features: int = 256):
    from pyspark.ml.classification import LinearSVC, OneVsRest

    r = rows.select(F.size("embedding").alias("d"), F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x).alias("q")).agg(F.max("d").alias("d"), F.avg("q").alias("q")).first()
    rng = np.random.default_rng(0)
    w, b = rng.standard_normal((r["d"], features)) / np.sqrt(max(r["q"], 1e-9)), rng.uniform(0, 2 * np.pi, features)

    def lifted(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    z = np.cos(np.stack(pdf["embedding"].to_numpy()).astype(float) @ w + b) * np.sqrt(2 / features)
                    yield pdf.assign(embedding=list(z))

        keep = [c for c in ("vec_id", "embedding", "label") if c in df.columns]
        kinds = {"vec_id": "vec_id bigint", "embedding": "embedding array<double>", "label": "label int"}
        return df.select(*keep).mapInPandas(run, ", ".join(kinds[c] for c in keep))

    fitted = OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.001), labelCol="y", parallelism=4).fit(featured(lifted(rows)))
    return lambda new: predicted(fitted, featured(lifted(new)))


def class_moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by class. Each task sums its rows, one aggregate the tasks; the driver gets a row a class."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for y, g in pdf.groupby("label"):
                a = np.stack(g["embedding"].to_numpy()).astype(float)
                n, s, q = kept.get(y, (0, 0.0, 0.0))
                kept[y] = (n + len(a), s + a.sum(0), q + a.T @ a)
        for y, (n, s, q) in kept.items():
            yield pd.DataFrame({"label": [y], "n": [n], "v": [np.concatenate([s, q.ravel()]).tolist()]})

    parts = rows.select("label", "embedding").mapInPandas(part, "label int, n bigint, v array<double>")
    n = {r["label"]: r["n"] for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    sums = parts.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]).alias("v"))
    out = {}
    for r in sums.collect():
        d = int((np.sqrt(1 + 4 * len(r["v"])) - 1) / 2)
        v = np.array(r["v"])
        out[r["label"]] = (n[r["label"]], v[:d], v[d:].reshape(d, d))
    return out


def scored_by(rows: DataFrame, score) -> DataFrame:
    """The class of greatest score(embeddings) -> (classes, (n, classes)), by batches."""
    keep = [c for c in ("vec_id", "label") if c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                names, values = score(np.stack(pdf["embedding"].to_numpy()).astype(float))
                yield pdf[keep].assign(prediction=names[values.argmax(1)])

    kinds = {"vec_id": "vec_id bigint", "label": "label int"}
    return rows.select(*keep, "embedding").mapInPandas(run, ", ".join([*(kinds[c] for c in keep), "prediction int"]))


def gaussians(rows: DataFrame, shared: bool):
    m = class_moments(rows)
    names = np.array(sorted(m))
    n = np.array([m[k][0] for k in names])
    mean = np.stack([m[k][1] / m[k][0] for k in names])
    cov = np.stack([m[k][2] / m[k][0] - np.outer(m[k][1], m[k][1]) / m[k][0] ** 2 for k in names])
    if shared:
        cov = np.broadcast_to((cov * (n / n.sum())[:, None, None]).sum(0), cov.shape)
    cov = cov + 1e-3 * np.eye(mean.shape[1])
    inv, size = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def score(a):
        d = a[:, None] - mean[None]
        return names, -0.5 * np.einsum("nkd,kde,nke->nk", d, inv, d) - 0.5 * size + np.log(n / n.sum())

    return score


@model("lda", "Linear discriminants: class means and one covariance.")
def _lda(rows: DataFrame):
    score = gaussians(rows, True)
    return lambda new: scored_by(new, score)


@model("qda", "Quadratic discriminants: a covariance for each class.")
def _qda(rows: DataFrame):
    score = gaussians(rows, False)
    return lambda new: scored_by(new, score)


@model("ridge_classifier", "Ridge regression on plus and minus one for each class, by its normal equations.")
def _ridge(rows: DataFrame):
    m = class_moments(rows)
    names = np.array(sorted(m))
    total, s, q = sum(v[0] for v in m.values()), sum(v[1] for v in m.values()), sum(v[2] for v in m.values())
    centred = q - np.outer(s, s) / total + np.eye(len(s))
    w, b = [], []
    for k in names:
        n, t, _ = m[k]
        my = (2 * n - total) / total
        c = np.linalg.solve(centred, (2 * t - s) - s * my)
        w.append(c)
        b.append(my - c @ s / total)
    w, b = np.array(w).T, np.array(b)
    return lambda new: scored_by(new, lambda a: (names, a @ w + b))


@query(None, layer="pattern")
def kmeans_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors."""
    from pyspark.ml.clustering import KMeans

    rows = vectors(spark, sf_dir)
    return predicted(KMeans(k=10, seed=0, maxIter=20).fit(rows), rows)


@query(None, layer="noise")
def pca_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three principal components of all vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = vectors(spark, sf_dir)
    out = PCA(k=3, inputCol="features", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])
