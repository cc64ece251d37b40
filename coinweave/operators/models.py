"""Distributed classifiers over propagated features, and exact attributions of linear models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.operators import metrics, scoring
from coinweave.operators.graph import MAX_IMPORTANT
from coinweave.operators.links import apply_feedback
from coinweave.operators.neighbours import gcn_propagate, neighbour_sums
from coinweave.session import materialize

# Class order of the three-way model, seed of the hold-out.
CLASSES = ["licit", "illicit", "unknown"]
SEED = 26146


def mean_neighbor_features(nodes: DataFrame, edges: DataFrame, columns: list[str], hops: int = 2) -> DataFrame:
    """Own features plus, per hop, the mean over in-neighbours of the previous hop's values.

    Means are sums and counts with map-side combining; an isolated node gets 0. Columns of hop h are
    named ``<column>_h<h>``."""
    out = nodes
    source = nodes.select("txId", *[F.col(c).cast("double").alias(c) for c in columns])
    links = edges.select("source", "target")
    for hop in range(1, hops + 1):
        sent = links.join(source.withColumnRenamed("txId", "source"), "source")
        means = sent.groupBy(F.col("target").alias("txId")).agg(*[F.avg(c).alias(c) for c in columns])
        source = materialize(
            nodes.select("txId").join(means, "txId", "left").select(
                "txId", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns]
            ),
            "hop",
        )
        out = out.join(source.select("txId", *[F.col(c).alias(f"{c}_h{hop}") for c in columns]), "txId")
    return out


def _scaled(train: DataFrame, every: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    assembler = VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True)
    fitted = scaler.fit(assembler.transform(train))
    apply = lambda df: fitted.transform(assembler.transform(df)).drop("__raw")
    return apply(train), apply(every)


def _class_index(label: Column) -> Column:
    y = F.lit(float(CLASSES.index("unknown")))
    for i, name in enumerate(CLASSES):
        y = F.when(label == name, F.lit(float(i))).otherwise(y)
    return y


def fit_graph_classifier(features: DataFrame, incidence: DataFrame, hops: int = 2, heavy_degree: int = 64) -> tuple[PipelineModel, DataFrame] | None:
    """The fitted three-class model (assembling, scaling and classifying propagated features) and the rows it was fitted
    and held out on: tx_id, y, is_holdout and the propagated features. None where the classes are too small for a hold-out."""
    if not metrics.split_feasible(features).head()["feasible"]:
        return None
    columns = scoring.FEATURE_ORDER
    spread = gcn_propagate(incidence, features.select("tx_id", *columns), columns, hops, heavy_degree)
    labelled = spread.join(features.select("tx_id", _class_index(F.col("label")).alias("y")), "tx_id")
    split = materialize(metrics.stratified_split(labelled, "y", 0.2, SEED), "split")
    stages = [
        VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="keep"),
        StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True),
        LogisticRegression(featuresCol="__x", labelCol="y", family="multinomial", regParam=5e-4, maxIter=20),
    ]
    return Pipeline(stages=stages).fit(split.filter("not is_holdout")), split


def class_shares(model: PipelineModel, spread: DataFrame) -> DataFrame:
    """tx_id, predicted class, threat score and class shares of rows with propagated features."""
    p = vector_to_array("probability")
    predicted = model.transform(spread).select("tx_id", "prediction", p.alias("__p"))
    at = lambda i: F.coalesce(F.get("__p", F.lit(i)), F.lit(0.0))
    return predicted.select("tx_id", "prediction", *[c.alias(n) for n, c in scoring.normalize_probabilities(at(0), at(1), at(2)).items()])


def score_transactions(model: PipelineModel, features: DataFrame, incidence: DataFrame, hops: int = 2, heavy_degree: int = 64) -> DataFrame:
    """``features`` with the scores of a model, fitted just now or read with ``load_model``."""
    columns = scoring.FEATURE_ORDER
    spread = gcn_propagate(incidence, features.select("tx_id", *columns), columns, hops, heavy_degree)
    return features.join(class_shares(model, spread).drop("prediction"), "tx_id")


def graph_classifier(features: DataFrame, incidence: DataFrame, hops: int = 2, heavy_degree: int = 64):
    """Three-class scores of transactions over propagated features: ``(scored, validation, engine)``.

    Unlabelled rows are the third class and count as anomalous. Where the classes are too small for a
    hold-out the rule score takes over."""
    return classify(features, incidence, hops, heavy_degree)[:3]


def classify(features: DataFrame, incidence: DataFrame, hops: int = 2, heavy_degree: int = 64, label_bonus: bool = True):
    """``graph_classifier`` with the fitted model as the fourth part (None with the rules)."""
    fitted = fit_graph_classifier(features, incidence, hops, heavy_degree)
    if fitted is None:
        return scoring.rule_score(features, label_bonus), {"validation_size": 0.0, "validation_accuracy": 0.0}, "rules", None
    model, split = fitted
    shares = materialize(class_shares(model, split), "predicted")
    held = metrics.accuracy(split.filter("is_holdout").select("tx_id", "y").join(shares, "tx_id"), "y").head().asDict()
    return features.join(shares.drop("prediction"), "tx_id"), held, "graph_classifier", model


def save_model(model: PipelineModel, path: str) -> None:
    """Store a fitted model in a new folder."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_weights(model: PipelineModel, above: str = "illicit", below: str = "licit") -> tuple[dict[str, float], float]:
    """Weight of each unscaled feature and the constant of the log-odds of one class against another: the scaling is
    folded in, so the log-odds are a plain sum over columns. A feature that does not vary weighs nothing."""
    assembler, scaler, classifier = model.stages
    names, means, spreads = assembler.getInputCols(), scaler.mean.toArray(), scaler.std.toArray()
    coefficients, constants = classifier.coefficientMatrix.toArray(), classifier.interceptVector.toArray()
    i, j = CLASSES.index(above), CLASSES.index(below)
    if max(i, j) >= len(constants):
        raise ValueError(f"the model knows no class {above if i > j else below}")
    weights = {n: float((coefficients[i][k] - coefficients[j][k]) / spreads[k]) if spreads[k] else 0.0 for k, n in enumerate(names)}
    return weights, float(constants[i] - constants[j] - sum(weights[n] * means[k] for k, n in enumerate(names)))


def fitted_edge_attributions(
    model: PipelineModel, incidence: DataFrame, features: DataFrame, roots: DataFrame, hops: int = 2, heavy_degree: int = 64,
) -> DataFrame:
    """``edge_attributions`` of the fitted model: its weights over the features as they are before the last step."""
    columns, weights = scoring.FEATURE_ORDER, feature_weights(model)[0]
    before = features.select("tx_id", *[F.col(c).cast("double").alias(c) for c in columns])
    if hops > 1:
        before = materialize(gcn_propagate(incidence, before, columns, hops - 1, heavy_degree), "before")
    return edge_attributions(incidence, before, weights, roots, heavy_degree)


def suspicion_classifier(nodes: DataFrame, edges: DataFrame, columns: list[str], hops: int = 2):
    """Binary scores over neighbour means, positives weighted by class balance: ``(scored, report)``.

    ``nodes`` carries txId, class, time_step; an ``is_train`` column (set by feedback) adds rows to the
    training part."""
    wide = [c for h in range(0, hops + 1) for c in ([*columns] if h == 0 else [f"{c}_h{h}" for c in columns])]
    data = mean_neighbor_features(nodes, edges, columns, hops)
    part = metrics.temporal_split(F.col("time_step"), F.col("class"))
    forced = F.coalesce(F.col("is_train"), F.lit(False)) if "is_train" in nodes.columns else F.lit(False)
    data = materialize(data.withColumn("part", F.when(forced, F.lit("train")).otherwise(part)), "training")
    train = data.filter("part = 'train'")
    balance = metrics.class_balance(train).head()["pos_weight"]
    weight = F.when(F.col("class") == 1, F.lit(float(balance))).otherwise(F.lit(1.0))
    fit_rows, every = _scaled(train.withColumn("__w", weight), data, wide)
    model = LogisticRegression(featuresCol="__x", labelCol="class", weightCol="__w", maxIter=50, regParam=1e-4).fit(
        fit_rows.withColumn("class", F.col("class").cast("double"))
    )
    p = F.get(vector_to_array("probability"), F.lit(1))
    scored = model.transform(every.withColumn("class", F.col("class").cast("double"))).select(
        "txId", F.col("class").cast("int").alias("label"), "time_step", "part", F.round(p, 6).alias("score")
    )
    scored = materialize(scored, "scored")
    test = scored.filter("part = 'test'")
    return scored, metrics.classification_report(metrics.confusion_matrix(test))


def refit_with_feedback(nodes: DataFrame, edges: DataFrame, feedback: DataFrame, columns: list[str], hops: int = 2):
    """Patch labels with the last review of each node and fit again; also returns unknown reviewed ids."""
    if "is_train" not in nodes.columns:
        nodes = nodes.withColumn("is_train", F.lit(False))
    patched, unknown = apply_feedback(nodes, feedback)
    scored, report = suspicion_classifier(patched, edges, columns, hops)
    return scored, report, unknown


def _linear_surrogate(scored: DataFrame, columns: list[str]) -> tuple[LogisticRegressionModel, DataFrame] | None:
    y = (F.col("threat_score") >= scoring.ALERT_THRESHOLD).cast("double")
    counts = {r["y"]: r["n"] for r in scored.select(y.alias("y")).groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total < 4 or len(counts) < 2:
        return None
    balanced = F.when(y == 1, F.lit(total / (2.0 * counts[1.0]))).otherwise(F.lit(total / (2.0 * counts[0.0])))
    base = scored.select("tx_id", *columns, y.alias("__y"), balanced.alias("__w"))
    fit_rows, _ = _scaled(base, base.limit(0), columns)
    return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=50, regParam=1e-3).fit(fit_rows), base


def surrogate_attributions(scored: DataFrame, columns: list[str] = scoring.FEATURE_ORDER) -> DataFrame | None:
    """(tx_id, raw): absolute linear attributions of the alert decision, or None when it cannot be fitted.

    The features are standardised, so the attribution of a feature is |weight * z|; as columns of the
    same projection, without another pass over pairs of rows."""
    fitted = _linear_surrogate(scored, columns)
    if fitted is None:
        return None
    weights = fitted[0].coefficients.toArray().tolist()
    moments = scored.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).head()

    def part(i: int, c: str) -> Column:
        mean, std = moments[f"m_{i}"], moments[f"s_{i}"]
        if not std:
            return F.lit(0.0)
        return F.abs(F.lit(weights[i]) * (F.col(c) - F.lit(mean)) / F.lit(std))

    raw = F.array(*[F.struct(F.lit(c).alias("feature"), part(i, c).alias("raw")) for i, c in enumerate(columns)])
    return scored.select("tx_id", raw.alias("raw"))


def edge_attributions(
    incidence: DataFrame, features: DataFrame, weights: dict[str, float], roots: DataFrame, heavy_degree: int = 64,
) -> DataFrame:
    """(root, src, dst, weight, n_edges): the leading edges into each root under one propagation step.

    A linear model over one step splits exactly into |dot(w, x_j)| / sqrt(d_i d_j) per edge j -> i. For a
    fixed root the order of its neighbours depends on j alone, so every wallet first keeps its
    strongest transactions (one more than MAX_IMPORTANT always contain that many best neighbours, the root
    itself being one of them) and only those meet the root: no wallet contributes more than nine rows to a root."""
    degree = neighbour_sums(incidence, features, [], heavy_degree).select(
        "tx_id", (F.col("n_neighbours") + 1).cast("double").alias("d")
    )
    dot = F.lit(0.0)
    for name, w in weights.items():
        dot = dot + F.lit(float(w)) * F.col(name)
    strength = materialize(
        features.join(degree, "tx_id").select("tx_id", "d", (F.abs(dot) / F.sqrt("d")).alias("s")), "strength"
    )
    n_edges = strength.agg(F.sum("d").cast("bigint").alias("n")).head()["n"]
    order = Window.partitionBy("address").orderBy(F.desc("s"), "tx_id")
    leaders = (
        incidence.join(strength, "tx_id")
        .withColumn("__r", F.row_number().over(order))
        .filter(F.col("__r") <= MAX_IMPORTANT + 1)
        .select("address", F.col("tx_id").alias("src"), "s")
    )
    root = roots.select("tx_id").distinct().join(strength.select("tx_id", F.col("d").alias("rd"), F.col("s").alias("rs")), "tx_id")
    met = root.join(incidence, "tx_id").join(leaders, "address").filter(F.col("src") != F.col("tx_id"))
    pairs = met.select("tx_id", "rd", "src", "s").distinct()
    loops = root.select("tx_id", "rd", F.col("tx_id").alias("src"), F.col("rs").alias("s"))
    return pairs.unionAll(loops).select(
        F.col("tx_id").alias("root"), "src", F.col("tx_id").alias("dst"),
        (F.col("s") / F.sqrt("rd")).alias("weight"), F.lit(n_edges).alias("n_edges"),
    )
