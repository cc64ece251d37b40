"""Counts, shares, association and classification metrics as small aggregate tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.operators.ordering import exact_quantile, row_number, with_scalar
from coinweave.session import broadcast_if_small


def count_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total_count"))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return count_by(df, a, b)


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): counts of each pair over the total of its ``b`` value; absent pairs share 0.

    Works on the contingency table, so the windows see one row per pair of categories."""
    counts = contingency(df.select(F.col(a), F.col(b).cast("string").alias(b)), a, b)
    wide = counts.groupBy(a).pivot(b).agg(F.sum("n")).na.fill(0)
    filled = wide.unpivot([a], [c for c in wide.columns if c != a], b, "n")
    totals = counts.groupBy(b).agg(F.sum("n").alias("__t"))
    return filled.join(broadcast_if_small(totals), b).select(a, b, "n", (F.col("n") / F.col("__t")).alias("share"))


def log_gamma_half(twice: Column) -> Column:
    """Log of gamma(``twice`` / 2) for a whole ``twice`` of 1 or more: a sum over the recurrence."""
    odd = F.pmod(twice, F.lit(2)) == 1
    first = F.when(odd, F.lit(0.5 * math.log(math.pi))).otherwise(F.lit(0.0))
    steps = F.when(twice > 2, F.sequence(F.lit(1).cast("bigint"), F.floor((twice - 1) / 2)))
    factor = lambda j: F.log(F.when(odd, j - 0.5).otherwise(j.cast("double")))
    return F.when(steps.isNull(), first).otherwise(F.aggregate(steps, first, lambda total, j: total + factor(j)))


def chi_square_tail(chi2: Column, dof: Column) -> Column:
    """Probability that a chi-square variable of ``dof`` degrees exceeds ``chi2``: the regularised upper incomplete
    gamma function, by its power series below the mean and by its continued fraction above. 1 without a degree."""
    a, x, one = dof / F.lit(2.0), chi2 / F.lit(2.0), F.lit(1.0)
    rounds = F.sequence(F.lit(1).cast("bigint"), (F.lit(200) + 12 * F.sqrt(a)).cast("bigint"))
    front = F.exp(a * F.log(x) - x - log_gamma_half(dof))
    step = lambda s, i: F.struct((s["t"] * x / (a + i)).alias("t"), (s["sum"] + s["t"] * x / (a + i)).alias("sum"))
    series = F.aggregate(rounds, F.struct((one / a).alias("t"), (one / a).alias("sum")), step)["sum"]
    # Lentz: c and d are the ratios of successive numerators and denominators.
    least = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def turn(s: Column, i: Column) -> Column:
        down, b = i * (a - i), s["b"] + 2.0
        d, c = one / least(down * s["d"] + b), least(b + down / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    b = x + 1.0 - a
    start = F.struct(b.alias("b"), F.lit(1e300).alias("c"), (one / least(b)).alias("d"), (one / least(b)).alias("h"))
    fraction = F.aggregate(rounds, start, turn)["h"]
    return F.when((dof < 1) | (x <= 0), one).when(x < a + 1.0, F.greatest(one - front * series, F.lit(0.0))).otherwise(front * fraction)


def cramers_v(df: DataFrame, a: str, b: str, correction: bool = True) -> DataFrame:
    """One row: n, chi2, dof, Cramer's V and p-value of two categorical columns. With ``correction`` a table of two by two has
    its deviations lessened by a half at most (Yates).

    Unobserved pairs contribute their expectation, which in total is n minus the expectations observed. Category totals are
    two more groupings, joined back; nothing is gathered."""
    o = contingency(df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
    by = {k: o.groupBy(k).agg(F.sum("n").alias(f"r{k}")) for k in ("a", "b")}
    shaped = o.withColumn("o", F.col("n").cast("double")).join(broadcast_if_small(by["a"]), "a").join(broadcast_if_small(by["b"]), "b")
    # sum (o-e)^2/e over all cells = sum o^2/e - n, and unobserved cells have o = 0.
    parts = shaped.agg(F.coalesce(F.sum("o"), F.lit(0.0)).alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"))
    for k in ("a", "b"):
        parts = with_scalar(parts, by[k].agg(F.count("*").alias(f"k{k}"), F.sum(F.lit(1.0) / F.col(f"r{k}")).alias(f"i{k}")))
    plain = F.greatest(F.col("n") * F.col("s") - F.col("n"), F.lit(0.0))
    dof = F.greatest(F.col("ka") - 1, F.lit(0)) * F.greatest(F.col("kb") - 1, F.lit(0))
    # All deviations of a two-by-two table are equal: chi2 = deviation^2 * sum 1/e.
    inverse = F.col("n") * F.col("ia") * F.col("ib")
    lessened = F.greatest(F.sqrt(plain / inverse) - 0.5, F.lit(0.0))
    chi2 = F.when(F.lit(correction) & (dof == 1), lessened * lessened * inverse).otherwise(plain)
    smaller = F.least("ka", "kb") - 1
    found = parts.select(F.col("n").cast("bigint").alias("n"), F.coalesce(chi2, F.lit(0.0)).alias("chi2"), dof.alias("dof"), smaller.alias("smaller"))
    return found.select(
        "n", "chi2", "dof", F.when(F.col("smaller") > 0, F.sqrt(F.col("chi2") / (F.col("n") * F.col("smaller")))).otherwise(F.lit(0.0)).alias("v"),
        chi_square_tail(F.col("chi2"), F.col("dof")).alias("p_value"),
    )


def chi_square_p_value(df: DataFrame, a: str, b: str) -> float:
    """p-value of the independence test by the built-in statistics package (on indexed categories)."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    text = df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna()
    indexed = StringIndexer(inputCols=["a", "b"], outputCols=["ia", "ib"]).fit(text).transform(text)
    vector = VectorAssembler(inputCols=["ia"], outputCol="v").transform(indexed)
    return float(ChiSquareTest.test(vector, "v", "ib").head()["pValues"][0])


def present_in_both_classes(df: DataFrame, flag: str) -> DataFrame:
    flagged = df.filter(F.col(flag) == 1)
    return flagged.agg(
        (F.coalesce(F.bool_or(F.col("class") == 0), F.lit(False)) & F.coalesce(F.bool_or(F.col("class") == 1), F.lit(False))).alias("in_both"),
        F.avg(F.col("class").cast("double")).alias("illicit_share"),
    )


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    return exact_quantile(df, column, q)


def median(df: DataFrame, column: str) -> DataFrame:
    return exact_quantile(df, column, 0.5, "median")


def contribution_total(evidence: DataFrame) -> DataFrame:
    total = F.aggregate("xai_breakdown", F.lit(0.0), lambda acc, x: acc + x["contribution_percentage"])
    return evidence.select("tx_id", total.alias("total"))


def class_balance(train: DataFrame) -> DataFrame:
    """pos_weight: negatives over positives of the training rows, 1 without positives."""
    return train.agg(
        F.sum((F.col("class") == 1).cast("int")).alias("pos"), F.sum((F.col("class") == 0).cast("int")).alias("neg")
    ).select("pos", "neg", F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(F.lit(1.0)).alias("pos_weight"))


def confusion_matrix(pred: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    hit = F.coalesce(F.col(score) > threshold, F.lit(False))
    pos = F.col(label) == 1
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).cast("bigint")
    return pred.filter(F.col(label).isin(0, 1)).agg(
        n(~pos & ~hit).alias("tn"), n(~pos & hit).alias("fp"), n(pos & ~hit).alias("fn"), n(pos & hit).alias("tp")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages; 0 for 0/0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    base = cm.select(
        "*",
        _ratio(tn, tn + fn).alias("p0"), _ratio(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        _ratio(tp, tp + fp).alias("p1"), _ratio(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
    )
    for k in "01":
        p, r = F.col(f"p{k}"), F.col(f"r{k}")
        base = base.withColumn(f"f{k}", _ratio(2 * p * r, p + r))
    n = F.col("s0") + F.col("s1")
    accuracy = _ratio(F.col("tn") + F.col("tp"), n)
    mean = lambda m: (F.col(f"{m}0") + F.col(f"{m}1")) / 2
    weighted = lambda m: _ratio(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), n)

    def line(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.cast("bigint").alias("support")
        )

    lines = F.array(
        line("licit", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line("illicit", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", accuracy, accuracy, accuracy, n),
        line("macro avg", mean("p"), mean("r"), mean("f"), n),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), n),
    )
    return base.select(F.inline(lines))


def f1(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return confusion_matrix(pred, label, score).select(
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")
    )


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(
        F.count("*").cast("double").alias("validation_size"),
        F.coalesce(F.avg((F.col(label) == F.col(prediction)).cast("double")), F.lit(0.0)).alias("validation_accuracy"),
    )


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve as the rank statistic, ties counted half, exact at any size.

    Scores collapse to one row per distinct value first; ranks come from a running sum in blocks."""
    from coinweave.operators.ordering import running_sum

    per = pred.filter(F.col(label).isin(0, 1)).groupBy(F.col(score).alias("s")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) == 0).cast("bigint")).alias("q")
    )
    below = running_sum(per, ["s"], F.col("q"), "upto")
    wins = F.col("p") * (F.col("upto") - F.col("q")) + F.col("p") * F.col("q") / 2
    return below.agg(F.sum(wins).alias("w"), F.sum("p").alias("np"), F.sum("q").alias("nq")).select(
        F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("w") / (F.col("np") * F.col("nq"))).alias("roc_auc")
    )


def auc(pred: DataFrame, label: str = "label", score: str = "score") -> dict[str, float]:
    """Areas under both curves by the built-in evaluator."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    shaped = pred.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("rawPrediction"))
    make = lambda m: BinaryClassificationEvaluator(metricName=m).evaluate(shaped)
    return {"pr_auc": make("areaUnderPR"), "roc_auc": make("areaUnderROC")}


def split_feasible(df: DataFrame, label: str = "label") -> DataFrame:
    """At least ten rows, more than one class, at least two rows in every class."""
    counts = count_by(df, label)
    return counts.agg(
        F.coalesce((F.sum("n") >= 10) & (F.count("*") > 1) & (F.min("n") >= 2), F.lit(False)).alias("feasible")
    )


def assert_counts(nodes: DataFrame, edges: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(check, passed, detail) for expected counts of: nodes, original_edges, time_steps, illicit, licit, unknown."""
    n = nodes.agg(
        F.count("*").alias("nodes"), F.countDistinct("time_step").alias("time_steps"),
        *[F.coalesce(F.sum((F.col("class") == v).cast("bigint")), F.lit(0)).alias(k) for k, v in (("illicit", 1), ("licit", 0), ("unknown", -1))],
    )
    original = F.col("edge_type") == "original" if "edge_type" in edges.columns else F.lit(True)
    e = edges.filter(original).agg(F.count("*").alias("original_edges"))
    parts = []
    for name, want in expected.items():
        src = e if name == "original_edges" else n
        parts.append(
            src.select(
                F.lit(f"count:{name}").alias("check"), (F.col(name) == want).alias("passed"), F.col(name).cast("string").alias("detail")
            )
        )
    return reduce(DataFrame.unionAll, parts)


def stratified_split(df: DataFrame, label: str, share: float = 0.2, seed: int = 26146, key: str = "tx_id") -> DataFrame:
    """Deterministic stratified hold-out: the first ``share`` of each label in hash order.

    Positions per label come from blocks, so a label that covers most rows is not sorted in one task."""
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    ranked = row_number(hashed, [label, "__h", key], "__r", [label])
    sizes = count_by(df, label).withColumnRenamed("n", "__n")
    held = F.col("__r") <= F.ceil(F.col("__n") * share)
    # One row per label: at most as many as there are classes, checked before it is broadcast.
    from coinweave.session import broadcast_if_small

    return ranked.join(broadcast_if_small(sizes, 1000), label).withColumn("is_holdout", held).drop("__h", "__r", "__n")


def temporal_split(time_step: Column, label: Column) -> Column:
    """train up to step 34, validation 35 to 42, test afterwards; only labelled rows take part."""
    return F.when(label == -1, F.lit(None)).when(time_step <= 34, F.lit("train")).when(
        time_step <= 42, F.lit("validation")
    ).otherwise(F.lit("test"))


def top_weights(weights: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` features of largest absolute weight; earlier features win ties."""
    return weights.orderBy(F.desc(F.abs("weight")), "feature_index").limit(k)
