"""Evaluation of predictions.

Classification measures are functions of the confusion table, whose size is the
square of the number of classes; score curves are functions of the table of
distinct scores.  Either is built with one map-side combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.functions.numbers import adjusted_kurtosis, adjusted_skewness, ratio, rounded
from ledgerlens.functions.text import quoted
from ledgerlens.operators.charts import histogram, scatter
from ledgerlens.plans.catalog import columns_of, with_distinct, facts
from ledgerlens.plans.grouped import grouped_quantiles
from ledgerlens.plans.ordered import ROWS_PER_SLICE, running_totals
from ledgerlens.plans.ranks import Quantile, quantile_exprs

# Name fragments of each column role, in order of precedence.
ACTUAL_WORDS = ("actual", "true", "y_true", "label", "target", "ground_truth", "real", "observed", "expected", "correct", "answer")
PREDICTED_WORDS = ("predicted", "pred", "y_pred", "prediction", "output", "forecast", "estimate", "classified", "result")
PROBABILITY_WORDS = ("probability", "prob", "proba", "confidence", "score", "likelihood", "certainty", "softmax")
ID_NAMES = ("id", "index", "row_id", "sample_id", "uuid", "key")
BOX_WORDS = ("bbox", "box", "bounding", "x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax")
IMAGE_ENDINGS = (".jpg", ".png", ".jpeg", ".bmp", ".gif")
# Measures models are ranked by, and whether more is better.
CLASS_RANKING = (("accuracy", True), ("f1_macro", True), ("precision_macro", True), ("recall_macro", True))
VALUE_RANKING = (("r2_score", True), ("mae", False), ("rmse", False))
SMALLEST_PROBABILITY = 2.220446049250313e-16


def roles_by_name(names: list[str]) -> dict[str, str]:
    """Column name to role (actual, predicted, probability, id) from the names alone."""
    roles: dict[str, str] = {}

    def first_free(words: tuple[str, ...]) -> str | None:
        return next((n for w in words for n in names if w in n.lower() and n not in roles), None)

    for role, words in (("actual", ACTUAL_WORDS), ("predicted", PREDICTED_WORDS)):
        found = first_free(words)
        if found:
            roles[found] = role
    while (found := first_free(PROBABILITY_WORDS)) is not None:
        roles[found] = "probability"
    identifier = next((n for w in ID_NAMES for n in names if n.lower() == w or n.lower().endswith("_id")), None)
    if identifier:
        roles.setdefault(identifier, "id")
    return roles


def detect_roles(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype, distinct, role) of a prediction table."""
    infos = columns_of(df)
    roles = roles_by_name(df.columns)
    for c in infos:
        if c.kind in ("numeric", "boolean"):
            roles.setdefault(c.name, "feature")
    role = F.create_map(*[F.lit(x) for c in infos for x in (c.name, roles.get(c.name, "other"))])
    return with_distinct(facts(df, infos, ()), df, infos).select(
        "ordinal", F.col("name").alias("column"), "dtype", "distinct", F.element_at(role, F.col("name")).alias("role")
    ).orderBy("ordinal")


def detect_task(df: DataFrame, actual: str, most_classes: int = 100) -> DataFrame:
    """Regression, binary or multiclass, from the type and variety of the actual column.

    Columns with more distinct values than ``most_classes`` (20 in a narrower reading) are regression targets.
    """
    dtype = df.schema[actual].dataType.typeName()
    distinct = df.groupBy(quoted(actual).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count("v").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )
    spread = F.lit(dtype in ("float", "double", "decimal")) & (ratio(F.col("distinct"), F.col("rows")) > 0.1)
    return distinct.select(
        "rows", "distinct",
        F.when(spread, "regression").when(F.col("distinct") == 2, "binary_classification")
        .when(F.col("distinct") <= most_classes, "multiclass_classification").otherwise("regression").alias("task_type"),
    )


def vision_check(df: DataFrame) -> DataFrame:
    """Does the table hold bounding boxes or image names?  All rows of all text columns are looked at."""
    boxes = sum(word in name.lower() for word in BOX_WORDS for name in df.columns)
    ending = F.lit(False)
    for c in columns_of(df, "string"):
        for e in IMAGE_ENDINGS:
            ending = ending | F.coalesce(quoted(c.name).endswith(e), F.lit(False))
    images = df.agg(F.coalesce(F.max(ending), F.lit(False)).alias("images"))
    return images.select(
        (F.lit(boxes >= 4) | F.col("images")).alias("is_vision"), F.lit(boxes).alias("box_hits"),
        F.when(F.lit(boxes >= 4), "object_detection").when(F.col("images"), "image_classification").otherwise("none").alias("vision_type"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., actual, predicted, n)."""
    return df.groupBy(*by, quoted(actual).alias("actual"), quoted(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _grid(labels: DataFrame) -> DataFrame:
    """(actual, predicted) for all pairs of labels: the cells of the matrix that is asked for."""
    axis = labels.agg(F.sort_array(F.collect_set("label"))).scalar()
    return labels.select(F.col("label").alias("actual"), F.explode(axis).alias("predicted"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """All label pairs with count, share of the actual class and annotation."""
    cells = confusion(df, actual, predicted)
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).where(F.col("label").isNotNull()).distinct()
    full = _grid(labels).join(cells, ["actual", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint")))
    total = F.sum("n").over(Window.partitionBy("actual"))
    same, any_ = F.col("actual") == F.col("predicted"), F.col("n") > 0
    return full.select(
        "actual", "predicted", F.col("n").alias("count"), rounded(ratio(F.col("n"), total), 4).alias("normalized"),
        F.when(same & any_, "true_positive").when(same, "true_negative").when(any_, "false_positive")
        .otherwise("correct_rejection").alias("type"),
    )


def confusion_chart(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Matrix over the labels seen in the actual column only."""
    cells = confusion(df, actual, predicted)
    labels = cells.select(F.col("actual").alias("label")).where(F.col("label").isNotNull()).distinct()
    return _grid(labels).join(cells, ["actual", "predicted"], "left").select(
        F.col("predicted").cast("string").alias("x"), F.col("actual").cast("string").alias("y"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("value"),
    )


def _class_counts(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, tp, support, predicted) from a confusion table."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("guessed")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("guessed")),
    )
    return cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "guessed")])


def _scores() -> dict[str, Column]:
    tp, support, guessed = F.col("tp"), F.col("support"), F.col("guessed")
    return {
        "precision": F.coalesce(ratio(tp, guessed), F.lit(0.0)),
        "recall": F.coalesce(ratio(tp, support), F.lit(0.0)),
        "f1": F.coalesce(ratio(2 * tp, support + guessed), F.lit(0.0)),
    }


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 (percent) and support per class."""
    s = _scores()
    return _class_counts(confusion(df, actual, predicted)).select(
        "label", rounded(s["precision"] * 100, 2).alias("precision"), rounded(s["recall"] * 100, 2).alias("recall"),
        rounded(s["f1"] * 100, 2).alias("f1_score"), "support",
    )


def classification_metrics(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and weighted scores, MCC and kappa.

    With ``by`` the measures of several models come from the same job.
    """
    classes = _class_counts(confusion(df, actual, predicted, by), by).withColumns(_scores())
    d = {c: quoted(c).cast("double") for c in ("tp", "support", "guessed")}
    means = [F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")]
    weighted = [F.sum(quoted(c) * d["support"]).alias(f"{c}_w") for c in ("precision", "recall", "f1")]
    sums = classes.groupBy(*by).agg(
        F.sum("support").alias("n"), F.count(F.lit(1)).alias("n_classes"), F.sum(d["tp"]).alias("c"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"), *means, *weighted,
        F.sum(d["support"] * d["guessed"]).alias("pt"), F.sum(d["guessed"] * d["guessed"]).alias("pp"),
        F.sum(d["support"] * d["support"]).alias("tt"),
    )
    n, c = F.col("n").cast("double"), F.col("c")
    spread = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    expected = ratio(F.col("pt"), n * n)

    def pct(value: Column) -> Column:
        return rounded(value * 100, 2)

    return sums.select(
        *by, F.col("n").alias("n_samples"), "n_classes",
        pct(ratio(c, n)).alias("accuracy"), pct(F.col("balanced")).alias("balanced_accuracy"),
        *[x for k in ("precision", "recall", "f1") for x in
          (pct(F.col(f"{k}_macro")).alias(f"{k}_macro"), pct(ratio(F.col(f"{k}_w"), n)).alias(f"{k}_weighted"))],
        rounded(F.coalesce(F.try_divide(c * n - F.col("pt"), spread), F.lit(0.0)), 4).alias("matthews_corrcoef"),
        rounded(F.try_divide(ratio(c, n) - expected, 1 - expected), 4).alias("cohen_kappa"),
    )


def distributions(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Count and share of every label among actual and predicted values."""
    classes = _class_counts(confusion(df, actual, predicted))
    total = F.sum("support").over(Window.partitionBy(F.lit(1)))
    return classes.select(
        "label", F.col("support").alias("actual_count"), rounded(ratio(F.col("support"), total) * 100, 2).alias("actual_pct"),
        F.col("guessed").alias("predicted_count"),
    )


def error_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Number and share of wrong predictions."""
    right = F.coalesce(F.col("actual") == F.col("predicted"), F.lit(False))
    return confusion(df, actual, predicted).agg(
        F.coalesce(F.sum(F.when(~right, F.col("n"))), F.lit(0)).alias("total_errors"),
        rounded(ratio(F.coalesce(F.sum(F.when(~right, F.col("n"))), F.lit(0)), F.sum("n")) * 100, 2).alias("error_rate"),
    )


def confused_pairs(df: DataFrame, actual: str, predicted: str, top: int = 5) -> DataFrame:
    """Class pairs mixed up most often, both directions together.

    Only classes that occur as actual values form pairs.
    """
    cells = confusion(df, actual, predicted).where(F.col("actual") != F.col("predicted"))
    known = confusion(df, actual, predicted).select(F.col("actual").alias("label")).distinct()
    cells = cells.join(known, F.col("predicted") == F.col("label"), "left_semi")
    forward = F.col("actual") < F.col("predicted")
    return (
        cells.groupBy(F.least("actual", "predicted").alias("class_a"), F.greatest("actual", "predicted").alias("class_b"))
        .agg(F.coalesce(F.sum(F.when(forward, F.col("n"))), F.lit(0)).alias("a_as_b"),
             F.coalesce(F.sum(F.when(~forward, F.col("n"))), F.lit(0)).alias("b_as_a"), F.sum("n").alias("total"))
        .orderBy(F.col("total").desc(), "class_a", "class_b").limit(top)
    )


def score_steps(df: DataFrame, actual: str, score: str, positive=1, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(score, pos, neg, tp, fp): counts per distinct score and their running totals from the top.

    Grouping by score first makes the running totals work on distinct scores only.
    """
    is_pos = quoted(actual) == F.lit(positive)
    groups = (
        df.where(quoted(score).isNotNull() & quoted(actual).isNotNull())
        .groupBy(quoted(score).cast("double").alias("score"))
        .agg(F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"))
    )
    return running_totals(groups, "score", {"tp": "pos", "fp": "neg"}, descending=True, rows_per_slice=rows_per_slice)


def _areas(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Areas under the ROC and the precision-recall curve from score steps."""
    pos, neg, tp, fp = (quoted(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = steps.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        F.sum(neg * (tp - pos / 2)).alias("area"), F.sum(pos * ratio(tp, tp + fp)).alias("ap"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(
        *by, "positives", "negatives", ratio(F.col("area"), p.cast("double") * n).alias("auc"), ratio(F.col("ap"), p).alias("ap"))


def roc_auc(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """ROC AUC and average precision in percent; ties count half."""
    return _areas(score_steps(df, actual, score, positive)).select(
        "positives", "negatives", rounded(F.col("auc") * 100, 2).alias("roc_auc"), rounded(F.col("ap") * 100, 2).alias("avg_precision"))


def roc_auc_ovr(df: DataFrame, actual: str, scores: dict) -> DataFrame:
    """One-versus-rest AUC averaged by class support; ``scores`` maps classes to score columns."""
    long = df.select(quoted(actual).alias("a"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("label"), quoted(c).cast("double").alias("score")) for k, c in scores.items()
    ]))).where(F.col("score").isNotNull() & F.col("a").isNotNull())
    hit = F.col("a") == F.col("label")
    groups = long.groupBy("label", "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    steps = running_totals(groups, "score", {"tp": "pos", "fp": "neg"}, descending=True, within=("label",))
    areas = _areas(steps, ("label",))
    return areas.agg(
        rounded(ratio(F.sum(F.col("auc") * F.col("positives")), F.sum(F.when(F.col("auc").isNotNull(), F.col("positives")))) * 100, 2)
        .alias("roc_auc_ovr"), F.count("auc").alias("classes"),
    )


def _thinned(points: DataFrame, order: list[Column], about: int = 100) -> DataFrame:
    """Every k-th point of a curve, k = points // 100, numbered from 0.

    The curve is already grouped by score; numbering it needs the points in
    order once, as many as there are distinct scores.
    """
    total = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    step = F.greatest(F.lit(1), F.floor(total / about)).cast("bigint")
    return points.where(F.pmod(F.col("position"), step) == 0).orderBy(*order)


def _positioned(steps: DataFrame) -> DataFrame:
    """Number score steps from the highest score, without a whole-table window."""
    return running_totals(steps.withColumn("_one", F.lit(1).cast("bigint")), "score", {"position": "_one"},
                          descending=True).drop("_one")


def roc_curve(df: DataFrame, actual: str, score: str, positive=1, about: int = 100) -> DataFrame:
    """(position, fpr, tpr) from the strictest threshold on, thinned to about 100 points."""
    steps = _positioned(score_steps(df, actual, score, positive))
    ends = steps.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    curve = steps.select("position", ratio(F.col("fp"), ends["n"]).alias("fpr"), ratio(F.col("tp"), ends["p"]).alias("tpr"))
    origin = df.agg(F.count(F.lit(1))).select(
        F.lit(0).cast("bigint").alias("position"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _thinned(curve.unionByName(origin), [F.col("position")], about).select(
        "position", rounded(F.col("fpr"), 6).alias("fpr"), rounded(F.col("tpr"), 6).alias("tpr"))


def pr_curve(df: DataFrame, actual: str, score: str, positive=1, about: int = 100) -> DataFrame:
    """(position, precision, recall) from the loosest threshold on, ending at (1, 0)."""
    steps = score_steps(df, actual, score, positive)
    steps = running_totals(steps.withColumn("_one", F.lit(1).cast("bigint")), "score", {"position": "_one"})
    ends = steps.agg(F.struct(F.sum("pos").alias("p"), F.count(F.lit(1)).alias("m"))).scalar()
    curve = steps.select(
        (F.col("position") - 1).alias("position"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), ends["p"]).alias("recall"))
    last = df.agg(F.count(F.lit(1))).select(ends["m"].alias("position"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _thinned(curve.unionByName(last), [F.col("position")], about).select(
        "position", rounded(F.col("precision"), 6).alias("precision"), rounded(F.col("recall"), 6).alias("recall"))


def log_loss(df: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """Mean negative log likelihood of the actual class."""
    return df.agg(rounded(F.avg(_loss(quoted(actual) == F.lit(positive), quoted(score).cast("double"))), 4).alias("log_loss"))


def _loss(is_positive: Column, p: Column) -> Column:
    low, high = F.lit(SMALLEST_PROBABILITY), F.lit(1 - SMALLEST_PROBABILITY)
    p = F.when(p < low, low).when(p > high, high).otherwise(p)
    return F.when(is_positive, -F.log(p)).otherwise(-F.log(1 - p))


def _pairs(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*by, quoted(actual).cast("double").alias("y"), quoted(predicted).cast("double").alias("p")).where(
        F.col("y").isNotNull() & F.col("p").isNotNull()
    ).withColumn("e", F.col("y") - F.col("p"))


def _regression_sums() -> list[Column]:
    e, y = F.col("e"), F.col("y")
    return [
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"),
        F.sum(F.abs(e)).alias("sae"), F.max(F.abs(e)).alias("max_error"),
        F.avg(F.when(y != 0, F.abs(F.try_divide(e, y)))).alias("mape"),
    ]


def _regression_cells() -> dict[str, Column]:
    n = F.col("n").cast("double")
    r2 = 1 - F.try_divide(F.col("sse"), F.col("vy") * n)
    return {
        "r2_score": rounded(r2, 4), "adjusted_r2": rounded(1 - F.try_divide((1 - r2) * (n - 1), n - 2), 4),
        "explained_variance": rounded(1 - F.try_divide(F.col("ve"), F.col("vy")), 4),
        "mse": rounded(ratio(F.col("sse"), n), 4), "rmse": rounded(F.sqrt(ratio(F.col("sse"), n)), 4),
        "mae": rounded(ratio(F.col("sae"), n), 4), "max_error": rounded(F.col("max_error"), 4),
        "mape": rounded(F.col("mape") * 100, 2),
    }


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """R2 and its variants, squared, absolute, median and relative errors."""
    pairs = _pairs(df, actual, predicted)
    row = pairs.agg(*_regression_sums(), *quantile_exprs(pairs, [Quantile("med", F.abs("e"), 0.5)]))
    return row.select(F.col("n").alias("n_samples"), *[v.alias(k) for k, v in _regression_cells().items()],
                      rounded(F.col("med"), 4).alias("median_ae"))


ERROR_PERCENTILES = (50, 75, 90, 95, 99)


def residual_analysis(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Moments of the residuals, percentiles of their size, ranges of both sides."""
    pairs = _pairs(df, actual, predicted)
    wanted = [Quantile("median", F.col("e"), 0.5)] + [Quantile(f"p{p}", F.abs("e"), p / 100) for p in ERROR_PERCENTILES]
    sides = [fn(c).alias(f"{name}_{k}") for name, c in (("actual", "y"), ("predicted", "p"))
             for k, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.min("e").alias("min"),
        F.max("e").alias("max"), F.skewness("e").alias("g1"), F.kurtosis("e").alias("g2"), *sides, *quantile_exprs(pairs, wanted))
    named = [f"{name}_{k}" for name in ("actual", "predicted") for k in ("mean", "std", "min", "max")]
    return row.select(
        *[rounded(quoted(c), 4).alias(c) for c in ("mean", "std", "min", "max", "median")],
        rounded(adjusted_skewness(F.col("n"), F.col("g1")), 4).alias("skewness"),
        rounded(adjusted_kurtosis(F.col("n"), F.col("g2")), 4).alias("kurtosis"),
        *[rounded(F.col(f"p{p}"), 4).alias(f"p{p}") for p in ERROR_PERCENTILES],
        *[rounded(quoted(c), 4).alias(c) for c in named],
    )


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 30) -> DataFrame:
    return histogram(_pairs(df, actual, predicted), "e", bins)


def residual_scatter(df: DataFrame, actual: str, predicted: str, key: str, limit: int = 1000) -> DataFrame:
    """A repeatable sample of (actual, predicted, residual)."""
    points = scatter(df, actual, predicted, key, limit)
    return points.select(F.col("x").alias("actual"), F.col("y").alias("predicted"), (F.col("x") - F.col("y")).alias("residual"))


def vision_metrics(df: DataFrame, actual: str, predicted: str, iou: str | None = None, confidence: str | None = None) -> DataFrame:
    """Classification measures plus overlap and confidence figures."""
    out = classification_metrics(df, actual, predicted)
    extra, cells, wanted = [], [], []
    if iou:
        v = quoted(iou).cast("double")
        wanted.append(Quantile("mi", v, 0.5))
        extra += [F.avg(v).alias("ai"), F.stddev_pop(v).alias("si"), F.avg((v > 0.5).cast("double")).alias("o5"),
                  F.avg((v > 0.75).cast("double")).alias("o7")]
        cells += [("mean_iou", rounded(F.col("ai"), 4)), ("median_iou", rounded(F.col("mi"), 4)), ("std_iou", rounded(F.col("si"), 4)),
                  ("iou_above_50", rounded(F.col("o5") * 100, 2)), ("iou_above_75", rounded(F.col("o7") * 100, 2))]
    if confidence:
        v = quoted(confidence).cast("double")
        wanted.append(Quantile("mc", v, 0.5))
        extra += [F.avg(v).alias("ac"), F.avg((v > 0.8).cast("double")).alias("hc")]
        cells += [("mean_confidence", rounded(F.col("ac"), 4)), ("median_confidence", rounded(F.col("mc"), 4)),
                  ("high_confidence_rate", rounded(F.col("hc") * 100, 2))]
    if not cells:
        return out
    s = df.agg(*extra, *quantile_exprs(df, wanted)).select(F.struct(*[c.alias(k) for k, c in cells])).scalar()
    return out.select("*", *[s[k].alias(k) for k, _ in cells])


def overlap_histogram(df: DataFrame, iou: str) -> DataFrame:
    return histogram(df, iou, 20, 0.0, 1.0)


def _by_model(df: DataFrame, actual: str, models: dict[str, str]) -> DataFrame:
    """(model, actual, predicted): the prediction columns below each other."""
    return df.select(quoted(actual).alias("actual"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), quoted(c).alias("predicted")) for m, c in models.items()
    ])))


def compare_models(df: DataFrame, actual: str, models: dict[str, str], classification: bool = True, scores: dict[str, str] | None = None,
                   positive=1, in_memory: int | None = None) -> DataFrame:
    """The measures of several prediction columns against one actual column.

    ``scores`` names the probability columns of the models that have one; the others' AUC and log loss are null.
    Median errors are exact quantiles of all models in one run.
    """
    long = _by_model(df, actual, models)
    if classification:
        measured = classification_metrics(long, "actual", "predicted", ("model",))
        return measured.join(model_scores(df, actual, scores, positive).drop("positives", "negatives"), "model", "left") if scores else measured
    pairs = _pairs(long, "actual", "predicted", ("model",))
    middle = grouped_quantiles(pairs, ["model"], [Quantile("med", F.abs("e"), 0.5)], in_memory)
    return pairs.groupBy("model").agg(*_regression_sums()).join(middle, "model").select(
        "model", F.col("n").alias("n_samples"), *[v.alias(k) for k, v in _regression_cells().items()], rounded(F.col("med"), 4).alias("median_ae"))


def model_scores(df: DataFrame, actual: str, scores: dict[str, str], positive=1, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """(model, positives, negatives, roc_auc, avg_precision, log_loss) of several probability columns.

    The distinct scores of all models are put in order together, each model with totals of its own.
    """
    rows = df.select((quoted(actual) == F.lit(positive)).alias("hit"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), quoted(c).cast("double").alias("score")) for m, c in scores.items()
    ]))).where(F.col("hit").isNotNull() & F.col("score").isNotNull())
    groups = rows.groupBy("model", "score").agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    steps = running_totals(groups, "score", {"tp": "pos", "fp": "neg"}, descending=True, within=("model",), rows_per_slice=rows_per_slice)
    # the losses of equal scores are equal, so the grouped scores have them too
    hit, miss = F.col("pos") * _loss(F.lit(True), F.col("score")), F.col("neg") * _loss(F.lit(False), F.col("score"))
    losses = groups.groupBy("model").agg(ratio(F.sum(hit + miss), F.sum(F.col("pos") + F.col("neg"))).alias("loss"))
    return _areas(steps, ("model",)).join(losses, "model").select(
        "model", "positives", "negatives", rounded(F.col("auc") * 100, 2).alias("roc_auc"), rounded(F.col("ap") * 100, 2).alias("avg_precision"),
        rounded(F.col("loss"), 4).alias("log_loss"))


def rank_models(metrics: DataFrame, classification: bool = True) -> DataFrame:
    """(metric, rank, model, score): models ordered per measure, best first."""
    ranking = CLASS_RANKING if classification else VALUE_RANKING
    long = metrics.select("model", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), quoted(m).alias("score"), (quoted(m) if more else -quoted(m)).alias("_key"))
        for m, more in ranking
    ])))
    order = Window.partitionBy("metric").orderBy(F.col("_key").desc(), "model")
    return long.select("metric", F.row_number().over(order).alias("rank"), "model", "score")


def best_model(metrics: DataFrame, classification: bool = True) -> DataFrame:
    """The model with the highest macro F1, or R2."""
    key = "f1_macro" if classification else "r2_score"
    return metrics.orderBy(quoted(key).desc(), "model").limit(1).select(F.col("model").alias("best_model"), quoted(key).alias("score"))
