"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as e
from ledgerlens.operators import filters as f
from workload.charts import histogram_sql
from workload.common import cte, div, r, table, view


def binary(s, d):
    return view(s, d, "pred_binary")


def multi(s, d):
    return view(s, d, "pred_multi")


def reg(s, d):
    return view(s, d, "pred_reg")


def scored(s, d):
    cols = [F.col("embedding")[k].cast("double").alias(f"s{k}") for k in range(10)]
    return table(s, d, "embeddings").select("label", *cols)


def rivals(s, d):
    return multi(s, d).withColumn("naive", F.lit(3)).withColumn("other", F.expr("if(vec_id % 7 = 0, 0, actual)"))


def price_models(s, d):
    return reg(s, d).withColumn("flat", F.lit(30000.0)).withColumn("close", F.col("actual") * 0.9 + 1000)


def graded(s, d):
    """Two models with probabilities and one without."""
    return binary(s, d).withColumn("steady", F.lit(1)).withColumn("long", F.expr("least(1.0d, probability * 1.1)")).withColumn(
        "late", F.expr("CAST(doc_id % 10 >= 3 AS INT)")).withColumn("chance", F.expr("CAST(doc_id % 10 AS DOUBLE) / 10"))


GRADES, CHANCES = {"length": "predicted", "late": "late", "steady": "steady"}, {"length": "long", "late": "chance"}
RIVALS = {"main": "predicted", "naive": "naive", "other": "other"}
PRICES = {"main": "predicted", "flat": "flat", "close": "close"}

QUERIES = {
    "detect_roles": lambda s, d: e.detect_roles(binary(s, d)),
    "detect_task": lambda s, d: e.detect_task(binary(s, d), "actual"),
    "detect_task_multi": lambda s, d: e.detect_task(multi(s, d), "actual"),
    "detect_task_reg": lambda s, d: e.detect_task(reg(s, d), "actual"),
    "vision_check": lambda s, d: e.vision_check(table(s, d, "pages").withColumn("shot", F.concat("url", F.lit(".png")))),
    "confusion_matrix": lambda s, d: e.confusion_matrix(multi(s, d), "actual", "predicted"),
    "confusion_chart": lambda s, d: e.confusion_chart(binary(s, d), "actual", "predicted"),
    "classification_metrics": lambda s, d: e.classification_metrics(binary(s, d), "actual", "predicted"),
    "classification_metrics_multi": lambda s, d: e.classification_metrics(multi(s, d), "actual", "predicted"),
    "per_class": lambda s, d: e.per_class(multi(s, d), "actual", "predicted"),
    "class_distributions": lambda s, d: e.distributions(multi(s, d), "actual", "predicted"),
    "error_summary": lambda s, d: e.error_summary(multi(s, d), "actual", "predicted"),
    "confused_pairs": lambda s, d: e.confused_pairs(multi(s, d), "actual", "predicted"),
    "errors_only": lambda s, d: f.errors_only(multi(s, d), "predicted", "actual"),
    "roc_auc": lambda s, d: e.roc_auc(binary(s, d), "actual", "probability"),
    "roc_auc_ovr": lambda s, d: e.roc_auc_ovr(scored(s, d), "label", {k: f"s{k}" for k in range(10)}),
    "roc_curve": lambda s, d: e.roc_curve(binary(s, d), "actual", "probability"),
    "pr_curve": lambda s, d: e.pr_curve(binary(s, d), "actual", "probability"),
    "log_loss": lambda s, d: e.log_loss(binary(s, d), "actual", "probability"),
    "regression_metrics": lambda s, d: e.regression_metrics(reg(s, d), "actual", "predicted"),
    "residuals": lambda s, d: e.residual_analysis(reg(s, d), "actual", "predicted"),
    "residual_histogram": lambda s, d: e.residual_histogram(reg(s, d), "actual", "predicted"),
    "residual_scatter": lambda s, d: e.residual_scatter(reg(s, d), "actual", "predicted", "l_orderkey"),
    "cv_metrics": lambda s, d: e.vision_metrics(multi(s, d), "actual", "predicted", "iou", "iou"),
    "iou_histogram": lambda s, d: e.overlap_histogram(multi(s, d), "iou"),
    "compare_models": lambda s, d: e.compare_models(rivals(s, d), "actual", RIVALS),
    "compare_regressors": lambda s, d: e.compare_models(price_models(s, d), "actual", PRICES, False),
    # narrowed: groups of over 1,000 rows do not use the built-in aggregate
    "compare_regressors_narrowed": lambda s, d: e.compare_models(price_models(s, d), "actual", PRICES, False, in_memory=1000),
    "compare_probabilities": lambda s, d: e.compare_models(graded(s, d), "actual", GRADES, scores=CHANCES),
    "rank_models": lambda s, d: e.rank_models(e.compare_models(rivals(s, d), "actual", RIVALS)),
    "rank_regressors": lambda s, d: e.rank_models(e.compare_models(price_models(s, d), "actual", PRICES, False), False),
    "best_model": lambda s, d: e.best_model(e.compare_models(rivals(s, d), "actual", RIVALS)),
}

B, M, R = cte("pred_binary"), cte("pred_multi"), cte("pred_reg")


def classes(tab: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""k AS (SELECT {g}label, sum(tp) AS tp, sum(s) AS s, sum(q) AS q FROM (
SELECT {g}actual AS label, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS tp, 1 AS s, 0 AS q FROM {tab} UNION ALL SELECT {g}predicted, 0, 0, 1 FROM {tab}) GROUP BY ALL),
m AS (SELECT *, coalesce({div('tp', 'q')}, 0) AS p, coalesce({div('tp', 's')}, 0) AS r, coalesce({div('2 * tp', '(s + q)')}, 0) AS f FROM k)
"""


def pct(x: str) -> str:
    return r(f"({x}) * 100", 2)


N = "CAST(sum(s) AS DOUBLE)"
OVERALL = f"""CAST(sum(s) AS BIGINT) AS n_samples, count(*) AS n_classes, {pct(f'sum(tp) / {N}')} AS accuracy, {pct('avg(CASE WHEN s > 0 THEN r END)')} AS balanced_accuracy,
{pct('avg(p)')} AS precision_macro, {pct(f'sum(p * s) / {N}')} AS precision_weighted, {pct('avg(r)')} AS recall_macro, {pct(f'sum(r * s) / {N}')} AS recall_weighted,
{pct('avg(f)')} AS f1_macro, {pct(f'sum(f * s) / {N}')} AS f1_weighted,
{r(f"coalesce((sum(tp) * {N} - sum(CAST(s AS DOUBLE) * q)) / nullif(sqrt(({N} * {N} - sum(CAST(q AS DOUBLE) * q)) * ({N} * {N} - sum(CAST(s AS DOUBLE) * s))), 0), 0)", 4)} AS matthews_corrcoef,
{r(f"(sum(tp) / {N} - sum(CAST(s AS DOUBLE) * q) / ({N} * {N})) / nullif(1 - sum(CAST(s AS DOUBLE) * q) / ({N} * {N}), 0)", 4)} AS cohen_kappa"""

RIVAL_ROWS = """v AS (SELECT 'main' AS model, actual, predicted FROM pred_multi UNION ALL SELECT 'naive', actual, 3 FROM pred_multi
UNION ALL SELECT 'other', actual, CASE WHEN vec_id % 7 = 0 THEN 0 ELSE actual END FROM pred_multi),
"""
STEPS = """, g AS (SELECT probability AS score, sum(CASE WHEN actual = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN actual = 1 THEN 0 ELSE 1 END) AS neg FROM pred_binary GROUP BY 1),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS pd, row_number() OVER (ORDER BY score) AS pa,
sum(pos) OVER () AS p, sum(neg) OVER () AS n, count(*) OVER () AS m FROM g WINDOW w AS (ORDER BY score DESC))
"""
ERR = ", v AS (SELECT actual AS y, predicted AS p, actual - predicted AS e FROM pred_reg WHERE actual IS NOT NULL AND predicted IS NOT NULL)\n"


def _reg_cells() -> str:
    r2 = "(1 - sum(e * e) / nullif(var_pop(y) * count(*), 0))"
    return f"""count(*) AS n_samples, {r(r2, 4)} AS r2_score, {r(f'1 - (1 - {r2}) * (count(*) - 1) / (count(*) - 2)', 4)} AS adjusted_r2,
{r('1 - var_pop(e) / nullif(var_pop(y), 0)', 4)} AS explained_variance, {r('sum(e * e) / count(*)', 4)} AS mse, {r('sqrt(sum(e * e) / count(*))', 4)} AS rmse,
{r('sum(abs(e)) / count(*)', 4)} AS mae, {r('max(abs(e))', 4)} AS max_error, {r('avg(CASE WHEN y <> 0 THEN abs(e / y) END) * 100', 2)} AS mape"""


PRICE_ROWS = """, v AS (SELECT 'main' AS model, actual AS y, actual - predicted AS e FROM pred_reg UNION ALL SELECT 'flat', actual, actual - 30000.0 FROM pred_reg
UNION ALL SELECT 'close', actual, actual - (actual * 0.9 + 1000) FROM pred_reg)
"""


COMPARED = f"SELECT model, {_reg_cells()}, {r('median(abs(e))', 4)} AS median_ae FROM v GROUP BY model"
GRADE_ROWS = """v AS (SELECT 'length' AS model, actual, predicted FROM pred_binary UNION ALL SELECT 'late', actual, CAST(doc_id % 10 >= 3 AS INT) FROM pred_binary
UNION ALL SELECT 'steady', actual, 1 FROM pred_binary),
"""
LOSS = "sum(CASE WHEN actual = 1 THEN -ln(greatest(score, 2.220446049250313e-16)) ELSE -ln(1 - least(score, 1 - 2.220446049250313e-16)) END)"
CHANCE_ROWS = f""", z AS (SELECT 'length' AS model, actual, least(CAST(1 AS DOUBLE), probability * 1.1) AS score FROM pred_binary
UNION ALL SELECT 'late', actual, CAST(doc_id % 10 AS DOUBLE) / 10 FROM pred_binary),
g AS (SELECT model, score, sum(CASE WHEN actual = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN actual = 1 THEN 0 ELSE 1 END) AS neg, {LOSS} AS loss FROM z GROUP BY 1, 2),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
x AS (SELECT model, {pct(div('sum(neg * (tp - pos / 2.0))', 'sum(pos) * sum(neg)'))} AS roc_auc, {pct(div(f"sum(pos * {div('tp', '(tp + fp)')})", 'sum(pos)'))} AS avg_precision,
{r('sum(loss) / sum(pos + neg)', 4)} AS log_loss FROM t GROUP BY model)
"""


def ranks(metrics, inner: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(row_number() OVER (ORDER BY {m} {'DESC' if more else 'ASC'}, model) AS INT) AS rank, model, {m} AS score FROM {inner}"
        for m, more in metrics)


RIVAL_METRICS = f"(SELECT model, {OVERALL} FROM m GROUP BY model)"
OVR = "\nUNION ALL ".join(
    f"SELECT {k} AS label, CAST(embedding[{k + 1}] AS DOUBLE) AS score, label = {k} AS hit FROM embeddings" for k in range(10))

ORACLES = {
    "detect_roles": B + "\nUNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS ordinal, '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS \"distinct\", '{role}' AS role FROM pred_binary"
        for i, (c, t, role) in enumerate((("doc_id", "bigint", "id"), ("actual", "int", "actual"), ("predicted", "int", "predicted"), ("probability", "double", "probability")))),
    "detect_task": B + "SELECT count(*) AS rows, count(DISTINCT actual) AS \"distinct\", 'binary_classification' AS task_type FROM pred_binary",
    "detect_task_multi": M + "SELECT count(*) AS rows, count(DISTINCT actual) AS \"distinct\", 'multiclass_classification' AS task_type FROM pred_multi",
    "detect_task_reg": R + "SELECT count(*) AS rows, count(DISTINCT actual) AS \"distinct\", 'regression' AS task_type FROM pred_reg",
    "vision_check": """SELECT bool_or(s) AS is_vision, CAST(0 AS INT) AS box_hits, CASE WHEN bool_or(s) THEN 'image_classification' ELSE 'none' END AS vision_type
FROM (SELECT url || '.png' LIKE '%.png' AS s FROM pages)""",
    "confusion_matrix": M + f""", l AS (SELECT actual AS v FROM pred_multi UNION SELECT predicted FROM pred_multi),
c AS (SELECT actual, predicted, count(*) AS n FROM pred_multi GROUP BY 1, 2), g AS (SELECT a.v AS actual, b.v AS predicted, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v)
SELECT actual, predicted, n AS count, {r(div('n', 'sum(n) OVER (PARTITION BY actual)'), 4)} AS normalized,
CASE WHEN actual = predicted THEN CASE WHEN n > 0 THEN 'true_positive' ELSE 'true_negative' END WHEN n > 0 THEN 'false_positive' ELSE 'correct_rejection' END AS type FROM g""",
    "confusion_chart": B + """, l AS (SELECT DISTINCT actual AS v FROM pred_binary), c AS (SELECT actual, predicted, count(*) AS n FROM pred_binary GROUP BY 1, 2)
SELECT CAST(b.v AS VARCHAR) AS x, CAST(a.v AS VARCHAR) AS y, coalesce(n, 0) AS value FROM l a CROSS JOIN l b LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v""",
    "classification_metrics": B.rstrip() + ",\n" + classes("pred_binary") + f"SELECT {OVERALL} FROM m",
    "classification_metrics_multi": M.rstrip() + ",\n" + classes("pred_multi") + f"SELECT {OVERALL} FROM m",
    "per_class": M.rstrip() + ",\n" + classes("pred_multi") + f"SELECT label, {pct('p')} AS precision, {pct('r')} AS recall, {pct('f')} AS f1_score, CAST(s AS BIGINT) AS support FROM m",
    "class_distributions": M.rstrip() + ",\n" + classes("pred_multi") + f"SELECT label, CAST(s AS BIGINT) AS actual_count, {pct(div('s', 'sum(s) OVER ()'))} AS actual_pct, CAST(q AS BIGINT) AS predicted_count FROM m",
    "error_summary": M + f"SELECT count(CASE WHEN actual <> predicted THEN 1 END) AS total_errors, {pct(div('count(CASE WHEN actual <> predicted THEN 1 END)', 'count(*)'))} AS error_rate FROM pred_multi",
    "confused_pairs": M + """SELECT least(actual, predicted) AS class_a, greatest(actual, predicted) AS class_b, count(CASE WHEN actual < predicted THEN 1 END) AS a_as_b,
count(CASE WHEN actual > predicted THEN 1 END) AS b_as_a, count(*) AS total FROM pred_multi WHERE actual <> predicted AND predicted IN (SELECT actual FROM pred_multi)
GROUP BY 1, 2 ORDER BY 5 DESC, 1, 2 LIMIT 5""",
    "errors_only": M + "SELECT * FROM pred_multi WHERE predicted <> actual",
    "roc_auc": B.rstrip() + STEPS + f"""SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, {pct(div('sum(neg * (tp - pos / 2.0))', 'sum(pos) * sum(neg)'))} AS roc_auc,
{pct(div(f"sum(pos * {div('tp', '(tp + fp)')})", 'sum(pos)'))} AS avg_precision FROM t""",
    "roc_auc_ovr": f"""WITH e AS ({OVR}), g AS (SELECT label, score, count(CASE WHEN hit THEN 1 END) AS pos, count(CASE WHEN NOT hit THEN 1 END) AS neg FROM e GROUP BY 1, 2),
t AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tp FROM g), a AS (SELECT label, sum(pos) AS p, {div('sum(neg * (tp - pos / 2.0))', 'sum(pos) * sum(neg)')} AS auc FROM t GROUP BY 1)
SELECT {pct('sum(auc * p) / sum(CASE WHEN auc IS NOT NULL THEN p END)')} AS roc_auc_ovr, count(auc) AS classes FROM a""",
    "roc_curve": B.rstrip() + STEPS + f"""SELECT position, {r('fpr', 6)} AS fpr, {r('tpr', 6)} AS tpr FROM (SELECT pd AS position, {div('fp', 'n')} AS fpr, {div('tp', 'p')} AS tpr FROM t UNION ALL SELECT 0, 0, 0)
WHERE position % greatest(1, (SELECT count(*) + 1 FROM t) // 100) = 0""",
    "pr_curve": B.rstrip() + STEPS + f"""SELECT position, {r('pr', 6)} AS precision, {r('rc', 6)} AS recall FROM (SELECT pa - 1 AS position, {div('tp', '(tp + fp)')} AS pr, {div('tp', 'p')} AS rc FROM t
UNION ALL SELECT (SELECT count(*) FROM t), 1, 0) WHERE position % greatest(1, (SELECT count(*) + 1 FROM t) // 100) = 0""",
    "log_loss": B + f"SELECT {r('avg(CASE WHEN actual = 1 THEN -ln(greatest(probability, 2.220446049250313e-16)) ELSE -ln(1 - least(probability, 1 - 2.220446049250313e-16)) END)', 4)} AS log_loss FROM pred_binary",
    "regression_metrics": R.rstrip() + ERR + f"SELECT {_reg_cells()}, {r('median(abs(e))', 4)} AS median_ae FROM v",
    "residuals": R.rstrip() + ERR + f"""SELECT {r('avg(e)', 4)} AS mean, {r('stddev_pop(e)', 4)} AS std, {r('min(e)', 4)} AS min, {r('max(e)', 4)} AS max, {r('median(e)', 4)} AS median,
{r('skewness(e)', 4)} AS skewness, {r('kurtosis(e)', 4)} AS kurtosis, """ + ", ".join(f"{r(f'quantile_cont(abs(e), {p / 100})', 4)} AS p{p}" for p in e.ERROR_PERCENTILES) + ", "
    + ", ".join(f"{r(f'{fn}({c})', 4)} AS {n}_{k}" for n, c in (("actual", "y"), ("predicted", "p")) for k, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM v",
    "residual_histogram": R.rstrip() + ERR.rstrip() + ", src AS (SELECT e AS v FROM v), e AS (SELECT min(v) AS lo, max(v) AS hi, 30 AS bins FROM src)\n" + histogram_sql(""),
    "residual_scatter": R + "SELECT actual, predicted, actual - predicted AS residual FROM pred_reg ORDER BY md5(CAST(l_orderkey AS VARCHAR)), 1, 2 LIMIT 1000",
    "cv_metrics": M.rstrip() + ",\n" + classes("pred_multi") + f"""SELECT o.*, x.* FROM (SELECT {OVERALL} FROM m) o, (SELECT {r('avg(iou)', 4)} AS mean_iou, {r('median(iou)', 4)} AS median_iou, {r('stddev_pop(iou)', 4)} AS std_iou,
{pct('avg(CASE WHEN iou > 0.5 THEN 1.0::DOUBLE ELSE 0 END)')} AS iou_above_50, {pct('avg(CASE WHEN iou > 0.75 THEN 1.0::DOUBLE ELSE 0 END)')} AS iou_above_75, {r('avg(iou)', 4)} AS mean_confidence,
{r('median(iou)', 4)} AS median_confidence, {pct('avg(CASE WHEN iou > 0.8 THEN 1.0::DOUBLE ELSE 0 END)')} AS high_confidence_rate FROM pred_multi) x""",
    "iou_histogram": M.rstrip() + ", src AS (SELECT iou AS v FROM pred_multi), e AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 20 AS bins)\n" + histogram_sql(""),
    "compare_models": M.rstrip() + ",\n" + RIVAL_ROWS + classes("v", "model") + f"SELECT model, {OVERALL} FROM m GROUP BY model",
    "compare_regressors": R.rstrip() + PRICE_ROWS + COMPARED,
    "compare_regressors_narrowed": R.rstrip() + PRICE_ROWS + COMPARED,
    "compare_probabilities": B.rstrip() + ",\n" + GRADE_ROWS + classes("v", "model").rstrip() + CHANCE_ROWS + f"""SELECT o.*, roc_auc, avg_precision, log_loss
FROM (SELECT model, {OVERALL} FROM m GROUP BY model) o LEFT JOIN x USING (model)""",
    "rank_models": M.rstrip() + ",\n" + RIVAL_ROWS + classes("v", "model").rstrip() + f", o AS {RIVAL_METRICS}\n" + ranks(e.CLASS_RANKING, "o"),
    "rank_regressors": R.rstrip() + PRICE_ROWS.rstrip() + f", o AS (SELECT model, {_reg_cells()} FROM v GROUP BY model)\n" + ranks(e.VALUE_RANKING, "o"),
    "best_model": M.rstrip() + ",\n" + RIVAL_ROWS + classes("v", "model").rstrip() + f", o AS {RIVAL_METRICS}\nSELECT model AS best_model, f1_macro AS score FROM o ORDER BY 2 DESC, 1 LIMIT 1",
}
