"""Class areas, transitions, accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom import config as cfg
from rasterloom.catalog.base import classes, classified, query, rd, read, rounded, rq
from rasterloom.operators import accuracy as ac, change as ch

CLASS_ROWS = "(SELECT CAST(unnest(range(4)) AS INT) AS class)"
NAMES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in cfg.CLASS_NAMES.items())


@query("class_area", f"""
, y AS (SELECT DISTINCT "year" FROM classified), n AS (SELECT "year", class, count(*) AS n FROM classified GROUP BY 1, 2),
 t AS (SELECT "year", count(*) AS total FROM classified GROUP BY 1)
SELECT y."year", c.class, coalesce(n.n, 0) AS n, t.total AS total_pixels, {rq('coalesce(n.n, 0) * 0.01::DOUBLE')} AS area_ha,
  {rq('100.0::DOUBLE * coalesce(n.n, 0) / t.total')} AS area_pct
FROM y CROSS JOIN {CLASS_ROWS} c JOIN t ON y."year" = t."year" LEFT JOIN n ON n."year" = y."year" AND n.class = c.class""", needs=("classified",))
def class_area(spark, d):
    return rounded(ch.class_area_table(classified(spark, d)), "area_ha", "area_pct")


_HA = "(0.01::DOUBLE + (\"row\" % 7) * 0.0001::DOUBLE)"


def _with_area(df):
    return df.withColumn("ha", 0.01 + (F.col("row") % 7) * 0.0001)


@query("class_true_area", f"""SELECT "year", class, {rq(f'sum({_HA})')} AS area_ha FROM classified GROUP BY 1, 2""", needs=("classified",))
def class_true_area(spark, d):
    return rounded(ch.area_by_class(_with_area(classified(spark, d)), "ha"), "area_ha")


@query("built_up_area", f"""SELECT "year", {rq(f'sum(CASE WHEN class = 3 THEN {_HA} ELSE 0 END)')} AS area_ha FROM classified GROUP BY 1""", needs=("classified",))
def built_up_area(spark, d):
    return rounded(ch.area_of_class(_with_area(classified(spark, d)), "ha", cfg.BUILT_UP), "area_ha")


_MATRIX = f""", s AS (SELECT a.class AS f, b.class AS t, sum(0.01::DOUBLE) AS ha FROM classes1 a JOIN classes2 b ON a."row" = b."row" AND a.col = b.col GROUP BY 1, 2),
 m AS (SELECT i.class AS from_class, j.class AS to_class, coalesce(s.ha, 0.0) AS ha FROM {CLASS_ROWS} i CROSS JOIN {CLASS_ROWS} j
       LEFT JOIN s ON s.f = i.class AND s.t = j.class)"""


def _matrix(spark, d):
    return ch.transition_matrix(classes(spark, d, 1), classes(spark, d, 2))


@query("transition_matrix", _MATRIX + f"SELECT from_class, to_class, {rq('ha')} AS ha FROM m", needs=("classes1", "classes2"))
def transition_matrix(spark, d):
    return rounded(_matrix(spark, d), "ha")


@query("transition_pivot", _MATRIX + f"""SELECT from_class, {', '.join(f'CASE WHEN round(sum(CASE WHEN to_class = {c} THEN ha END), 6) = 0 THEN 0.0 ELSE round(sum(CASE WHEN to_class = {c} THEN ha END), 6) END AS to_{c}' for c in range(4))}
FROM m GROUP BY 1""", needs=("classes1", "classes2"))
def transition_pivot(spark, d):
    wide = ch.transition_pivot(_matrix(spark, d))
    return wide.select("from_class", *[rd(F.col(str(c))).alias(f"to_{c}") for c in range(4)])


@query("transition_summary", _MATRIX + f"""SELECT {rq('sum(ha)')} AS total_ha, {rq('sum(CASE WHEN from_class = to_class THEN ha ELSE 0 END)')} AS unchanged_ha,
 {rq('sum(CASE WHEN from_class <> to_class THEN ha ELSE 0 END)')} AS changed_ha,
 {rq('100.0::DOUBLE * sum(CASE WHEN from_class <> to_class THEN ha ELSE 0 END) / sum(ha)')} AS changed_pct FROM m""", needs=("classes1", "classes2"))
def transition_summary(spark, d):
    return rounded(ch.transition_summary(_matrix(spark, d)), "total_ha", "unchanged_ha", "changed_ha", "changed_pct")


@query("transition_flows", _MATRIX + f"""SELECT (CASE from_class {NAMES} END) || ' → ' || (CASE to_class {NAMES} END) AS flow, {rq('ha')} AS ha,
 {rq('100.0::DOUBLE * ha / (SELECT sum(ha) FROM m)')} AS pct FROM m WHERE from_class <> to_class AND ha >= 5 ORDER BY ha DESC, flow LIMIT 6""", needs=("classes1", "classes2"))
def transition_flows(spark, d):
    return rounded(ch.transition_flows(_matrix(spark, d), min_ha=5.0, top=6), "ha", "pct")


@query("transition_totals", _MATRIX + f"""SELECT coalesce(from_class, -1) AS from_class, coalesce(to_class, -1) AS to_class, {rq('sum(ha)')} AS ha FROM m GROUP BY CUBE (from_class, to_class)""", needs=("classes1", "classes2"))
def transition_totals(spark, d):
    return rounded(ch.transition_totals(_matrix(spark, d)), "ha")


@query("gain_loss", _MATRIX + f"""SELECT {rq('sum(CASE WHEN from_class <> 3 AND to_class = 3 THEN ha ELSE 0 END)')} AS gain_ha,
 {rq('sum(CASE WHEN from_class = 3 AND to_class <> 3 THEN ha ELSE 0 END)')} AS loss_ha, {rq('sum(CASE WHEN from_class = 3 THEN ha ELSE 0 END)')} AS before_ha,
 {rq('sum(CASE WHEN from_class <> 3 AND to_class = 3 THEN ha ELSE 0 END) - sum(CASE WHEN from_class = 3 AND to_class <> 3 THEN ha ELSE 0 END)')} AS net_ha,
 {rq('100.0::DOUBLE * sum(CASE WHEN from_class = 3 AND to_class <> 3 THEN ha ELSE 0 END) / sum(CASE WHEN from_class = 3 THEN ha ELSE 0 END)')} AS unstable_pct FROM m""", needs=("classes1", "classes2"))
def gain_loss(spark, d):
    return rounded(ch.gain_loss(_matrix(spark, d)), "gain_ha", "loss_ha", "before_ha", "net_ha", "unstable_pct")


@query("pair_codes", """SELECT CAST(a.class * 10 + b.class AS INT) AS code, CAST(floor((a.class * 10 + b.class) / 10) AS INT) AS from_class,
 CAST((a.class * 10 + b.class) % 10 AS INT) AS to_class, count(*) AS n FROM classes1 a JOIN classes2 b ON a."row" = b."row" AND a.col = b.col GROUP BY 1, 2, 3""", needs=("classes1", "classes2"))
def pair_codes(spark, d):
    both = classes(spark, d, 1).join(classes(spark, d, 2).withColumnRenamed("class", "c1"), ["row", "col"])
    coded = both.groupBy(ch.encode_pair(F.col("class"), F.col("c1")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    i, j = ch.decode_pair(F.col("code"))
    return coded.withColumns({"from_class": i, "to_class": j})


_CM = """, cm AS (SELECT a.class AS ref, b.class AS pred, count(*) AS n FROM classes1 a JOIN classes2 b ON a."row" = b."row" AND a.col = b.col GROUP BY 1, 2)"""


def _cm(spark, d):
    """Two class maps as reference and prediction."""
    pred = classes(spark, d, 2).select("row", "col", F.col("class").alias("pred"))
    both = classes(spark, d, 1).select("row", "col", F.col("class").alias("ref")).join(pred, ["row", "col"])
    return ac.confusion_matrix(both)


def _weights(spark, d):
    """Class shares of the first map."""
    return classes(spark, d, 1).groupBy("class").agg(F.count(F.lit(1)).cast("double").alias("w"))


_W = ", w AS (SELECT class, count(*) / (SELECT count(*) FROM classes1)::DOUBLE AS w FROM classes1 GROUP BY 1)"
_R = """, r AS (SELECT cm.ref, cm.pred, cm.n, t.n_i, w.w, cm.n / t.n_i::DOUBLE AS cond, cm.n / t.n_i::DOUBLE * w.w AS p FROM cm
   JOIN (SELECT ref, CAST(sum(n) AS BIGINT) AS n_i FROM cm GROUP BY 1) t ON cm.ref = t.ref JOIN w ON w.class = cm.ref)"""


@query("confusion_matrix", _CM + "SELECT ref, pred, n FROM cm", needs=("classes1", "classes2"))
def confusion_matrix(spark, d):
    return _cm(spark, d)


@query("label_confusion", "SELECT quality AS ref, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2")
def label_confusion(spark, d):
    return ac.confusion_matrix(read(spark, d, "labels"), "quality", "toxic")


_OA = """SELECT CAST(sum(n_ref) AS BIGINT) AS n, {oa} AS oa, {kappa} AS kappa FROM (
 SELECT k.class, coalesce(a.n, 0) AS n_ref, coalesce(b.n, 0) AS n_pred, coalesce(c.n, 0) AS hit FROM (SELECT ref AS class FROM cm UNION SELECT pred FROM cm) k
 LEFT JOIN (SELECT ref, sum(n) AS n FROM cm GROUP BY 1) a ON a.ref = k.class LEFT JOIN (SELECT pred, sum(n) AS n FROM cm GROUP BY 1) b ON b.pred = k.class
 LEFT JOIN (SELECT ref, n FROM cm WHERE ref = pred) c ON c.ref = k.class)""".format(
    oa=rq("sum(hit) / sum(n_ref)"),
    kappa=rq("(sum(hit) / sum(n_ref) - sum(n_ref * n_pred) / (sum(n_ref) * sum(n_ref))) / (1 - sum(n_ref * n_pred) / (sum(n_ref) * sum(n_ref)))"),
)


@query("oa_kappa", _CM + _OA, needs=("classes1", "classes2"))
def oa_kappa(spark, d):
    return rounded(ac.overall_accuracy(_cm(spark, d)), "oa", "kappa")


@query("pa_ua", _CM + f"""SELECT k.class, CAST(coalesce(a.n, 0) AS BIGINT) AS n_ref, CAST(coalesce(b.n, 0) AS BIGINT) AS n_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
 {rq('coalesce(coalesce(c.n, 0) / nullif(coalesce(a.n, 0), 0), 0)')} AS producers_accuracy, {rq('coalesce(coalesce(c.n, 0) / nullif(coalesce(b.n, 0), 0), 0)')} AS consumers_accuracy
 FROM (SELECT ref AS class FROM cm UNION SELECT pred FROM cm) k LEFT JOIN (SELECT ref, sum(n) AS n FROM cm GROUP BY 1) a ON a.ref = k.class
 LEFT JOIN (SELECT pred, sum(n) AS n FROM cm GROUP BY 1) b ON b.pred = k.class LEFT JOIN (SELECT ref, n FROM cm WHERE ref = pred) c ON c.ref = k.class""", needs=("classes1", "classes2"))
def pa_ua(spark, d):
    return rounded(ac.class_accuracy(_cm(spark, d)), "producers_accuracy", "consumers_accuracy")


_V = "sqrt(sum(CASE WHEN ref = pred AND n_i > 1 THEN w * w * cond * (1 - cond) / (n_i - 1) ELSE 0 END))"
_OAW = "sum(CASE WHEN ref = pred THEN p ELSE 0 END)"


@query("area_weighted_accuracy", _CM + _W + _R + f"""SELECT {rq('sum(CASE WHEN ref = pred THEN n ELSE 0 END) / sum(n)')} AS oa_simple, {rq(_OAW)} AS oa_weighted, {rq(_V)} AS se,
 {rq(f'1.96::DOUBLE * {_V}')} AS margin95, {rq(f'{_OAW} - 1.96::DOUBLE * {_V}')} AS ci95_low, {rq(f'{_OAW} + 1.96::DOUBLE * {_V}')} AS ci95_high FROM r""", needs=("classes1", "classes2"))
def area_weighted_accuracy(spark, d):
    out = ac.area_weighted_accuracy(_cm(spark, d), _weights(spark, d))
    return rounded(out, *out.columns)


@query("area_weighted_classes", _CM + _W + _R + f"""SELECT a.class, {rq('a.hit / a.weight')} AS producer_weighted, {rq('coalesce(a.hit / b.est, 0)')} AS user_weighted,
 {rq('coalesce(b.est, 0)')} AS estimated_proportion, {rq('a.weight')} AS weight, a.n_ref FROM
 (SELECT ref AS class, sum(CASE WHEN ref = pred THEN p ELSE 0 END) AS hit, any_value(w) AS weight, any_value(n_i) AS n_ref FROM r GROUP BY 1) a
 LEFT JOIN (SELECT pred, sum(p) AS est FROM r GROUP BY 1) b ON a.class = b.pred""", needs=("classes1", "classes2"))
def area_weighted_classes(spark, d):
    out = ac.area_weighted_classes(_cm(spark, d), _weights(spark, d))
    return rounded(out, "producer_weighted", "user_weighted", "estimated_proportion", "weight")


_TOTAL = "(SELECT count(*) * 0.01::DOUBLE FROM classes1)"
_CI = """, e AS (SELECT coalesce(sum(p), 0) AS ph, sqrt(coalesce(sum(w * w * cond * (1 - cond) / (n_i - 1)), 0)) AS se FROM r WHERE pred = 3 AND n_i > 1)"""


@query("class_area_ci", _CM + _W + _R + _CI + f"""SELECT CAST(3 AS INT) AS class, {rq('ph')} AS p_hat, {rq('se')} AS se, {rq('100 * 1.96::DOUBLE * se')} AS margin95_points,
 {rq(f'1.96::DOUBLE * se * {_TOTAL}')} AS margin95_ha, {rq('100 * (ph - 1.96::DOUBLE * se)')} AS ci95_low_pct, {rq('100 * (ph + 1.96::DOUBLE * se)')} AS ci95_high_pct,
 {rq(f'(ph - 1.96::DOUBLE * se) * {_TOTAL}')} AS ci95_low_ha, {rq(f'(ph + 1.96::DOUBLE * se) * {_TOTAL}')} AS ci95_high_ha FROM e""", needs=("classes1", "classes2"))
def class_area_ci(spark, d):
    total = classes(spark, d, 1).count() * cfg.PIXEL_AREA_HA
    out = ac.class_area_confidence(_cm(spark, d), _weights(spark, d), total)
    return rounded(out, *[c for c in out.columns if c != "class"])


@query("change_significance", f""", a AS (SELECT CAST(year(o_orderdate) AS INT) AS "year", sum(o_totalprice) / 1000000.0::DOUBLE AS ha FROM orders GROUP BY 1),
 s AS (SELECT "year", lag("year") OVER (ORDER BY "year") AS p, ha - lag(ha) OVER (ORDER BY "year") AS delta FROM a)
SELECT p || ' → ' || "year" AS period, {rq('delta', 4)} AS delta_ha, {rq('20.0::DOUBLE * sqrt(2.0::DOUBLE)')} AS margin_diff_ha,
 {rq('abs(delta) / (20.0::DOUBLE * sqrt(2.0::DOUBLE))', 4)} AS ratio, abs(delta) > 20.0::DOUBLE * sqrt(2.0::DOUBLE) AS significant FROM s WHERE p IS NOT NULL""")
def change_significance(spark, d):
    area = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg((F.sum("o_totalprice") / 1e6).alias("ha"))
    return rounded(rounded(ch.change_significance(area, 20.0), "delta_ha", "ratio", digits=4), "margin_diff_ha")
