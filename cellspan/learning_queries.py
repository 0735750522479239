"""Queries of training tables, models, forecasts' bands, plants and the dimension of cells; see queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspan.operators import boosting, curves, datasets, forecasts, indicators, learning, quality, selection, study, trees
from cellspan.plans import cohort, economics
from cellspan.queries import BOL_SQL, EOL_SQL, FC_SQL, MONO_SQL, QUERIES, SCORE_SQL, SPEAR_SQL, SQL, forecast_log, query, r, rounded
from cellspan.sources import registry, samples
from cellspan.sources.staging import staged
from cellspan.sources.samples import E_SQL, H_SQL, L_SQL, event_cycles, health_table, lineitem_samples, table
from cellspan.streaming import windows

HT = f"{BOL_SQL}, {H_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY k) AS rn, count(*) OVER (PARTITION BY cell) AS n FROM ht WHERE NOT outlier AND soh IS NOT NULL)"
UPTO = "OVER (PARTITION BY cell ORDER BY k ROWS UNBOUNDED PRECEDING)"
WHOLE = "OVER (PARTITION BY cell)"


def rel(c: str) -> str:
    return f"{c} / nullif(avg(CASE WHEN n_{c} <= 3 THEN {c} END) {WHOLE}, 0) AS {c}"


SOH_SQL = f"""{HT}, gn AS (SELECT *, {', '.join(f'count({c}) {UPTO} AS n_{c}' for c in ('R0', 'Re_ohm', 'Rct_ohm', 'V_mean'))} FROM g),
sd AS (SELECT cell, k, {', '.join(rel(c) for c in ('R0', 'Re_ohm', 'Rct_ohm', 'V_mean'))}, T_rise, T_mean, I_mean, ambient, soh FROM gn)"""


@query("soh_dataset", f"WITH {SOH_SQL} SELECT cell, k::DOUBLE AS k, {', '.join(r(c, digits=6) for c in ('R0', 'Re_ohm', 'Rct_ohm', 'T_rise', 'T_mean'))}, NULL::DOUBLE AS cc_time_s, NULL::DOUBLE AS cv_time_s, {', '.join(r(c, digits=6) for c in ('V_mean', 'I_mean', 'ambient', 'soh'))} FROM sd")
def soh_dataset(spark, d):
    return rounded(datasets.soh_dataset(health_table(spark, d)), 6)


def kept_health(spark, d, *columns: str, rows: int | None = None) -> DataFrame:
    """The health table (or these columns of it), made once for queries that read it several times, lying by cell."""
    return samples.parted(staged(health_table(spark, d).select(*(columns or "*")), "health"), "cell", rows=rows)


def quadratic_sql(i: int) -> str:
    m = [["n", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]
    det = lambda x: f"({x[0][0]}*({x[1][1]}*{x[2][2]}-{x[1][2]}*{x[2][1]})-{x[0][1]}*({x[1][0]}*{x[2][2]}-{x[1][2]}*{x[2][0]})+{x[0][2]}*({x[1][0]}*{x[2][1]}-{x[1][1]}*{x[2][0]}))"
    own = [[f"y{a}" if b == i else m[a][b] for b in range(3)] for a in range(3)]
    return f"{det(own)} / nullif({det(m)}, 0)"


FADE_SQL = f"""{HT}, w1 AS (SELECT *, quantile_cont(soh, 0.5) OVER (PARTITION BY cell ORDER BY k ROWS 2 PRECEDING) AS s3, avg(I_mean) OVER (PARTITION BY cell ORDER BY k ROWS 9 PRECEDING) AS i10, avg(ambient) OVER (PARTITION BY cell ORDER BY k ROWS 9 PRECEDING) AS a10,
  count(R0) {UPTO} AS n_r, count(Rct_ohm) {UPTO} AS n_c, last_value(R0 IGNORE NULLS) {UPTO} AS lr, last_value(Rct_ohm IGNORE NULLS) {UPTO} AS lc FROM g WHERE n >= 45),
w2 AS (SELECT *, CASE WHEN n_r > 3 THEN lr / avg(CASE WHEN n_r <= 3 THEN R0 END) {UPTO} END AS rr, CASE WHEN n_c > 3 THEN lc / avg(CASE WHEN n_c <= 3 THEN Rct_ohm END) {UPTO} END AS rc FROM w1),
o AS (SELECT cell, unnest(generate_series(20, max(k) - 25, 10)) AS k0 FROM w2 GROUP BY cell),
p AS (SELECT o.cell, k0, any_value(grp) AS grp, arg_max(s3, k) AS soh_now, arg_max(i10, k) AS I_mean, arg_max(a10, k) AS ambient, arg_max(rr, k) AS R0_rel, arg_max(rc, k) AS Rct_rel,
  count(*) FILTER (k > k0 - 40) AS n, sum((k - k0)::DOUBLE) FILTER (k > k0 - 40) AS s1, sum(power(k - k0, 2)) FILTER (k > k0 - 40) AS s2, sum(power(k - k0, 3)) FILTER (k > k0 - 40) AS s3, sum(power(k - k0, 4)) FILTER (k > k0 - 40) AS s4,
  sum(soh) FILTER (k > k0 - 40) AS y0, sum(soh * (k - k0)) FILTER (k > k0 - 40) AS y1, sum(soh * power(k - k0, 2)) FILTER (k > k0 - 40) AS y2 FROM o JOIN w2 ON w2.cell = o.cell AND w2.k <= k0 GROUP BY o.cell, k0 HAVING count(*) >= 10),
sl AS (SELECT o.cell, k0, quantile_cont((b.soh - a.soh) / (b.k - a.k), 0.5) AS m, count(DISTINCT a.k) AS na FROM o JOIN w2 a ON a.cell = o.cell AND a.k <= k0 AND a.k > k0 - 20 JOIN w2 b ON b.cell = o.cell AND b.k <= k0 AND b.k > a.k GROUP BY o.cell, k0),
fu AS (SELECT o.cell, k0, quantile_cont(soh, 0.5) AS soh_future FROM o JOIN w2 ON w2.cell = o.cell AND k > k0 + 23 AND k <= k0 + 26 GROUP BY o.cell, k0),
fd AS (SELECT p.cell, grp, p.k0, soh_now, CASE WHEN na > 3 THEN 100 * m END AS slope20, CASE WHEN n > 8 THEN 1e4 * {quadratic_sql(2)} END AS curv40, I_mean, ambient, NULL::DOUBLE AS cutoff_V, NULL::DOUBLE AS dq_logvar, NULL::DOUBLE AS dq_min, NULL::DOUBLE AS dq_mean, R0_rel, Rct_rel,
  (soh_now - soh_future) / 25 * 100 AS target, soh_future, 25 AS horizon FROM p JOIN fu ON p.cell = fu.cell AND p.k0 = fu.k0 LEFT JOIN sl ON p.cell = sl.cell AND p.k0 = sl.k0)"""


@query("fade_dataset", f"WITH {FADE_SQL} SELECT cell, grp, CAST(k0 AS INTEGER) AS k0, {r('soh_now', digits=6)}, {r('slope20', digits=5)}, {r('curv40', digits=3)}, {r('I_mean', digits=6)}, {r('ambient', digits=6)}, cutoff_V, dq_logvar, dq_min, dq_mean, {r('R0_rel', digits=6)}, {r('Rct_rel', digits=6)}, {r('target', digits=5)}, {r('soh_future', digits=6)}, horizon FROM fd")
def fade_dataset(spark, d):
    out = datasets.fade_dataset(kept_health(spark, d))
    return rounded(out.withColumns({"slope20": F.round("slope20", 5), "curv40": F.round("curv40", 3), "target": F.round("target", 5)}), 6)


def folds_sql(rows: str) -> str:
    """Needs WITH RECURSIVE: the largest group first into the lightest of five folds."""
    return f"""sz AS (SELECT cell, count(*) AS n FROM {rows} GROUP BY cell), so AS (SELECT *, row_number() OVER (ORDER BY n DESC, cell) AS i FROM sz),
gr AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS cell, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
  SELECT so.i, so.cell, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN so.n ELSE 0 END) FROM gr JOIN so ON so.i = gr.i + 1),
gf AS (SELECT cell, fold FROM gr WHERE i > 0)"""


@query("group_folds", f"WITH RECURSIVE {E_SQL}, {folds_sql('ev')} SELECT cell, fold FROM gf")
def group_folds(spark, d):
    return learning.group_folds(event_cycles(spark, d))


@query("imputed", f"WITH RECURSIVE {SOH_SQL}, {folds_sql('sd')}, f AS (SELECT sd.*, fold FROM sd JOIN gf USING (cell)), im AS (SELECT t.fold, quantile_cont(round(f.R0, 4), 0.5) AS a, quantile_cont(round(f.Rct_ohm, 4), 0.5) AS b FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold <> t.fold GROUP BY t.fold) SELECT cell, k::DOUBLE AS k, f.fold, {r('coalesce(R0, a, 0)', 'R0', 6)}, {r('coalesce(Rct_ohm, b, 0)', 'Rct_ohm', 6)} FROM f LEFT JOIN im ON im.fold = f.fold")
def imputed(spark, d):
    x = staged(datasets.soh_dataset(health_table(spark, d)).select("cell", "k", "R0", "Rct_ohm"), "soh")
    return rounded(learning.imputed(learning.folded(x), ["R0", "Rct_ohm"]), 6)


#: Others' moments give a line whose slope is shrunk by n / (n + penalty).
CV_SQL = f"""{SOH_SQL}, {folds_sql('sd')}, f AS (SELECT sd.*, fold FROM sd JOIN gf USING (cell)),
mo AS (SELECT t.fold, count(*)::DOUBLE AS n, avg(k) AS mx, avg(soh) AS my, stddev_pop(k) AS sx, stddev_pop(soh) AS sy, corr(k, soh) AS c FROM f JOIN (SELECT DISTINCT fold FROM f) t ON f.fold <> t.fold GROUP BY t.fold),
mw AS (SELECT *, c * n / (n + 1e-3) AS w FROM mo), mv AS (SELECT *, greatest(n - 2 * w * n * c + w * w * n, 0) / (n - 2) AS noise FROM mw),
pr AS (SELECT cell, soh, my + (k - mx) / sx * w * sy AS pred, sqrt((k - mx) / sx * (k - mx) / sx * noise / (n + 1e-3) + noise) * sy AS std FROM f JOIN mv ON mv.fold = f.fold)"""
SUMMARY = """count(*) AS n, sqrt(avg((soh - pred) * (soh - pred))) AS rmse, avg(abs(soh - pred)) AS mae, CASE WHEN count(*) >= 3 AND var_pop(soh) > 0 THEN 1 - sum((soh - pred) * (soh - pred)) / (var_pop(soh) * count(*)) END AS r2, avg((soh >= pred - 1.645::DOUBLE * std AND soh <= pred + 1.645::DOUBLE * std)::INT) AS coverage90"""


def line_cv(spark, d) -> DataFrame:
    return learning.grouped_cv(datasets.soh_dataset(health_table(spark, d)).select("cell", "k", "soh"), ["k"], "soh", alpha=1e-3)


def short_r2(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("r2", F.round("r2", 4)), 6)


@query("grouped_cv_summary", f"WITH RECURSIVE {CV_SQL}, s AS (SELECT {SUMMARY} FROM pr) SELECT n, {r('rmse', digits=6)}, {r('mae', digits=6)}, {r('r2', digits=4)}, {r('coverage90', digits=6)} FROM s")
def grouped_cv_summary(spark, d):
    return short_r2(learning.cv_summary(line_cv(spark, d), "soh"))


@query("grouped_cv_cells", f"WITH RECURSIVE {CV_SQL}, s AS (SELECT cell, {SUMMARY} FROM pr GROUP BY cell) SELECT cell, n, {r('rmse', digits=6)}, {r('mae', digits=6)}, {r('r2', digits=4)}, {r('coverage90', digits=6)} FROM s")
def grouped_cv_cells(spark, d):
    return short_r2(learning.cv_summary(line_cv(spark, d), "soh", ("cell",)))


@query(
    "fade_backtest",
    f"""WITH {FADE_SQL}, ce AS (SELECT DISTINCT cell FROM fd), md AS (SELECT ce.cell, {', '.join(f'quantile_cont(round({c}, 4), 0.5) AS m{i}' for i, c in enumerate(("slope20", "R0_rel")))} FROM ce JOIN fd ON fd.cell <> ce.cell GROUP BY ce.cell),
fx AS (SELECT md.cell AS t, fd.*, coalesce(slope20, m0, 0) AS x, coalesce(R0_rel, m1, 0) AS z FROM md, fd),
mo AS (SELECT t, count(*)::DOUBLE AS n, avg(x) AS mx, avg(z) AS mz, avg(target) AS my, stddev_pop(x) AS sx, stddev_pop(z) AS sz, stddev_pop(target) AS sy, corr(x, target) AS cx, corr(z, target) AS cz, corr(x, z) AS c FROM fx WHERE cell <> t GROUP BY t HAVING count(DISTINCT cell) >= 3 AND count(*) >= 3),
mw AS (SELECT *, 1 + 1e-3 / n AS e, (cx * (1 + 1e-3 / n) - c * cz) / ((1 + 1e-3 / n) * (1 + 1e-3 / n) - c * c) AS wx, (cz * (1 + 1e-3 / n) - c * cx) / ((1 + 1e-3 / n) * (1 + 1e-3 / n) - c * c) AS wz FROM mo),
bp AS (SELECT fx.cell, k0, soh_now, soh_future, target, horizon, my + ((x - mx) / sx * wx + (z - mz) / sz * wz) * sy AS rate_pred FROM fx JOIN mw ON mw.t = fx.t WHERE fx.cell = fx.t)
SELECT cell, CAST(k0 AS INTEGER) AS k0, {r('soh_now', digits=5)}, {r('soh_future', digits=5)}, {r('target', digits=4)}, horizon, {r('rate_pred', digits=4)}, {r('soh_now - rate_pred * horizon / 100', 'soh_pred', 5)} FROM bp""",
)
def fade_backtest(spark, d):
    out = learning.backtest(datasets.fade_dataset(kept_health(spark, d)), ["slope20", "R0_rel"], alpha=1e-3).drop("soh_std")
    return rounded(out.withColumns({"target": F.round("target", 4), "rate_pred": F.round("rate_pred", 4)}), 5)


HIS = ["R0", "Re_ohm", "Rct_ohm", "T_rise", "V_mean"]
MONO_TAIL = MONO_SQL.split("INTO NAME hi VALUE x),")[1]
HI_SQL = f"""{HT}, lg AS (UNPIVOT (SELECT cell, k, {', '.join(HIS)} FROM g) ON {', '.join(HIS)} INTO NAME hi VALUE x), {MONO_TAIL}, {SPEAR_SQL},
{SCORE_SQL},
rx AS (SELECT lg.cell, hi, soh, x, count(x) OVER (PARTITION BY lg.cell, hi ORDER BY lg.k) AS i FROM lg JOIN g ON g.cell = lg.cell AND g.k = lg.k),
ry AS (SELECT cell, hi, soh AS y, x / avg(CASE WHEN i <= 3 THEN x END) OVER (PARTITION BY cell, hi) AS x FROM rx),
ow AS (SELECT cell, hi, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM ry GROUP BY cell, hi),
ot AS (SELECT o.cell, o.hi, sum(p.n) AS n, sum(p.sx) AS sx, sum(p.sy) AS sy, sum(p.sxx) AS sxx, sum(p.sxy) AS sxy FROM ow o JOIN ow p ON o.hi = p.hi AND o.cell <> p.cell GROUP BY o.cell, o.hi),
oz AS (SELECT *, sx / n AS mu, sqrt(sxx / n - (sx / n) * (sx / n)) + 1e-12 AS s FROM ot),
ob AS (SELECT *, ((sxy - mu * sy) / s) / ((sxx - 2 * mu * sx + n * mu * mu) / (s * s) + 1e-3) AS b, sy / (n + 1e-3) AS a FROM oz),
lc AS (SELECT hi, avg(e) AS loco_rmse FROM (SELECT ry.cell, ry.hi, sqrt(avg((y - (a + b * (x - mu) / s)) * (y - (a + b * (x - mu) / s)))) AS e FROM ry JOIN ob ON ob.cell = ry.cell AND ob.hi = ry.hi GROUP BY ry.cell, ry.hi) GROUP BY hi)"""


@query("hi_ranking", f"WITH {HI_SQL} SELECT hi, n_cells, {r('mono', digits=6)}, {r('trend', digits=6)}, {r('prog', digits=6)}, {r('score', digits=6)}, {r('loco_rmse', digits=5)} FROM sc LEFT JOIN lc USING (hi)")
def hi_ranking(spark, d):
    """Indicators with their scores and their error on left-out cells."""
    g = kept_health(spark, d).where(~F.col("outlier") & F.col("soh").isNotNull())
    ratio = datasets.relative(g, HIS)
    out = None
    for c in HIS:
        part = indicators.loco_ridge(ratio, c, "soh").agg(F.round(F.avg("rmse"), 5).alias("loco_rmse")).withColumn("hi", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return rounded(indicators.scores(g, HIS).join(F.broadcast(out), "hi", "left"), 6)  # one row an indicator


@query("eligible_columns", f"WITH {HT}, a AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count({c}) / count(*) AS share, stddev_samp({c}) AS sd FROM ht" for c in ("R0", "Rct_ohm", "T_rise")) + f") SELECT \"column\", n, {r('share')}, {r('sd')}, n >= 10 AND share > 0.5 AND coalesce(sd, 0) > 0 AS ok FROM a")
def eligible_columns(spark, d):
    return rounded(datasets.eligible(health_table(spark, d), ["R0", "Rct_ohm", "T_rise"]))


RATES_SQL = f"{E_SQL}, ts AS (SELECT a.cell, quantile_cont((b.cap - a.cap) / (b.k - a.k), 0.5) AS m FROM ev a JOIN ev b ON a.cell = b.cell AND b.k > a.k GROUP BY a.cell), ra AS (SELECT ev.cell, CASE WHEN count(*) >= 10 THEN -100 * any_value(m) END AS y, avg(I_mean) AS x FROM ev LEFT JOIN ts ON ts.cell = ev.cell GROUP BY ev.cell)"


@query("stress_line", f"WITH {RATES_SQL}, q AS (SELECT count(*) AS n, regr_slope(y, x) * stddev_pop(x) AS coef, regr_r2(y, x) AS r2, var_pop(y) AS v FROM ra WHERE y IS NOT NULL), s AS (SELECT *, sqrt(v * (1 - r2) / (n - 2)) AS se FROM q) SELECT 'I_mean' AS factor, n, {r('coef', digits=6)}, {r('se', digits=6)}, {r('coef / se', 't', 4)}, {r('r2', digits=6)} FROM s")
def stress_line(spark, d):
    e = event_cycles(spark, d)
    rates = indicators.fade_rates(e).join(e.groupBy("cell").agg(F.avg("I_mean").alias("I_mean")), "cell")
    fit, facts = learning.stress_regression(rates, ["I_mean"])
    rows = [("I_mean", int(facts["n"]), float(x.coef), float(x.se), float(x.t), float(facts["r2"])) for x in fit.itertuples()]
    return rounded(spark.createDataFrame(rows, "factor string, n long, coef double, se double, t double, r2 double").withColumn("t", F.round("t", 4)), 6)


STRESS = ["I_mean", "ambient", "T_rise"]  # the driver's tables tell nothing of cut-off and pulses
STRESS_SQL = f"""{HT}, ts AS (SELECT a.cell, quantile_cont((b.soh - a.soh) / (b.k - a.k), 0.5) AS m FROM g a JOIN g b ON a.cell = b.cell AND b.k > a.k GROUP BY a.cell),
ra AS (SELECT g.cell, count(*) AS n, -100 * any_value(m) AS y, quantile_cont(round(I_mean, 4), 0.5) AS a, quantile_cont(round(ambient, 4), 0.5) AS b, quantile_cont(round(T_rise, 4), 0.5) AS c FROM g JOIN ts ON ts.cell = g.cell GROUP BY g.cell HAVING count(*) >= 10),
q AS (SELECT count(*) AS n, corr(a, b) AS r, corr(a, c) AS s, corr(b, c) AS t, corr(a, y) AS ya, corr(b, y) AS yb, corr(c, y) AS yc, stddev_pop(y) AS sy FROM ra WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL),
iv AS (SELECT *, 1 + 2 * r * s * t - r * r - s * s - t * t AS d FROM q),
w AS (SELECT *, (1 - t * t) / d AS ia, (1 - s * s) / d AS ib, (1 - r * r) / d AS ic, (s * t - r) / d AS iab, (r * t - s) / d AS iac, (r * s - t) / d AS ibc FROM iv),
e AS (SELECT *, ia * ya + iab * yb + iac * yc AS wa, iab * ya + ib * yb + ibc * yc AS wb, iac * ya + ibc * yb + ic * yc AS wc FROM w),
f AS (SELECT *, sqrt((1 - wa * ya - wb * yb - wc * yc) / (n - 4)) AS se FROM e)"""


@query("stress_coefficients", f"WITH {STRESS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS factor, {r(f'sy * w{i}', 'coef', 6)}, {r(f'sy * se * sqrt(i{i})', 'se', 6)}, {r(f'i{i}', 'vif', 5)} FROM f" for c, i in zip(STRESS, "abc", strict=True)))
def stress_coefficients(spark, d):
    """stress_regression without the tail probabilities, which SQL has no function for."""
    return rounded(stress_regression(spark, d).select("factor", "coef", "se", F.round("vif", 5).alias("vif")), 6)


@query("stress_regression")
def stress_regression(spark, d):
    """What the loss of health depends on, of the factors that the table has."""
    h = kept_health(spark, d, "cell", "k", "soh", "outlier", *STRESS)
    rates = staged(indicators.stress_table(h), "stress")
    return spark.createDataFrame(learning.stress_regression(rates, STRESS)[0])


@query("pca_pair", f"WITH {HT}, z AS (SELECT cell, k, (T_mean - avg(T_mean) OVER ()) / stddev_pop(T_mean) OVER () AS a, (V_mean - avg(V_mean) OVER ()) / stddev_pop(V_mean) OVER () AS b FROM ht), c AS (SELECT corr(T_mean, V_mean) AS c FROM ht) SELECT cell, k, {r('abs(a + sign(c) * b) / sqrt(2)', 'PC1', 5)}, {r('abs(a - sign(c) * b) / sqrt(2)', 'PC2', 5)} FROM z, c")
def pca_pair(spark, d):
    scores = learning.pca(health_table(spark, d), ["T_mean", "V_mean"])[0]
    return rounded(scores.select("cell", "k", F.abs("PC1").alias("PC1"), F.abs("PC2").alias("PC2")), 5)


# --- forecasts --------------------------------------------------------------------------------------------------------

_head, _tail = SQL["conformal_radii"].rsplit("\nSELECT cell, model, h, k0, CAST", 1)
RADII_SQL = f"{_head}, cr AS (SELECT cell, model, h, k0, CAST{_tail.replace('THEN round(s[', 'THEN (s[').replace(', 6) END AS radius', ') END AS radius')}), bd AS (SELECT rs.*, radius FROM rs JOIN cr USING (cell, model, h, k0))"


@query("conformal_bands", f"{RADII_SQL} SELECT cell, model, h, k0, {r('CASE WHEN radius IS NULL THEN lo ELSE pred - radius END', 'lo', 6)}, {r('CASE WHEN radius IS NULL THEN hi ELSE pred + radius END', 'hi', 6)}, radius IS NOT NULL AS calibrated FROM bd")
def conformal_bands(spark, d):
    out = forecasts.conformal(forecast_log(spark, d))
    lo, hi, known = forecasts.band(F.col("radius"), F.col("pred"), F.col("lo"), F.col("hi"))
    return rounded(out.select("cell", "model", "h", "k0", lo.alias("lo"), hi.alias("hi"), known.alias("calibrated")), 6)


@query(
    "forecast_fan",
    f"""{RADII_SQL}, lx AS (SELECT *, row_number() OVER (PARTITION BY cell, model, h ORDER BY k0 DESC) AS i FROM bd), ly AS (SELECT cell, model, h, pred, radius FROM lx WHERE i = 1 AND radius IS NOT NULL),
fn AS (SELECT cell, model, v.h, max(pred) AS pred, max(ly.h) FILTER (ly.h <= v.h) AS hb, min(ly.h) FILTER (ly.h >= v.h) AS ha FROM ly, (SELECT unnest(generate_series(1, 60)) AS h) v GROUP BY cell, model, v.h),
fr AS (SELECT fn.*, b.radius AS rb, a.radius AS ra FROM fn LEFT JOIN ly b ON b.cell = fn.cell AND b.model = fn.model AND b.h = fn.hb LEFT JOIN ly a ON a.cell = fn.cell AND a.model = fn.model AND a.h = fn.ha),
fq AS (SELECT *, CASE WHEN hb IS NULL THEN ra WHEN ha IS NULL OR ha = hb THEN rb ELSE rb + (h - hb) / (ha - hb) * (ra - rb) END AS rr FROM fr)
SELECT cell, model, CAST(h AS INTEGER) AS h, {r('pred', digits=6)}, {r('pred - rr', 'lo', 6)}, {r('pred + rr', 'hi', 6)} FROM fq""",
)
def forecast_fan(spark, d):
    return rounded(forecasts.fan(forecast_log(spark, d)), 6)


@query("live_accuracy", f"WITH {FC_SQL}, a AS (SELECT model, h, count(*) AS n, sqrt(avg((actual - pred) * (actual - pred))) AS rmse, avg(abs(actual - pred)) AS mae, avg((actual >= lo AND actual <= hi)::INT) AS coverage FROM rs WHERE actual IS NOT NULL GROUP BY model, h) SELECT model, h, n, {r('rmse')}, {r('mae')}, {r('coverage')} FROM a")
def live_accuracy(spark, d):
    return rounded(forecasts.live_accuracy(forecast_log(spark, d)))


@query(
    "linear_trend",
    f"""WITH {E_SQL}, lt AS (SELECT cell, k, cap, count(cap) OVER w AS n, regr_slope(cap, k::DOUBLE) OVER w AS b, regr_intercept(cap, k::DOUBLE) OVER w AS a FROM ev WINDOW w AS (PARTITION BY cell ORDER BY k ROWS 19 PRECEDING))
SELECT cell, k AS k0, h, {r('CASE WHEN n >= 3 THEN a + b * (k + h) ELSE cap END', 'pred', 5)} FROM lt, (VALUES (1), (10), (25), (50)) v(h)""",
)
def linear_trend(spark, d):
    return rounded(forecasts.linear_trend(event_cycles(spark, d)).select("cell", "k0", "h", "pred"), 5)


RUL_BODY = SQL["rul_crossings"].split(f"WITH {E_SQL},")[1]


@query(
    "rul_accuracy",
    f"""WITH {EOL_SQL}, {RUL_BODY.rsplit(chr(10) + 'SELECT x.cell', 1)[0]}, ru AS (SELECT x.cell{RUL_BODY.rsplit(chr(10) + 'SELECT x.cell', 1)[1]}), j AS (SELECT ru.cell, k AS k0, k + crossing AS p, eol_k, k < eol_k AS before FROM ru LEFT JOIN eol ON eol.cell = ru.cell),
s AS (SELECT cell, max(eol_k) AS eol_k, count(*) FILTER (before) AS n, avg(abs(p - eol_k)) FILTER (before) AS eol_mae, avg((p IS NOT NULL)::INT) FILTER (before) AS predicted FROM j GROUP BY cell)
SELECT cell, eol_k, n, {r('eol_mae', digits=4)}, {r('predicted', digits=6)}, CASE WHEN eol_k IS NULL THEN 'EOL not reached' WHEN n = 0 THEN 'no origin before EOL' WHEN eol_mae IS NULL THEN 'never predicted' ELSE 'ok' END AS status FROM s""",
)
def rul_accuracy(spark, d):
    rul = QUERIES["rul_crossings"](spark, d).select("cell", F.lit("path").alias("model"), F.col("k").alias("k0"), (F.col("k") + F.col("crossing")).alias("eol_pred"))
    out = study.rul_accuracy(rul, quality.detect_eol(quality.hampel(event_cycles(spark, d)))).drop("model")
    return rounded(out.withColumn("eol_mae", F.round("eol_mae", 4)), 6)


@query("estimation_accuracy", f"WITH {E_SQL}, t AS (SELECT cell, cap, avg(cap) OVER (PARTITION BY cell ORDER BY k ROWS 9 PRECEDING) AS p FROM ev) SELECT cell, 'trailing mean' AS model, count(*) AS n, {r('sqrt(avg((cap - p) * (cap - p)))', 'rmse')}, {r('avg(abs(cap - p))', 'mae')} FROM t GROUP BY cell")
def estimation_accuracy(spark, d):
    est = forecasts.trailing_mean(event_cycles(spark, d), horizons=(1,)).select("cell", "model", F.col("pred").alias("soh"), F.col("now").alias("measured"))
    return rounded(study.estimation_accuracy(est))


@query("mechanism_shares", f"WITH {E_SQL}, a AS (SELECT grp, avg(cap / 4) AS LLI, avg(I_mean / 10) AS LAM_PE, avg(ambient / 50) AS LAM_NE FROM ev GROUP BY grp) SELECT grp, {r('LLI')}, {r('LAM_PE')}, {r('LAM_NE')}, CASE greatest(LLI, LAM_PE, LAM_NE) WHEN LLI THEN 'LLI' WHEN LAM_PE THEN 'LAM_PE' ELSE 'LAM_NE' END AS dominant FROM a")
def mechanism_shares(spark, d):
    e = event_cycles(spark, d).select("grp", (F.col("cap") / 4).alias("LLI"), (F.col("I_mean") / 10).alias("LAM_PE"), (F.col("ambient") / 50).alias("LAM_NE"))
    return rounded(study.mechanism_shares(e, ["LLI", "LAM_PE", "LAM_NE"]))


@query("pairwise_differences", f"WITH {FC_SQL}, o AS (SELECT cell, model, rmse FROM mt WHERE h = 10 AND status = 'ok') SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, {r('quantile_cont(a.rmse - b.rmse, 0.5)', 'median_diff', 6)}, count(*) FILTER (a.rmse < b.rmse) AS a_better FROM o a JOIN o b ON a.cell = b.cell AND a.model < b.model GROUP BY a.model, b.model")
def pairwise_differences(spark, d):
    """pairwise_models without the tail probabilities, which SQL has no function for."""
    metrics = forecasts.accuracy(forecast_log(spark, d)).withColumn("status", F.when(F.col("n") < 5, "insufficient").otherwise("ok"))
    return rounded(study.pairwise(metrics, 10).select("model_a", "model_b", "n", "median_diff", "a_better"), 6)


CURVE_SQL = f"""{L_SQL}, rc AS (SELECT *, row_number() OVER w AS p, greatest((abs(Current_A) + lag(abs(Current_A)) OVER w) / 2 * (Time_s - lag(Time_s) OVER w) / 3600, 0) AS dq FROM smp WHERE Cycle_Type = 'discharge' WINDOW w AS (PARTITION BY Cell_ID, Cycle_Index ORDER BY Time_s)),
ro AS (SELECT *, min(p) FILTER (abs(Current_A) > 0.1) OVER c AS p0, max(p) FILTER (abs(Current_A) > 0.1) OVER c AS p1, count(*) FILTER (abs(Current_A) > 0.1) OVER c AS m FROM rc WINDOW c AS (PARTITION BY Cell_ID, Cycle_Index)),
rq AS (SELECT Cell_ID, Cycle_Index, p - p0 AS j, p1 - p0 + 1 AS size, Time_s - min(Time_s) OVER c AS t, max(Time_s) OVER c - min(Time_s) OVER c AS span, Voltage_V AS v, Current_A AS i, sum(CASE WHEN p > p0 THEN dq ELSE 0 END) OVER (PARTITION BY Cell_ID, Cycle_Index ORDER BY p) AS q
  FROM ro WHERE m >= 5 AND p BETWEEN p0 AND p1 WINDOW c AS (PARTITION BY Cell_ID, Cycle_Index))"""


@query("curve_points", f"WITH {CURVE_SQL} SELECT Cell_ID, Cycle_Index, t, {r('v')}, {r('abs(i)', 'i')}, {r('q')} FROM rq")
def curve_points(spark, d):
    """Curves as rows; cycles of these tables have fewer points than a curve keeps, so none is resampled."""
    return rounded(curves.curve_rows(lineitem_samples(spark, d)).drop("j"))


@query(
    "curve_grid",
    f"""WITH {CURVE_SQL}, nx AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2, lead(i) OVER w AS i2, lead(q) OVER w AS q2 FROM rq WHERE size > 4 WINDOW w AS (PARTITION BY Cell_ID, Cycle_Index ORDER BY j)),
gr AS (SELECT Cell_ID, Cycle_Index, span, unnest([0, 1, 2, 3]) AS g FROM (SELECT DISTINCT Cell_ID, Cycle_Index, span FROM nx)),
br AS (SELECT gr.Cell_ID, gr.Cycle_Index, g, gr.span * g / 3 AS tt, arg_max(nx, nx.t) AS b FROM gr JOIN nx ON nx.Cell_ID = gr.Cell_ID AND nx.Cycle_Index = gr.Cycle_Index AND nx.t <= gr.span * g / 3 + 1e-7 GROUP BY ALL),
fi AS (SELECT *, coalesce((tt - b.t) / (b.t2 - b.t), 0) AS f FROM br)
SELECT Cell_ID, Cycle_Index, CAST(g AS INTEGER) AS j, round(tt, 5) AS t, {', '.join(f"round({'abs' if c == 'i' else ''}(b.{c} + f * coalesce(b.{c}2 - b.{c}, 0)), 6) + 0.0::DOUBLE AS {c}" for c in 'viq')} FROM fi
UNION ALL SELECT Cell_ID, Cycle_Index, CAST(j AS INTEGER), round(t, 5), {', '.join(f"round({'abs' if c == 'i' else ''}({c}), 6) + 0.0::DOUBLE" for c in 'viq')} FROM rq WHERE size <= 4""",
)
def curve_grid(spark, d):
    """Curves of at most four points: longer cycles are resampled."""
    out = curves.curve_rows(lineitem_samples(spark, d), 4)
    return rounded(out.withColumn("t", F.round("t", 5)), 6)


# --- plants and policies ----------------------------------------------------------------------------------------------


@query(
    "population_prior",
    f"""WITH {HT}, q AS (SELECT cell, count(*) AS n, sum(k / 100.0::DOUBLE) AS s1, sum(power(k / 100.0::DOUBLE, 2)) AS s2, sum(power(k / 100.0::DOUBLE, 3)) AS s3, sum(power(k / 100.0::DOUBLE, 4)) AS s4, sum(soh) AS y0, sum(soh * (k / 100.0::DOUBLE)) AS y1, sum(soh * power(k / 100.0::DOUBLE, 2)) AS y2 FROM g GROUP BY cell HAVING count(*) >= 10),
b AS (SELECT {quadratic_sql(0)} AS b0, {quadratic_sql(1)} AS b1, {quadratic_sql(2)} AS b2 FROM q)
SELECT count(*) AS n_cells, {r('avg(b0)', 'mu0', 5)}, {r('avg(b1)', 'mu1', 4)}, {r('avg(b2)', 'mu2', 3)}, {r('covar_samp(b0, b0) * 1.5 + 1e-5', 'cov00', 4)}, {r('covar_samp(b0, b1) * 1.5', 'cov01', 3)}, {r('covar_samp(b1, b1) * 1.5 + 1e-4', 'cov11', 2)} FROM b""",
)
def population_prior(spark, d):
    out = datasets.population_prior(health_table(spark, d).where(~F.col("outlier")))
    digits = {"mu0": 5, "mu1": 4, "mu2": 3, "cov00": 4, "cov01": 3, "cov11": 2}
    return rounded(out.select("n_cells", *(F.round(c, n).alias(c) for c, n in digits.items())))


SEG_SQL = f"""{HT}, sg AS (SELECT cell, rn AS j FROM g WHERE (rn - 1) % 5 = 0 AND rn - 1 < n - 15), sm AS (SELECT sg.cell, j, avg(soh) AS soh FROM sg JOIN g ON g.cell = sg.cell AND g.rn BETWEEN j AND j + 14 GROUP BY sg.cell, j),
sr AS (SELECT sg.cell, j, -quantile_cont((b.soh - a.soh) / (b.k - a.k), 0.5) AS rate FROM sg JOIN g a ON a.cell = sg.cell AND a.rn BETWEEN j AND j + 14 JOIN g b ON b.cell = sg.cell AND b.rn BETWEEN j AND j + 14 AND b.rn > a.rn GROUP BY sg.cell, j),
seg AS (SELECT sm.cell, sm.j, sm.soh, sr.rate FROM sm JOIN sr ON sr.cell = sm.cell AND sr.j = sm.j)"""


@query("calibration_segments", f"WITH {SEG_SQL} SELECT cell, {r('soh', digits=6)}, {r('rate')} FROM seg")
def calibration_segments(spark, d):
    return rounded(economics.segments(health_table(spark, d)).withColumn("soh", F.round("soh", 6)))


@query(
    "plant_calibration",
    f"""WITH {SEG_SQL}, ow AS (SELECT cell, count(*) AS n, any_value(bol) AS bol_ah, quantile_cont(I_mean, 0.5) AS i, count(R0) AS n_r, max(CASE WHEN R0 IS NOT NULL THEN 1 - soh END) - min(CASE WHEN R0 IS NOT NULL THEN 1 - soh END) AS span, regr_slope(R0, 1 - soh) AS gm, regr_intercept(R0, 1 - soh) AS rb FROM g GROUP BY cell),
lo AS (SELECT cell, regr_slope(rate, 1 - soh) AS b1, regr_intercept(rate, 1 - soh) AS b0, quantile_cont(rate, 0.5) AS mid FROM seg GROUP BY cell),
a AS (SELECT ow.*, b0, b1, mid, n >= 20 AND b0 IS NOT NULL AND NOT isnan(b0) AS f, n_r > 10 AND span > 0.03 AS rs FROM ow LEFT JOIN lo ON lo.cell = ow.cell)
SELECT cell, {r('bol_ah', digits=5)}, CASE WHEN round_even(i * 2, 0) / 2 = 0 THEN 2.0::DOUBLE ELSE round_even(i * 2, 0) / 2 END AS i_ref, {r('CASE WHEN f THEN CASE WHEN b0 <= 0 THEN greatest(mid, 1e-5) ELSE b0 END ELSE 1.5e-3 END', 'r_ref', 5)},
  {r('CASE WHEN f THEN CASE WHEN b0 <= 0 THEN 0 ELSE least(greatest(b1 / b0, 0), 20) END ELSE 2 END', 'kappa', 3)}, {r('CASE WHEN rs THEN greatest(rb, 0.01) ELSE 0.08 END', 'r_bol', 5)}, {r('CASE WHEN rs THEN greatest(gm, 0) ELSE 0.15 END', 'gamma', 5)}, {r('least(1.4::DOUBLE / bol_ah - 0.05::DOUBLE, 0.8::DOUBLE)', 's_floor', 5)},
  CASE WHEN f THEN 'own history' ELSE 'default' END AS fade_source, CASE WHEN rs THEN 'own history' ELSE 'default' END AS resistance_source FROM a""",
)
def plant_calibration(spark, d):
    out = economics.calibrate(health_table(spark, d)).drop("alpha", "alpha_source")
    return rounded(out.withColumn("kappa", F.round("kappa", 3)), 5)


@query(
    "fleet_exponent",
    f"""WITH {HT}, gd AS (SELECT cell, k, soh, I_mean FROM ht WHERE NOT outlier AND ambient BETWEEN 0 AND 50 AND k <= 80), ow AS (SELECT cell, count(*) AS n, quantile_cont(I_mean, 0.5) AS i FROM gd GROUP BY cell),
lv AS (SELECT cell, count(DISTINCT round_even(I_mean * 2, 0)) AS l FROM ht GROUP BY cell), ts AS (SELECT a.cell, quantile_cont((b.soh - a.soh) / (b.k - a.k), 0.5) AS m FROM gd a JOIN gd b ON a.cell = b.cell AND b.k > a.k GROUP BY a.cell),
u AS (SELECT ln(i) AS x, ln(-m) AS y FROM ow JOIN lv ON lv.cell = ow.cell JOIN ts ON ts.cell = ow.cell WHERE n >= 20 AND l <= 5 AND m < 0), f AS (SELECT count(*) AS n_cells, max(x) - min(x) AS span, regr_slope(y, x) AS a FROM u)
SELECT {r('CASE WHEN n_cells >= 3 AND span >= 0.3 THEN least(greatest(a, 0), 3) ELSE 1 END', 'alpha', 5)}, n_cells, CASE WHEN n_cells >= 3 AND span >= 0.3 THEN 'fleet' ELSE 'default' END AS source FROM f""",
)
def fleet_exponent(spark, d):
    h = kept_health(spark, d, "cell", "k", "soh", "outlier", "I_mean", "ambient")
    early = h.where(~F.col("outlier") & (F.col("k") <= 80))
    return rounded(economics.fleet_exponent(h, indicators.theil_sen(early, "k", "soh"), (0.0, 50.0), 5), 5)


CURRENTS = (1.0, 2.0, 3.0, 4.0)
FLOWS = """fp AS (SELECT *, soh * 1.9::DOUBLE AS cap, 0.08::DOUBLE + 0.15::DOUBLE * (1 - soh) AS res FROM st), fm AS (SELECT *, 6.0::DOUBLE / (cap / current + cap / 1.5::DOUBLE + 0.5::DOUBLE) AS cycles FROM fp),
fo AS (SELECT *, cycles * cap * greatest(3.6::DOUBLE - current * res, 0.5::DOUBLE) / 1000 AS energy, cycles * cap * (3.6::DOUBLE + 1.5::DOUBLE * res) / 1000 / 0.95::DOUBLE AS bought FROM fm),
fw AS (SELECT *, energy * 1.5::DOUBLE AS revenue, bought * 0.3::DOUBLE AS energy_cost, 3.0::DOUBLE * greatest(0.012::DOUBLE - energy, 0.0::DOUBLE) AS perf_loss, cycles * 1.5e-3::DOUBLE * (current / 2.0::DOUBLE) * (1 + 2.0::DOUBLE * (1 - soh)) AS dsoh FROM fo)"""


def _states(spark, d) -> DataFrame:
    h = health_table(spark, d).where(~F.col("outlier"))
    last = h.groupBy("cell").agg(F.max_by("soh", "k").alias("soh"))
    return economics.with_plant(last.select("cell", "soh", F.explode(F.array(*map(F.lit, CURRENTS))).alias("current")))


@query("daily_flows", f"WITH {HT}, st AS (SELECT cell, arg_max(soh, k) AS soh, unnest([1.0, 2.0, 3.0, 4.0])::DOUBLE AS current FROM ht WHERE NOT outlier GROUP BY cell), {FLOWS} SELECT cell, current, {', '.join(r(c, digits=8) for c in ('soh', 'cycles', 'energy', 'revenue', 'energy_cost', 'perf_loss', 'dsoh'))} FROM fw")
def daily_flows(spark, d):
    """What each cell earns and loses in a day at its last health, at four currents."""
    return rounded(economics.daily_flows(_states(spark, d)).drop(*economics.PLANT), 8)


@query("policy_ledger", f"WITH {HT}, st AS (SELECT cell, soh, unnest([1.0, 2.0, 3.0, 4.0])::DOUBLE AS current FROM g), {FLOWS}, s AS (SELECT current AS policy, sum(revenue) AS revenue, sum(energy_cost) AS energy_cost, sum(perf_loss) AS perf_loss, sum(energy) AS energy, count(*) AS days FROM fw GROUP BY current), t AS (SELECT *, revenue - energy_cost - perf_loss AS profit FROM s) SELECT policy, {', '.join(r(c, digits=5) for c in ('revenue', 'energy_cost', 'perf_loss', 'energy', 'profit'))}, 0.0::DOUBLE AS battery_cost, 0::BIGINT AS replacements, days, {r('max(profit) OVER () - profit', 'gap', 5)} FROM t")
def policy_ledger(spark, d):
    """Every observed cycle as a day at each of four currents: what the fixed policies would bring, and their gap to the best."""
    g = health_table(spark, d).where(~F.col("outlier") & F.col("soh").isNotNull())
    days = economics.with_plant(g.select("cell", "soh", F.explode(F.array(*map(F.lit, CURRENTS))).alias("current")))
    return rounded(economics.summarise(economics.daily_flows(days).withColumn("policy", F.col("current"))), 5)


# --- cells, sources, order, streams -----------------------------------------------------------------------------------

CELLS_SQL = "ce(Cell_ID, grp, load, cutoff_V, stop_Ah) AS (VALUES " + ", ".join(f"('B{n:04d}', '{g}', '{load}', {v}::DOUBLE, {'NULL' if stop is None else stop}::DOUBLE)" for g, numbers, _, load, cut, stop in registry.TESTS for n, v in zip(numbers, cut, strict=True)) + ")"


@query("cell_registry", f"WITH {CELLS_SQL} SELECT *, load = 'pulsed' AS pulsed FROM ce")
def cell_registry(spark, d):
    return registry.cells(spark).drop("ambients").withColumn("pulsed", registry.is_pulsed())


@query("cells_with_conditions", f"WITH {E_SQL}, {CELLS_SQL} SELECT cell, k, coalesce(ce.grp, 'Unknown') AS grp, cutoff_V, coalesce(load = 'pulsed', false) AS declared_pulsed FROM ev LEFT JOIN ce ON ce.Cell_ID = ev.cell")
def cells_with_conditions(spark, d):
    return registry.with_cells(event_cycles(spark, d), registry.cells(spark)).select("cell", "k", "grp", "cutoff_V", "declared_pulsed")


@query("cell_slice", f"WITH {L_SQL} SELECT Cell_ID, Cycle_Index, Cycle_Type, Time_s, round(Voltage_V, 7) AS Voltage_V FROM smp WHERE Cell_ID = 'B0005' AND Cycle_Type = 'discharge' AND Cycle_Index IN (SELECT Cycle_Index FROM smp WHERE Cycle_Index % 5 = 0)")
def cell_slice(spark, d):
    cycles = range(4 * 1990, 4 * 2100, 5)
    return rounded(datasets.of_cell(lineitem_samples(spark, d), "B0005", cycles, "discharge", "Cell_ID", "Cycle_Index").select("Cell_ID", "Cycle_Index", "Cycle_Type", "Time_s", "Voltage_V"))


@query("name_filters", "SELECT n_nationkey, replace(lower(n_name), ' ', '_') AS name FROM nation WHERE NOT regexp_matches(n_name, '(?i)united|china') AND NOT starts_with(n_name, 'I')")
def name_filters(spark, d):
    n = table(spark, d, "nation")
    return n.where(~F.col("n_name").rlike("(?i)united|china") & ~F.col("n_name").startswith("I")).select("n_nationkey", F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")).alias("name"))


@query("evenly_spaced", f"WITH {E_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM ev) SELECT cell, k, {r('cap')} FROM n WHERE k - 1 IN (SELECT CAST(floor(i * (n - 1) / 6.0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 6)) AS i))")
def evenly_spaced(spark, d):
    return rounded(datasets.evenly(event_cycles(spark, d), 7).select("cell", "k", "cap"))


@query("sorted_samples", f"WITH {L_SQL} SELECT Cell_ID, Cycle_Index, Time_s, CAST(row_number() OVER (PARTITION BY Cell_ID ORDER BY Cycle_Index, Time_s) AS INTEGER) AS position FROM smp")
def sorted_samples(spark, d):
    """Samples in order of cell, cycle and time, with their place within the cell."""
    w = samples.Window.partitionBy("Cell_ID").orderBy("Cycle_Index", "Time_s")
    placed = samples.normalise_samples(lineitem_samples(spark, d)).select("Cell_ID", "Cycle_Index", "Time_s", F.row_number().over(w).alias("position"))
    return datasets.ordered(placed, ["Cell_ID", "Cycle_Index"], ["Time_s"])


@query("sources_agree", "SELECT unnest(['bytes', 'frame', 'pandas', 'path']) AS source, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation")
def sources_agree(spark, d):
    """The same table read from a path, a frame, a pandas frame and the bytes of a file."""
    import io

    frame = table(spark, d, "nation")
    pdf = frame.toPandas()
    held = io.BytesIO()
    pdf.to_parquet(held)
    out = None
    for name, source in (("path", f"{d}/nation.parquet"), ("frame", frame), ("pandas", pdf), ("bytes", held.getvalue())):
        part = samples.read(spark, source).agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


@query("normalise_impedance", "SELECT printf('B%04d', l_suppkey) AS Cell_ID, CAST(l_linenumber AS BIGINT) AS Cycle_Index, count(*) AS n, round(sum(CASE WHEN l_discount > 0 THEN l_discount::DOUBLE END), 7) AS re, count(CASE WHEN l_quantity <= 5 THEN 1 END) AS n_rct FROM lineitem GROUP BY ALL")
def normalise_impedance(spark, d):
    """Impedance as text, with values out of range and numbers that are none."""
    li = table(spark, d, "lineitem")
    raw = li.select(F.concat(F.lit(" b"), F.col("l_suppkey").cast("string")).alias("Cell_ID"), F.col("l_linenumber").cast("string").alias("Cycle_Index"), F.when(F.col("l_discount") > 0, F.col("l_discount").cast("string")).otherwise("none").alias("Re_ohm"), F.col("l_quantity").cast("double").cast("string").alias("Rct_ohm"))
    out = samples.normalise_impedance(raw, spark)
    return rounded(out.groupBy("Cell_ID", "Cycle_Index").agg(F.count("*").alias("n"), F.sum("Re_ohm").alias("re"), F.count("Rct_ohm").alias("n_rct")))


@query(
    "asof_static",
    """WITH s AS (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, value AS quota FROM events WHERE event_type = 'signup'), f AS (SELECT * FROM s WHERE until IS NULL OR until > since)
SELECT event_id, round(quota, 7) AS quota FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.since <= e.ts AND (f.until IS NULL OR e.ts < f.until)""",
)
def asof_static(spark, d):
    """Events with the value of the last signup of their user: a static table that a stream can be joined with as well."""
    e = windows.events(spark, d)
    static = windows.in_force(e.where("event_type = 'signup'").withColumnRenamed("value", "quota"))
    return rounded(windows.asof_static(e, static, "quota").select("event_id", "quota"))


# --- beyond SQL: tested against brute force ---------------------------------------------------------------------------

FEATURES = ["k", "R0", "Re_ohm", "Rct_ohm", "T_rise", "T_mean", "V_mean", "I_mean", "ambient"]


@query("grouped_cv_ridge")
def grouped_cv_ridge(spark, d):
    out = learning.grouped_cv(staged(datasets.soh_dataset(health_table(spark, d)), "soh"), FEATURES, "soh")
    return rounded(out.select("cell", "k", "fold", "soh", "pred", "std"), 5)


@query("nested_cv")
def nested_cv(spark, d):
    out = learning.tuned_cv(staged(datasets.soh_dataset(health_table(spark, d)), "soh"), FEATURES, "soh")
    return rounded(learning.cv_summary(out, "soh", ("fold", "shape")).withColumn("shape", F.col("shape").cast("string")), 5)


@query("extra_trees_cv")
def extra_trees_cv(spark, d):
    out = trees.tree_cv(staged(datasets.soh_dataset(health_table(spark, d)), "soh"), FEATURES, "soh")
    return rounded(out.select("cell", "k", "fold", "soh", "pred"), 5)


@query("boosted_fade")
def boosted_fade(spark, d):
    """Health at each origin's horizon from a boosted model (40 rounds) of the loss that other folds' cells have taught."""
    out = boosting.boosted_cv(staged(datasets.fade_dataset(kept_health(spark, d)), "fade"), list(datasets.FADE_FEATURES), "target", rate=0.15, leaves=8, rounds=40)
    ahead = out.withColumn("soh_pred", F.col("soh_now") - F.col("pred") * F.col("horizon") / 100)
    return rounded(ahead.select("cell", "k0", "fold", "target", F.col("pred").alias("rate_pred"), "soh_pred", "soh_future"), 5)


@query("hi_selection")
def hi_selection(spark, d):
    """Indicators that are chosen one by one for their error on left-out cells, of all that the table has."""
    g = datasets.relative(health_table(spark, d).where(~F.col("outlier")), HIS)
    path, verdict = selection.select_indicators(staged(g.select("cell", "soh", *HIS), "indicators"), HIS)
    return spark.createDataFrame([(i + 1, c, float(e), verdict) for i, (c, e) in enumerate(path)], "step int, added string, loco_rmse double, verdict string")


@query("measurement_ranking")
def measurement_ranking(spark, d):
    """Measurements by what they alone tell of health, and in which step each is worth adding."""
    t = datasets.relative(datasets.soh_dataset(health_table(spark, d)), ["T_rise"])
    single, path = selection.rank_measurements(staged(t, "soh"))
    added = {n: i + 1 for i, (n, _) in enumerate(path)}
    return spark.createDataFrame([(n, e, cells, g, added.get(n)) for n, e, cells, g in single], "measurement string, rmse double, n_cells long, gain double, step int")


@query("permutation_importance")
def permutation_importance(spark, d):
    return rounded(learning.permutation_importance(staged(datasets.soh_dataset(health_table(spark, d)), "soh"), FEATURES, "soh"), 5)


#: Rows of the health table that a task of the study gets, about: each becomes 16, one for each model and horizon.
STUDY_ROWS = 25_000


@query("cohort_metrics")
def cohort_metrics(spark, d):
    h = kept_health(spark, d, "cell", "grp", "k", "soh", "outlier", "bol", rows=STUDY_ROWS)
    t = h.withColumns({"soh_clean": F.when(~F.col("outlier"), F.col("soh")), "eol_soh": 1.4 / F.col("bol")})
    return rounded(cohort.run(t)["metrics"], 5)
