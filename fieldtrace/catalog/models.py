"""Group models, residuals, weights and site weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.catalog.places import km
from fieldtrace.functions.time import winter
from fieldtrace.operators import mixed, models

_R = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@query("M1 M3", """
SELECT sp, n, ROUND(p, 6) AS fit, ROUND(SQRT(p * (1 - p) / w), 6) AS se_fit, ROUND(p - 1.96 * SQRT(p * (1 - p) / w), 6) AS conf_fit_low,
  ROUND(p + 1.96 * SQRT(p * (1 - p) / w), 6) AS conf_fit_high FROM (SELECT sp, COUNT(*) AS n, SUM(wgt_co) AS w,
  SUM(wgt_co * mig) / SUM(wgt_co) AS p FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp) x""")
def migration_probability(t):
    fit = models.group_fit(t.seasonal_orders, "sp", "mig", "wgt_co", "binomial")
    return fit.select("sp", "n", *_R("fit", "se_fit", "conf_fit_low", "conf_fit_high"))


@query("M1", """
WITH s AS (SELECT sp, SUM(wgt_co) AS w, SUM(wgt_co * mig) / SUM(wgt_co) AS p FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp),
l AS (SELECT sp, LN(p / (1 - p)) AS link, 1 / (w * p * (1 - p)) AS v FROM s), b AS (SELECT * FROM l WHERE sp = 'AYTFER')
SELECT '(Intercept)' AS term, ROUND(link, 6) AS estimate, ROUND(SQRT(v), 6) AS std_error FROM b
UNION ALL SELECT 'sp' || l.sp, ROUND(l.link - b.link, 6), ROUND(SQRT(l.v + b.v), 6) FROM l, b WHERE l.sp <> 'AYTFER'""")
def migration_coefficients(t):
    fit = models.group_fit(t.seasonal_orders, "sp", "mig", "wgt_co", "binomial")
    return models.coefficients(fit, "sp").select("term", *_R("estimate", "std_error"))


_GAMMA = """
WITH m AS (SELECT sp, COUNT(*) AS n, SUM(wgt_co) AS w, SUM(wgt_co * dist_pt_km) / SUM(wgt_co) AS mu FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp),
d AS (SELECT SUM(s.wgt_co * POW((s.dist_pt_km - m.mu) / m.mu, 2)) / (COUNT(*) - 2) AS disp FROM {seasonal_orders} s JOIN m ON s.sp = m.sp)"""


@query("M2 M3", _GAMMA + """
SELECT sp, n, ROUND(mu, 4) AS fit, ROUND(mu * SQRT(disp / w), 4) AS se_fit, ROUND(mu - 1.96 * mu * SQRT(disp / w), 4) AS conf_fit_low,
  ROUND(mu + 1.96 * mu * SQRT(disp / w), 4) AS conf_fit_high, ROUND(LN(mu), 6) AS link, ROUND(SQRT(disp / w), 6) AS se_link,
  ROUND(disp, 6) AS dispersion FROM m, d""")
def migration_distance(t):
    fit = models.group_fit(t.seasonal_orders, "sp", "dist_pt_km", "wgt_co", "gamma")
    four = [F.round(c, 4).alias(c) for c in ("fit", "se_fit", "conf_fit_low", "conf_fit_high")]
    return fit.select("sp", "n", *four, *_R("link", "se_link", "dispersion"))


@query("M5 F19", """
SELECT id, name, ROUND(value, 6) AS value FROM (SELECT id, 1 / a AS link, (a - m) / m AS std_res,
    SIGN(a - m) * SQRT(GREATEST(0, 2 * ((a - m) / m - LN(a / m)))) AS mod_res_dev, (a - m) AS mod_res_res,
    -(a - m) / (m * m) * 1e6 AS mod_res_work, (a - m) / m AS mod_res_per
  FROM (SELECT id, dist_pt_km / 1000 AS a, (SELECT AVG(dist_pt_km / 1000) FROM {seasonal_orders}) AS m FROM {seasonal_orders}) x) y
UNPIVOT (value FOR name IN (link, std_res, mod_res_dev, mod_res_res, mod_res_work, mod_res_per))""")
def gamma_residuals(t):
    a = F.col("dist_pt_km") / 1000
    mean = t.seasonal_orders.agg(F.avg(a).alias("m")).scalar()
    rows = t.seasonal_orders.select("id", a.alias("a")).withColumn("m", mean)
    r = models.residuals("a", "m", "gamma")
    wide = rows.select("id", (1 / F.col("a")).alias("link"), r["std_res"].alias("std_res"), r["deviance"].alias("mod_res_dev"),
                       r["response"].alias("mod_res_res"), (r["working"] * 1e6).alias("mod_res_work"),
                       r["pearson"].alias("mod_res_per"))
    long = wide.unpivot(["id"], wide.columns[1:], "name", "value")
    return long.select("id", "name", F.round("value", 6).alias("value"))


@query("M5", """
WITH p AS (SELECT sp, SUM(wgt_co * mig) / SUM(wgt_co) AS p FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp)
SELECT s.id, ROUND(CASE WHEN mig = 1 THEN SQRT(-2 * wgt_co * LN(p)) ELSE -SQRT(-2 * wgt_co * LN(1 - p)) END, 6) AS deviance,
  ROUND(SQRT(wgt_co) * (mig - p) / SQRT(p * (1 - p)), 6) AS pearson FROM {seasonal_orders} s JOIN p ON s.sp = p.sp""")
def binomial_residuals(t):
    fit = models.group_fit(t.seasonal_orders, "sp", "mig", "wgt_co", "binomial").select("sp", "fit")
    rows = t.seasonal_orders.join(F.broadcast(fit), "sp")  # one row per model category
    r = models.residuals("mig", "fit", "binomial", "wgt_co")
    return rows.select("id", F.round(r["deviance"], 6).alias("deviance"), F.round(r["pearson"], 6).alias("pearson"))


@query("M6 A12", """
WITH q AS (SELECT QUANTILE_CONT(dist_pt_km, 0.25) AS lo, QUANTILE_CONT(dist_pt_km, 0.75) AS hi FROM {seasonal_orders})
SELECT id, dist_pt_km, ROUND((hi - lo) / (2 * 0.6744897501960817e0), 4) AS slope, ROUND((lo + hi) / 2, 4) AS intercept,
  (ROW_NUMBER() OVER (ORDER BY dist_pt_km, id) - 0.5) / COUNT(*) OVER () > 0.5 AS upper FROM {seasonal_orders}, q""")
def normal_plot_line(t):
    rows = models.normal_plot(t.seasonal_orders, "dist_pt_km", "id")
    return rows.select("id", "dist_pt_km", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                       (F.col("theoretical") > 1e-12).alias("upper"))


@query("M6")
def normal_plot_points(t):
    return models.normal_plot(t.seasonal_orders, "dist_pt_km", "id")


@query("M7 F21", """
SELECT sp, ROUND(CASE WHEN ATAN2(s, c) < 0 THEN ATAN2(s, c) + 2 * PI() ELSE ATAN2(s, c) END, 6) AS mu, ROUND(SQRT(s * s + c * c) / w, 6) AS resultant
FROM (SELECT sp, SUM(wgt_co) AS w, SUM(wgt_co * SIN(a)) AS s, SUM(wgt_co * COS(a)) AS c FROM (
  SELECT sp, wgt_co, RADIANS((id * 37) % 150 + 20e0) AS a FROM {seasonal_orders}) x GROUP BY sp) y""")
def mean_direction(t):
    rows = t.seasonal_orders.withColumn("angle", (F.col("id") * 37) % 150 + F.lit(20.0))
    return models.von_mises_fit(rows, "sp", "angle", "wgt_co").select("sp", *_R("mu", "resultant"))


def _directed(t):
    return t.seasonal_orders.where(F.col("sp").isNotNull()).withColumn("angle", (F.col("id") * 37) % 150 + F.lit(20.0))


# The ratio of Bessel functions as a sum over the circle; its inverse by halving an interval.
_CIRCLE = "LIST_TRANSFORM(RANGE(0, 720), lambda j: {0} * EXP((lo + hi) / 2 * (COS(j * PI() / 360) - 1)))"
_VON_MISES = """
WITH RECURSIVE m AS (SELECT sp, CASE WHEN ATAN2(s, c) < 0 THEN ATAN2(s, c) + 2 * PI() ELSE ATAN2(s, c) END AS mu, SQRT(s * s + c * c) / w AS r
  FROM (SELECT sp, SUM(wgt_co) AS w, SUM(wgt_co * SIN(a)) AS s, SUM(wgt_co * COS(a)) AS c
    FROM (SELECT sp, wgt_co, RADIANS((id * 37) % 150 + 20e0) AS a FROM {seasonal_orders} WHERE sp IS NOT NULL) x GROUP BY sp) y),
b AS (SELECT sp, r, 0e0 AS lo, 1000e0 AS hi, 0 AS i FROM m UNION ALL
  SELECT sp, r, CASE WHEN a < r THEN (lo + hi) / 2 ELSE lo END, CASE WHEN a < r THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, LIST_SUM(""" + _CIRCLE.format("COS(j * PI() / 360)") + ") / LIST_SUM(" + _CIRCLE.format("1") + """) AS a FROM b WHERE i < 60) z),
f AS (SELECT m.sp, mu, m.r AS resultant, (lo + hi) / 2 AS kappa FROM b JOIN m ON m.sp = b.sp WHERE i = 60)"""


@query("M7", _VON_MISES + " SELECT sp, ROUND(mu, 6) AS mu, ROUND(resultant, 6) AS resultant, ROUND(kappa, 6) AS kappa FROM f")
def von_mises_concentration(t):
    return models.von_mises_fit(_directed(t), "sp", "angle", "wgt_co").select("sp", *_R("mu", "resultant", "kappa"))


@query("M8 F16", _GAMMA + """, g AS (SELECT sp, mu / 1000 AS mu, disp, (i + 0.5) * 5e0 AS x FROM m, d, range(0, 400) r(i)),
y AS (SELECT sp, x, EXP((1 / disp - 1) * LN(x) - (1 / disp) * LN(disp * mu) - x / (disp * mu) - LGAMMA(1 / disp)) AS d FROM g)
SELECT sp, x, ROUND(d / (SUM(d) OVER (PARTITION BY sp) * 5), 9) AS density FROM y""")
def fitted_gamma_curve(t):
    rows = t.seasonal_orders.withColumn("km", F.col("dist_pt_km") / 1000)
    fit = models.group_fit(rows, "sp", "km", "wgt_co", "gamma")
    return models.gamma_curve(fit, "sp", 2000.0, 400).select("sp", "x", F.round("density", 9).alias("density"))


@query("M8", _VON_MISES + """
SELECT sp, x, ROUND(d / SUM(d) OVER (PARTITION BY sp), 9) AS density FROM (
  SELECT sp, k + 0.5e0 - 180 AS x, EXP(kappa * (COS(RADIANS(k + 0.5e0 - 180) - mu) - 1)) AS d FROM f, range(0, 360) q(k)) z""")
def fitted_von_mises_curve(t):
    curve = models.von_mises_curve(models.von_mises_fit(_directed(t), "sp", "angle", "wgt_co"), "sp", 360)
    return curve.select("sp", "x", F.round("density", 9).alias("density"))


@query("M11 A5 A13 W11 J2", """
WITH s AS (SELECT id, ring, nes_reg AS co, YEAR(datetime) - CASE WHEN MONTH(datetime) < 7 THEN 1 ELSE 0 END AS winter FROM {seasonal_orders}),
e AS (SELECT co, AVG(n) AS nobs_win FROM (SELECT ring, winter, co, COUNT(*) AS n FROM s GROUP BY ALL) x GROUP BY co)
SELECT id, ROUND(nobs_win, 6) AS nobs_win, ROUND(COUNT(*) OVER () / nobs_win / SUM(1 / nobs_win) OVER (), 6) AS wgt_co,
  ROUND(COUNT(*) OVER () * nobs_win / SUM(nobs_win) OVER (), 6) AS pres_co FROM s JOIN e USING (co)""")
def observation_pressure(t):
    rows = t.seasonal_orders.select("id", "ring", F.col("nes_reg").alias("co"), winter("datetime").alias("winter"))
    return models.pressure_weights(rows, "ring", "winter", "co").select("id", *_R("nobs_win", "wgt_co", "pres_co"))


_BINS = """
WITH q AS (SELECT QUANTILE_CONT(wb_area_ha, [0, 1/7e0, 2/7e0, 3/7e0, 4/7e0, 5/7e0, 6/7e0, 1]) AS q FROM {lineitem_price} WHERE status = 'occupied'),
d AS (SELECT 1 AS bin, 0e0 AS down UNION ALL SELECT CAST(i + 2 AS INT), q[i + 1] FROM q, range(0, 8) r(i)),
b AS (SELECT bin, down, COALESCE(LEAD(down) OVER (ORDER BY bin) - 1e-6, (SELECT MAX(wb_area_ha) + 1 FROM {lineitem_price})) AS up,
  CASE WHEN bin IN (1, 9) THEN 0 ELSE 1 END AS wgt FROM d)"""


@query("W10 U5 A12", _BINS + " SELECT bin, ROUND(down, 6) AS down, ROUND(up, 6) AS up, wgt FROM b")
def occupied_quantile_bins(t):
    p = t.lineitem_price
    b = models.occupied_bins(p.where(F.col("status") == "occupied"), p, "wb_area_ha")
    return b.select("bin", *_R("down", "up"), "wgt")


@query("M12 W12 J15", _BINS + """
SELECT id, l_linenumber, bin, wgt * 1e6 / COUNT(*) OVER (PARTITION BY bin) AS share FROM {lineitem_price} l JOIN b ON l.wb_area_ha >= b.down AND l.wb_area_ha <= b.up""")
def habitat_size_weights(t):
    p = t.lineitem_price
    bins = models.occupied_bins(p.where(F.col("status") == "occupied"), p, "wb_area_ha")
    h = models.habitat_weights(bins, p, "wb_area_ha")
    return h.select("id", "l_linenumber", "bin", (F.col("wgt_area") * 1e6).alias("share"))


@query("M13", """
SELECT sp, CASE WHEN k > 1 THEN 'n hivers' ELSE '1 hiver' END AS winters, COUNT(*) AS n FROM (
  SELECT ring, sp, COUNT(*) AS k FROM {seasonal_orders} WHERE MONTH(datetime) = 12 GROUP BY ring, sp) x GROUP BY 1, 2""")
def repeated_individuals(t):
    return models.repeat_summary(t.seasonal_orders.where(F.month("datetime") == 12), "ring", "sp")


def sites_and_water(t):
    """Nesting sites, lakes with their weights, and the model of the distances between them."""
    rows = t.seasonal_orders.withColumn("km", F.col("dist_pt_km") / 500)
    water = t.geo_suppliers.select("wb_id", "lon", "lat", (F.col("wb_area_ha") / 1000).alias("wgt_area"))
    return t.sites, water, models.group_fit(rows, "sp", "km", "wgt_co", "gamma")


SITE_SQL = f"""
m AS (SELECT sp, SUM(wgt_co * dist_pt_km / 500) / SUM(wgt_co) AS mu FROM {{seasonal_orders}} WHERE sp IS NOT NULL GROUP BY sp),
d AS (SELECT SUM(s.wgt_co * POW((s.dist_pt_km / 500 - m.mu) / m.mu, 2)) / (COUNT(*) - 2) AS disp FROM {{seasonal_orders}} s JOIN m ON s.sp = m.sp),
w AS (SELECT site_id, s.sp, wb_id, n_lon, n_lat, lon, lat, wb_area_ha / 1000 AS wgt_area, {km('n_lon', 'n_lat', 'lon', 'lat')} AS dist_km, mu, disp
  FROM {{sites}} s JOIN m ON s.sp = m.sp, d, {{geo_suppliers}}),
c AS (SELECT site_id, sp, wb_id, dist_km, DEGREES(ATAN2(COS(RADIANS(lat)) * SIN(RADIANS(lon - n_lon)), COS(RADIANS(n_lat)) * SIN(RADIANS(lat))
    - SIN(RADIANS(n_lat)) * COS(RADIANS(lat)) * COS(RADIANS(lon - n_lon)))) AS angle_deg, DEGREES(ATAN2(lon - n_lon, lat - n_lat)) AS angle_deg_base,
  CASE WHEN dist_km > 0 THEN wgt_area * EXP((1 / disp - 1) * LN(dist_km) - (1 / disp) * LN(disp * mu) - dist_km / (disp * mu) - LGAMMA(1 / disp)) ELSE 0 END AS wgt FROM w)"""


@query("M9 J17 G1 G2", "WITH " + SITE_SQL + """
SELECT site_id, sp, wb_id, ROUND(dist_km, 6) AS dist_km, ROUND(angle_deg, 6) AS angle_deg, ROUND(angle_deg_base, 6) AS angle_deg_base, ROUND(wgt, 9) AS wgt FROM c""")
def site_weights(t):
    return models.site_weights(*sites_and_water(t)).select("site_id", "sp", "wb_id", *_R("dist_km", "angle_deg", "angle_deg_base"), F.round("wgt", 9).alias("wgt"))


@query("M4")
def random_intercept_migration(t):
    return mixed.random_intercept_fit(t.seasonal_orders, "sp", "ring", "mig", "wgt_co", "binomial")


@query("M4")
def random_intercept_distance(t):
    return mixed.random_intercept_fit(t.seasonal_orders, "sp", "ring", "dist_pt_km", "wgt_co", "gamma")


def _at_half(t, y, family):
    """Links of the model without random intercepts, and a spread of 0.5, to look at the random-intercept model at."""
    fit = models.group_fit(t.seasonal_orders, "sp", y, "wgt_co", family)
    return t.seasonal_orders, fit.select("sp", "link", F.lit(0.5).alias("sigma"), "dispersion")


def _newton(y: str, parameters: str, family: str) -> str:
    """Modes of the intercepts by 40 clipped steps; slope and curvature are those of the log likelihood."""
    slope, bend = {"binomial": ("swy - sw / (1 + EXP(-eta0 - b))", "sw * EXP(-eta0 - b) / POW(1 + EXP(-eta0 - b), 2)"),
                   "gamma": ("(swy * EXP(-eta0 - b) - sw) / disp", "swy * EXP(-eta0 - b) / disp")}[family]
    return f"""WITH RECURSIVE {parameters},
s AS (SELECT sp, ring, SUM(wgt_co) AS sw, SUM(wgt_co * {y}) AS swy FROM {{seasonal_orders}} WHERE sp IS NOT NULL GROUP BY sp, ring),
it AS (SELECT s.*, eta0, disp, 0e0 AS b, 0 AS k FROM s JOIN m ON s.sp = m.sp
  UNION ALL SELECT sp, ring, sw, swy, eta0, disp, b + GREATEST(-2, LEAST(2, ({slope} - 4 * b) / ({bend} + 4))), k + 1 FROM it WHERE k < 40),
e AS (SELECT *, eta0 + b AS eta, {bend} AS bend FROM it WHERE k = 40)"""


_LOGIT = """m AS (SELECT sp, LN(p / (1 - p)) AS eta0, 1e0 AS disp FROM (SELECT sp, SUM(wgt_co * mig) / SUM(wgt_co) AS p
  FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp) x)"""
_LOG = """u AS (SELECT sp, SUM(wgt_co * dist_pt_km) / SUM(wgt_co) AS mu FROM {seasonal_orders} WHERE sp IS NOT NULL GROUP BY sp),
m AS (SELECT u.sp, LN(mu) AS eta0, disp FROM u, (SELECT SUM(s.wgt_co * POW((s.dist_pt_km - u.mu) / u.mu, 2)) / (COUNT(*) - 2) AS disp
  FROM {seasonal_orders} s JOIN u ON s.sp = u.sp) d)"""


@query("M4", "SELECT * FROM (" + _newton("mig", _LOGIT, "binomial") + """
SELECT 'mig' AS model, sp, ROUND(SUM(swy * eta - sw * LN(1 + EXP(eta)) - 2 * b * b - 0.5 * LN(1 + bend / 4)), 3) AS log_likelihood FROM e GROUP BY sp) x
UNION ALL SELECT * FROM (""" + _newton("dist_pt_km", _LOG, "gamma") + """
SELECT 'dist_pt_km' AS model, sp, ROUND(SUM(-(swy * EXP(-eta) + sw * eta) / disp - 2 * b * b - 0.5 * LN(1 + bend / 4)), 3) AS log_likelihood FROM e GROUP BY sp) y""")
def random_intercept_likelihood(t):
    out = []
    for y, family in (("mig", "binomial"), ("dist_pt_km", "gamma")):
        rows, at = _at_half(t, y, family)
        value = mixed.marginal_likelihood(rows, at, "sp", "ring", y, "wgt_co", family)
        out.append(value.select(F.lit(y).alias("model"), "sp", F.round("log_likelihood", 3).alias("log_likelihood")))
    return out[0].unionByName(out[1])


@query("M4", _newton("mig", _LOGIT, "binomial") + """
SELECT sp, ring, ROUND(b, 6) AS mode, ROUND(1 / SQRT(bend + 4), 6) AS mode_sd FROM e""")
def random_intercept_modes(t):
    rows, at = _at_half(t, "mig", "binomial")
    return mixed.conditional_modes(rows, at, "sp", "ring", "mig", "wgt_co", "binomial").select("sp", "ring", *_R("mode", "mode_sd"))


@query("M4 M5", _newton("dist_pt_km", _LOG, "gamma") + """
SELECT o.id, ROUND(b, 6) AS mode, ROUND(EXP(eta) / 1000, 6) AS fitted,
  ROUND(SIGN(dist_pt_km - EXP(eta)) * SQRT(wgt_co * GREATEST(0, 2 * ((dist_pt_km - EXP(eta)) / EXP(eta) - LN(dist_pt_km / EXP(eta))))), 6) AS deviance,
  ROUND(SQRT(wgt_co) * (dist_pt_km - EXP(eta)) / EXP(eta), 6) AS pearson
FROM {seasonal_orders} o LEFT JOIN e ON o.sp = e.sp AND o.ring = e.ring""")
def random_intercept_rows(t):
    rows, at = _at_half(t, "dist_pt_km", "gamma")
    found = mixed.conditional_rows(rows, at, "sp", "ring", "dist_pt_km", "wgt_co", "gamma")
    return found.select("id", F.round("mode", 6).alias("mode"), F.round(F.col("fitted") / 1000, 6).alias("fitted"), *_R("deviance", "pearson"))
