"""Weighted group models from one pass of sufficient statistics, residuals and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.geo import bearing, distance_km, full_turn_radians, planar_bearing
from fieldtrace.functions.special import gamma_density, normal_quantile, von_mises_kappa
from fieldtrace.operators.joins import range_lookup, union_all
from fieldtrace.operators.keyed import ROWS, add_count, attach_per_key
from fieldtrace.operators.ranks import quantiles, row_numbers


def group_fit(df: DataFrame, group: str, y: str, weight: str, family: str) -> DataFrame:
    """Weighted GLM with one categorical predictor: fitted mean, standard error and interval.

    ``family`` is binomial (logit link) or gamma (log link).  With one category per row the
    likelihood equations are solved by the weighted group means; the dispersion of the gamma
    family is the Pearson statistic over its degrees of freedom, common to all groups.  Rows
    without a group, value or weight do not take part; rows of weight 0 add no degree of freedom.
    A binomial category with no or only successes has no finite link: its link and standard error
    are missing and its interval is the point itself.  A category of weight 0 has no fit, and
    without a degree of freedom there is no dispersion and no standard error.
    """
    y_, w = F.col(y).cast("double"), F.col(weight).cast("double")
    used = df.where(F.col(group).isNotNull() & y_.isNotNull() & w.isNotNull())
    sums = used.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w != 0).alias("_n"), F.sum(w).alias("w"), F.sum(w * y_).alias("wy"), F.sum(w * y_ * y_).alias("wyy"))
    rows = sums.withColumn("fit", F.try_divide("wy", "w"))
    fit = F.col("fit")
    if family == "binomial":
        out = rows.withColumns({
            "dispersion": F.lit(1.0), "link": F.log(F.try_divide(fit, 1 - fit)),
            "se_link": F.try_divide(F.lit(1.0), F.sqrt(F.col("w") * fit * (1 - fit))), "se_fit": F.sqrt(F.try_divide(fit * (1 - fit), F.col("w")))})
    elif family == "gamma":
        chi = F.try_divide(F.col("wyy"), fit * fit) - 2 * F.try_divide(F.col("wy"), fit) + F.col("w")
        free = F.sum(F.when(fit.isNotNull(), F.col("_n"))) - F.count(fit)
        disp = rows.agg(F.try_divide(F.sum(chi), free).alias("d")).scalar()
        out = rows.withColumn("dispersion", disp).withColumns({
            "link": F.log("fit"), "se_link": F.sqrt(F.try_divide("dispersion", "w")),
            "se_fit": F.col("fit") * F.sqrt(F.try_divide("dispersion", "w"))})
    else:
        raise ValueError(f"unknown family {family}")
    half = 1.96 * F.col("se_fit")
    return out.select(group, "n", "w", "fit", "se_fit", (F.col("fit") - half).alias("conf_fit_low"),
                      (F.col("fit") + half).alias("conf_fit_high"), "link", "se_link", "dispersion")


def coefficients(fit: DataFrame, group: str) -> DataFrame:
    """Treatment contrasts of ``group_fit``: the first category and each difference to it."""
    base = fit.agg(F.min(F.struct(group, "link", "se_link")).alias("b")).scalar()
    first = F.col(group) == base[group]
    return fit.select(
        F.when(first, F.lit("(Intercept)")).otherwise(F.concat(F.lit(group), F.col(group))).alias("term"),
        F.when(first, F.col("link")).otherwise(F.col("link") - base["link"]).alias("estimate"),
        F.when(first, F.col("se_link")).otherwise(
            F.sqrt(F.col("se_link") * F.col("se_link") + base["se_link"] * base["se_link"])).alias("std_error"))


def residuals(y, mean, family: str, weight=None, link: str | None = None) -> dict[str, Column]:
    """Deviance, response, working and Pearson residuals and the standardised value."""
    y, m = F.col(y).cast("double"), F.col(mean)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sign = F.signum(y - m)
    if family == "gamma":
        deviance = sign * F.sqrt(w * F.greatest(F.lit(0.0), 2 * ((y - m) / m - F.log(y / m))))
        pearson = F.sqrt(w) * (y - m) / m
        working = (y - m) / m if link == "log" else -(y - m) / (m * m)
    else:
        loss = F.when(y > 0, y * F.log(y / m)).otherwise(F.lit(0.0)) + F.when(
            y < 1, (1 - y) * F.log((1 - y) / (1 - m))).otherwise(F.lit(0.0))
        deviance = sign * F.sqrt(w * F.greatest(F.lit(0.0), 2 * loss))
        pearson = F.sqrt(w) * (y - m) / F.sqrt(m * (1 - m))
        working = (y - m) / (m * (1 - m))
    return {"deviance": deviance, "response": y - m, "working": working, "pearson": pearson, "std_res": (y - m) / m}


def normal_plot(df: DataFrame, value: str, uid: str) -> DataFrame:
    """Normal quantile of each row's rank, and the line through the quartiles."""
    rows = df.where(F.col(value).isNotNull()).select(uid, value)
    ranked = row_numbers(rows, [], [value, uid], "_i")
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    theoretical = normal_quantile((F.col("_i") - a) / (n + 1 - 2 * a))
    q = quantiles(rows, [], value, [0.25, 0.75]).agg(
        F.struct(F.min("quantile").alias("lo"), F.max("quantile").alias("hi")).alias("q")).scalar()
    z = normal_quantile(F.lit(0.75))
    slope = (q["hi"] - q["lo"]) / (2 * z)
    return ranked.select(uid, value, theoretical.alias("theoretical"), slope.alias("slope"),
                         ((q["lo"] + q["hi"]) / 2).alias("intercept"))


def von_mises_fit(df: DataFrame, group: str, angle_deg: str, weight: str) -> DataFrame:
    """Weighted maximum likelihood of mean direction (0 to 2 pi) and concentration per group; weight 0 has no concentration."""
    a, w = full_turn_radians(angle_deg), F.col(weight)
    sums = df.groupBy(group).agg(F.sum(w).alias("w"), F.sum(w * F.sin(a)).alias("s"), F.sum(w * F.cos(a)).alias("c"))
    mu = F.atan2("s", "c")
    r = F.try_divide(F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")), F.col("w"))
    told = r.isNotNull()
    return sums.select(group, F.when(told, F.when(mu < 0, mu + 2 * F.pi()).otherwise(mu)).alias("mu"), r.alias("resultant"),
                       F.when(told, von_mises_kappa(r)).alias("kappa"))


def gamma_curve(fit: DataFrame, group: str, cut: float, points: int) -> DataFrame:
    """Fitted gamma density on a grid below ``cut``, scaled to a share of 1 there."""
    step = cut / points
    x = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (i + F.lit(0.5)) * step)
    grid = fit.select(group, "fit", "dispersion", F.explode(x).alias("x"))
    curve = grid.withColumn("_d", gamma_density("x", 1 / F.col("dispersion"), 1 / (F.col("dispersion") * F.col("fit"))))
    whole = Window.partitionBy(group)  # ``points`` rows per group
    return curve.select(group, "x", (F.col("_d") / (F.sum("_d").over(whole) * step)).alias("density"))


def von_mises_curve(fit: DataFrame, group: str, points: int) -> DataFrame:
    """Fitted von Mises density over -180..180 degrees, scaled to a share of 1."""
    step = 360.0 / points
    x = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: (i + F.lit(0.5)) * step - 180)
    grid = fit.select(group, "mu", "kappa", F.explode(x).alias("x"))
    curve = grid.withColumn("_d", F.exp(F.col("kappa") * (F.cos(F.radians("x") - F.col("mu")) - 1)))
    whole = Window.partitionBy(group)
    return curve.select(group, "x", (F.col("_d") / (F.sum("_d").over(whole) * step)).alias("density"))


def pressure_weights(df: DataFrame, individual: str, winter: str, country: str) -> DataFrame:
    """Weight of each row against and along the observation effort of its country.

    Effort is the mean number of sightings per individual and winter.  A missing country is a
    country of its own; both weights add up to the number of rows.
    """
    counts = df.groupBy(individual, winter, country).agg(F.count(F.lit(1)).alias("n"))
    effort = counts.groupBy(country).agg(F.avg("n").alias("nobs_win"), F.sum("n").alias("rows"))
    whole = effort.agg(F.struct(
        F.sum("rows").alias("nb"), F.sum(F.col("rows") / F.col("nobs_win")).alias("inv"),
        F.sum(F.col("rows") * F.col("nobs_win")).alias("dir")).alias("t")).scalar()
    per = effort.select(F.col(country).alias("_co"), F.col("rows").alias("_rows"), "nobs_win",
                        (whole["nb"] / F.col("nobs_win") / whole["inv"]).alias("wgt_co"),
                        (whole["nb"] * F.col("nobs_win") / whole["dir"]).alias("pres_co"))
    per = per.withColumnsRenamed({"_co": country, "_rows": ROWS})
    return attach_per_key(df, per, [country], "left")


def occupied_bins(occupied: DataFrame, everything: DataFrame, value: str, parts: int = 7) -> DataFrame:
    """Quantile bins of the occupied values, with an empty bin below and above.

    A bin ends 1e-6 before the next one starts; the last ends one above the largest value.
    """
    q = quantiles(occupied, [], value, [k / parts for k in range(parts + 1)]).select(
        (F.col("q_id") + 2).alias("bin"), F.col("quantile").alias("down"))
    zero = q.sparkSession.createDataFrame([(1, 0.0)], "bin int, down double")
    top = everything.agg(F.max(value).alias("m")).scalar()
    after = Window.orderBy("bin")  # parts + 2 rows
    bins = union_all(zero, q).withColumn("up", F.coalesce(F.lead("down").over(after) - 1e-6, top + 1))
    return bins.withColumn("wgt", F.when((F.col("bin") == 1) | (F.col("bin") == parts + 2), 0).otherwise(1))


def habitat_weights(bins: DataFrame, everything: DataFrame, value: str) -> DataFrame:
    """Each row's bin and its equal share of the weight of the bin; a few bins, looked up in one array."""
    placed = range_lookup(everything, value, bins, "down", "up")
    return add_count(placed, ["bin"], "n").withColumn("wgt_area", F.col("wgt") / F.col("n"))


def repeat_summary(df: DataFrame, individual: str, group: str) -> DataFrame:
    """Individuals with one and with several records, per group."""
    counts = df.groupBy(individual, group).agg(F.count(F.lit(1)).alias("k"))
    label = F.when(F.col("k") > 1, "n hivers").otherwise("1 hiver")
    return counts.groupBy(group, label.alias("winters")).agg(F.count(F.lit(1)).alias("n"))


def site_weights(sites: DataFrame, water: DataFrame, fit: DataFrame, group: str = "sp", block: int = 64) -> DataFrame:
    """Distance, direction and weight of every water body as seen from every site.

    The result has one row per site and water body, which is what the draws need.  Sites are
    filed in blocks of about ``block`` and each water body visits every block, so both sides are
    spread over tasks whatever their sizes.
    """
    models = fit.select(group, (1 / F.col("dispersion")).alias("_shape"),
                        (1 / (F.col("dispersion") * F.col("fit"))).alias("_rate"))
    n_sites = sites.agg(F.count(F.lit(1)).alias("n")).scalar()
    blocks = F.greatest(F.lit(1), F.ceil(n_sites / block)).cast("int")
    placed = sites.join(models, group, "left").withColumn("_block", F.pmod(F.xxhash64("site_id"), blocks).cast("int"))
    visits = water.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = visits.join(placed, "_block")
    d = distance_km("n_lon", "n_lat", "lon", "lat")
    return pairs.withColumn("dist_km", d).select(
        "site_id", group, "wb_id", "dist_km",
        bearing("n_lon", "lon", "n_lat", "lat").alias("angle_deg"),
        planar_bearing("n_lon", "lon", "n_lat", "lat").alias("angle_deg_base"),
        (F.col("wgt_area") * gamma_density("dist_km", "_shape", "_rate")).alias("wgt"))
