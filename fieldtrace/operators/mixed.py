"""Random-intercept models: fit, conditional modes, predictions and residuals.

Rows are reduced to sufficient statistics per individual, and individuals with equal statistics to one row with a count.
An individual's marginal likelihood depends on two numbers only, the intercept of its group and the spread of the
random intercepts.  So a round evaluates it at nine points around the present ones, adds up per group, and Newton's step
follows from a bordered system: each group has its own diagonal entry, the spread is the border, and its Schur complement
is a sum over the groups.  Intercepts stay in a table with one row per group; the driver sees one row of sums a round.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.operators.models import group_fit, residuals
from fieldtrace.sources.store import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Distance of the points that slopes and curvatures are taken from.
_REACH = 1e-3
_STENCIL = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _terms(b, sw, swy, eta0, family: str, dispersion: float):
    """Log likelihood up to a constant, its slope and its negative curvature at the intercepts ``b``."""
    eta = eta0 + b
    if family == "binomial":
        p = 1 / (1 + np.exp(-eta))
        return swy * eta - sw * np.logaddexp(0, eta), swy - sw * p, sw * p * (1 - p)
    scaled = swy * np.exp(-eta)
    return -(scaled + sw * eta) / dispersion, (scaled - sw) / dispersion, scaled / dispersion


def modes(sw, swy, eta0, sigma, family: str, dispersion: float = 1.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Most likely intercept of each individual and the negative curvature of its log likelihood there.

    The target is concave, so the clipped steps end; raises if ``steps`` are not enough.
    """
    b = np.zeros_like(sw)
    for _ in range(steps):
        _, slope, bend = _terms(b, sw, swy, eta0, family, dispersion)
        step = np.clip((slope - b / sigma**2) / (bend + 1 / sigma**2), -2, 2)
        b = b + step
        if np.abs(step).max(initial=0) < 1e-9:
            return b, _terms(b, sw, swy, eta0, family, dispersion)[2]
    raise ArithmeticError("the intercepts of the individuals did not settle")


def marginal_terms(sw, swy, eta0, sigma, family: str, dispersion: float = 1.0, nodes: int = 1) -> np.ndarray:
    """Log marginal likelihood of each individual up to a constant, by quadrature around its mode.

    One node is the Laplace approximation; more nodes follow the curve of the likelihood beside the mode.
    """
    b, bend = modes(sw, swy, eta0, sigma, family, dispersion)
    points, weights = np.polynomial.hermite.hermgauss(nodes)
    wide = np.sqrt(2.0 / (bend + 1 / sigma**2))
    parts = []
    for x, w in zip(points, weights):
        at = b + wide * x
        parts.append(_terms(at, sw, swy, eta0, family, dispersion)[0] - 0.5 * (at / sigma) ** 2 + x * x + np.log(w))
    return np.logaddexp.reduce(parts, axis=0) + np.log(wide) - 0.5 * np.log(2 * np.pi * sigma**2)


def laplace_terms(sw, swy, eta0, sigma, family: str, dispersion: float = 1.0) -> np.ndarray:
    """``marginal_terms`` by mode and curvature alone."""
    return marginal_terms(sw, swy, eta0, sigma, family, dispersion, nodes=1)


def individual_sums(df: DataFrame, group: str, individual: str, y: str, weight: str) -> DataFrame:
    """Weight and weighted value of each individual in each group; rows without a group, value or weight do not count."""
    w, v = F.col(weight).cast("double"), F.col(y).cast("double")
    used = df.where(F.col(group).isNotNull() & v.isNotNull() & w.isNotNull())
    return used.groupBy(group, individual).agg(F.sum(w).alias("sw"), F.sum(w * v).alias("swy"))


def marginal_likelihood(df: DataFrame, fit: DataFrame, group: str, individual: str, y: str, weight: str, family: str, nodes: int = 1) -> DataFrame:
    """Log likelihood per group, up to a constant, at the link, sigma and dispersion of each group in ``fit``."""
    sums = individual_sums(df, group, individual, y, weight).groupBy(group, "sw", "swy").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = sums.join(fit.select(group, "link", "sigma", "dispersion"), group)

    def batch(frames):
        for pdf in frames:
            sw, swy, link, sigma, dispersion = (pdf[c].to_numpy() for c in ("sw", "swy", "link", "sigma", "dispersion"))
            value = marginal_terms(sw, swy, link, sigma, family, dispersion, nodes)
            yield pd.DataFrame({group: pdf[group], "value": pdf["n"] * value})

    schema = T.StructType([df.schema[group], T.StructField("value", T.DoubleType())])
    return table.mapInPandas(batch, schema).groupBy(group).agg(F.sum("value").alias("log_likelihood"))


def conditional_modes(df: DataFrame, fit: DataFrame, group: str, individual: str, y: str, weight: str, family: str) -> DataFrame:
    """Mode of each individual's intercept, and its conditional standard deviation, at the parameters of ``fit``.

    A group without a finite link has no modes.
    """
    table = individual_sums(df, group, individual, y, weight).join(
        fit.where(F.col("link").isNotNull()).select(group, "link", "sigma", "dispersion"), group)

    def batch(frames):
        for pdf in frames:
            b, bend = modes(pdf["sw"].to_numpy(), pdf["swy"].to_numpy(), pdf["link"].to_numpy(), pdf["sigma"].to_numpy(), family, pdf["dispersion"].to_numpy())
            yield pd.DataFrame({group: pdf[group], individual: pdf[individual], "mode": b, "mode_sd": 1 / np.sqrt(bend + 1 / pdf["sigma"].to_numpy() ** 2)})

    number = [T.StructField(c, T.DoubleType()) for c in ("mode", "mode_sd")]
    return table.mapInPandas(batch, T.StructType([df.schema[group], df.schema[individual], *number]))


def conditional_rows(df: DataFrame, fit: DataFrame, group: str, individual: str, y: str, weight: str, family: str) -> DataFrame:
    """The rows with the prediction of their individual, on the link and the response scale, and their residuals.

    Adds mode, eta, fitted, deviance, response, working, pearson.  Rows without a group, value or weight, or of a group
    without a finite link, keep missing values there.  Joins meet one row per individual.
    """
    mode = conditional_modes(df, fit, group, individual, y, weight, family)
    eta = mode.join(fit.select(group, "link"), group).select(
        F.col(group).alias("_group"), F.col(individual).alias("_individual"), "mode", (F.col("link") + F.col("mode")).alias("eta"))
    on = (F.col(group) == F.col("_group")) & F.col(individual).eqNullSafe(F.col("_individual"))
    back = 1 / (1 + F.exp(-F.col("eta"))) if family == "binomial" else F.exp("eta")
    rows = df.join(eta, on, "left").drop("_group", "_individual").withColumn("fitted", back)
    told = F.col(y).isNotNull() & F.col(weight).isNotNull()
    found = residuals(y, "fitted", family, weight, link="log" if family == "gamma" else None)
    return rows.withColumns({k: F.when(told, found[k]) for k in ("deviance", "response", "working", "pearson")})


def random_intercept_fit(df: DataFrame, group: str, individual: str, y: str, weight: str, family: str, nodes: int = 1,
                         max_rounds: int = 100) -> DataFrame:
    """Fitted value per group at a random intercept of zero, and the spread of the intercepts.

    ``family`` is binomial (logit) or gamma (log link, dispersion of the model without random intercepts).  Returns
    group, link, fit, se_link, sigma, dispersion, log_likelihood (of the group, up to a constant), separated.  ``se_link``
    comes from the information that is left when the individuals' intercepts are eliminated.

    A binomial group with no or only successes has no finite link and says nothing of the spread: it is marked
    ``separated``, its fit is 0 or 1.  An individual that is seen in several groups counts as one in each.  No usable
    rows give no rows.  Raises if the likelihood still grows after ``max_rounds``.
    """
    start = staged(group_fit(df, group, y, weight, family).select(group, "fit", "link", "dispersion"))
    found = start.where(F.col("link").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max("dispersion").alias("d")).first()
    dispersion = 1.0 if family == "binomial" else found["d"]
    if not found["n"] or dispersion is None or not dispersion > 0:  # nothing to fit, or no spread that could be told from none
        return start.select(group, "link", "fit", *[F.lit(None).cast("double").alias(c) for c in ("se_link", "sigma")], "dispersion",
                            F.lit(None).cast("double").alias("log_likelihood"), F.col("link").isNull().alias("separated"))
    sums = individual_sums(df, group, individual, y, weight).join(start.where(F.col("link").isNotNull()).select(group), group)
    table = staged(sums.groupBy(group, "sw", "swy").agg(F.count(F.lit(1)).cast("double").alias("n")))
    names = [f"f{k}" for k in range(9)]

    def around(place: DataFrame, log_sigma: float) -> DataFrame:
        """Per group its link and the likelihood at nine points around it."""
        def batch(frames):
            for pdf in frames:
                sw, swy, n, link = (pdf[c].to_numpy(float) for c in ("sw", "swy", "n", "link"))
                values = {name: n * marginal_terms(sw, swy, link + i * _REACH, np.exp(log_sigma + j * _REACH), family, dispersion, nodes)
                          for name, (i, j) in zip(names, _STENCIL)}
                b, bend = modes(sw, swy, link, np.exp(log_sigma), family, dispersion)
                values["info"] = n * bend / (1 + bend * np.exp(2 * log_sigma))
                yield pd.DataFrame({group: pdf[group], **values})

        schema = T.StructType([df.schema[group], *[T.StructField(c, T.DoubleType()) for c in (*names, "info")]])
        added = table.join(place, group).mapInPandas(batch, schema).groupBy(group).agg(*[F.sum(c).alias(c) for c in (*names, "info")])
        return staged(added.join(place.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g")).drop("_g"))

    f = {p: F.col(n) for p, n in zip(_STENCIL, names)}
    h = F.lit(_REACH)
    slope = (f[1, 0] - f[-1, 0]) / (2 * h)
    bend = F.greatest(-(f[1, 0] + f[-1, 0] - 2 * f[0, 0]) / (h * h), F.lit(1e-9))  # the likelihood is concave in the link near its top
    cross = (f[1, 1] - f[1, -1] - f[-1, 1] + f[-1, -1]) / (4 * h * h)
    log_sigma, best, here = float(np.log(0.5)), None, start.where(F.col("link").isNotNull()).select(group, "link")
    step_s = 0.0
    for _ in range(max_rounds):
        now = around(here, log_sigma)
        s = now.agg(F.sum(f[0, 0]).alias("value"), F.sum((f[0, 1] - f[0, -1]) / (2 * h)).alias("slope"),
                    F.sum((f[0, 1] + f[0, -1] - 2 * f[0, 0]) / (h * h)).alias("bend"),
                    F.sum(cross * cross / bend).alias("border"), F.sum(cross * slope / bend).alias("shift")).first()
        if best is not None and s["value"] <= best[0] + 1e-9 * (1 + abs(best[0])):
            if s["value"] >= best[0] - 1e-9 * (1 + abs(best[0])):
                break  # as good as before: the top
            share /= 2  # too far: half the way from the best place
            if share < 2**-12:
                break
        else:
            best, share = (s["value"], now, log_sigma), 1.0
            rest = abs(s["bend"] + s["border"])
            step_s = float(np.clip((s["slope"] + s["shift"]) / max(rest, 1e-9), -1, 1))
            step_s = float(np.clip(log_sigma + step_s, -8, 4)) - log_sigma
        move = F.least(F.lit(2.0), F.greatest(F.lit(-2.0), (slope + cross * F.lit(step_s)) / bend))
        here = best[1].select(group, (F.col("link") + share * move).alias("link"))
        log_sigma = best[2] + share * step_s
    else:
        raise ArithmeticError(f"the fit did not converge in {max_rounds} rounds")
    _, top, log_sigma = best
    back = 1 / (1 + F.exp(-F.col("link"))) if family == "binomial" else F.exp("link")
    fitted = top.select(group, "link", back.alias("fit"), (1 / F.sqrt("info")).alias("se_link"), F.lit(float(np.exp(log_sigma))).alias("sigma"),
                        F.lit(float(dispersion)).alias("dispersion"), f[0, 0].alias("log_likelihood"), F.lit(False).alias("separated"))
    apart = start.where(F.col("link").isNull()).select(
        group, F.lit(None).cast("double").alias("link"), "fit", F.lit(None).cast("double").alias("se_link"), F.lit(float(np.exp(log_sigma))).alias("sigma"),
        F.lit(float(dispersion)).alias("dispersion"), F.lit(0.0).alias("log_likelihood"), F.lit(True).alias("separated"))
    return fitted.unionByName(apart)
