"""Random-intercept models against integrals taken on a grid, and odd tables."""

import numpy as np
import pytest

from fieldtrace.operators import mixed, models

COLUMNS = "grp long, who string, y double, w double"


def made(seed, family, groups=3, each=40):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for i in range(each):
            b = rng.normal() * 0.8
            for _ in range(rng.integers(1, 6)):
                eta = 0.5 * g - 0.4 + b
                y = float(rng.random() < 1 / (1 + np.exp(-eta))) if family == "binomial" else float(rng.gamma(2, np.exp(eta) / 2))
                rows.append((g, f"{g}-{i}", y, float(rng.integers(1, 3))))
    return rows


def whole_likelihood(rows, links, sigma, family, dispersion):
    """Sum over individuals of the log of their likelihood, integrated over a fine grid of intercepts."""
    b = np.linspace(-8, 8, 4001) * sigma
    prior = np.exp(-0.5 * (b / sigma) ** 2) / np.sqrt(2 * np.pi) / sigma
    sums = {}
    for g, who, y, w in rows:
        s = sums.setdefault((g, who), [0.0, 0.0])
        s[0] += w
        s[1] += w * y
    total = 0.0
    for (g, _), (sw, swy) in sums.items():
        eta = links[g] + b
        value = swy * eta - sw * np.logaddexp(0, eta) if family == "binomial" else -(swy * np.exp(-eta) + sw * eta) / dispersion
        total += np.log((np.exp(value - value.max()) * prior).sum() * (b[1] - b[0])) + value.max()
    return total


@pytest.mark.parametrize("family", ["binomial", "gamma"])
def test_fit_is_the_top_of_the_whole_likelihood(spark, family):
    rows = made(3, family)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {r.grp: r for r in mixed.random_intercept_fit(df, "grp", "who", "y", "w", family, nodes=15).collect()}
    assert set(got) == {0, 1, 2} and not any(r.separated for r in got.values())
    links, sigma, dispersion = {g: r.link for g, r in got.items()}, got[0].sigma, got[0].dispersion
    top = whole_likelihood(rows, links, sigma, family, dispersion)
    assert np.isclose(sum(r.log_likelihood for r in got.values()), top, atol=1e-3)
    for g in links:
        for step in (-0.05, 0.05):
            assert whole_likelihood(rows, links | {g: links[g] + step}, sigma, family, dispersion) < top
            curved = 2 * (top - whole_likelihood(rows, links | {g: links[g] + step}, sigma, family, dispersion)) / step**2
            assert 0.5 < curved * got[g].se_link ** 2 < 2  # the information that the standard error states
    for factor in (0.93, 1.07):
        assert whole_likelihood(rows, links, sigma * factor, family, dispersion) < top


def test_one_node_is_laplace_and_more_nodes_come_closer():
    sw, swy = np.array([3.0, 1.0, 10.0]), np.array([3.0, 0.0, 4.0])
    rows = [(0, str(i), 1.0, a) for i, a in enumerate(swy) if a] + [(0, str(i), 0.0, w - a) for i, (w, a) in enumerate(zip(sw, swy)) if w > a]
    exact = whole_likelihood(rows, {0: 0.3}, 1.5, "binomial", 1.0)
    off = [abs(mixed.marginal_terms(sw, swy, 0.3, 1.5, "binomial", nodes=n).sum() - exact) for n in (1, 5, 25)]
    b, bend = mixed.modes(sw, swy, 0.3, 1.5, "binomial")
    value, _, _ = mixed._terms(b, sw, swy, 0.3, "binomial", 1.0)
    plain = value - 0.5 * (b / 1.5) ** 2 - 0.5 * np.log1p(bend * 1.5**2)
    assert np.allclose(plain, mixed.marginal_terms(sw, swy, 0.3, 1.5, "binomial")) and off[0] > off[1] > off[2] and off[2] < 1e-4


def test_separated_group_and_empty_tables(spark):
    rows = made(5, "binomial") + [(9, f"s{i}", 1.0, 1.0) for i in range(10)] + [(None, "x", 1.0, 1.0), (1, "y", None, 1.0), (1, "z", 1.0, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    fit = mixed.random_intercept_fit(df, "grp", "who", "y", "w", "binomial")
    assert dict(fit.dtypes)["grp"] == "bigint"
    got = {r.grp: r for r in fit.collect()}
    alone = {r.grp: r for r in mixed.random_intercept_fit(df.where("grp <> 9"), "grp", "who", "y", "w", "binomial").collect()}
    assert got[9].separated and got[9].fit == 1.0 and got[9].link is None and set(got) == {0, 1, 2, 9}
    assert all(np.isclose(got[g].link, alone[g].link) and np.isclose(got[g].sigma, alone[g].sigma) for g in alone)
    told = mixed.conditional_rows(df, fit, "grp", "who", "y", "w", "binomial").collect()
    assert len(told) == len(rows) and all((r.fitted is None) == (r.grp in (9, None) or (r.who in "yz")) for r in told)
    for family in ("binomial", "gamma"):
        assert mixed.random_intercept_fit(df.limit(0), "grp", "who", "y", "w", family).collect() == []
    only = mixed.random_intercept_fit(df.where("grp = 9"), "grp", "who", "y", "w", "binomial").collect()
    assert [(r.grp, r.fit, r.separated) for r in only] == [(9, 1.0, True)]


def test_registered_fits(spark, tables):
    """random_intercept_migration and random_intercept_distance climb from the model without random intercepts."""
    from fieldtrace.catalog import all_queries
    for name, y, family in (("random_intercept_migration", "mig", "binomial"), ("random_intercept_distance", "dist_pt_km", "gamma")):
        got = all_queries()[name].run(tables).collect()
        rows = [(r.sp, r.ring, float(r[y]), r.wgt_co) for r in tables.seasonal_orders.where("sp IS NOT NULL").select("sp", "ring", y, "wgt_co").collect()]
        sums = {}
        for sp, ring, v, w in rows:
            s = sums.setdefault((sp, ring), [0.0, 0.0])
            s[0], s[1] = s[0] + w, s[1] + w * v
        keys = sorted(sums)
        sw, swy = np.array([sums[k] for k in keys]).T

        def value(links, sigma):
            return mixed.marginal_terms(sw, swy, np.array([links[k[0]] for k in keys]), sigma, family, got[0].dispersion).sum()

        links, sigma = {r.sp: r.link for r in got}, got[0].sigma
        top = value(links, sigma)
        assert np.isclose(sum(r.log_likelihood for r in got), top)
        for sp in links:
            assert value(links | {sp: links[sp] + 0.02}, sigma) < top > value(links | {sp: links[sp] - 0.02}, sigma)
        assert value(links, sigma * 1.05) <= top + 1e-6 and value(links, sigma * 0.95) <= top + 1e-6


def test_group_fit_without_freedom_or_weight(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 1.0), (2, "b", 3.0, 2.0)], COLUMNS)
    assert [(r.grp, r.fit, r.se_fit, r.dispersion) for r in models.group_fit(df, "grp", "y", "w", "gamma").sort("grp").collect()] == [
        (1, 2.0, None, None), (2, 3.0, None, None)]
    assert [r.separated for r in mixed.random_intercept_fit(df, "grp", "who", "y", "w", "gamma").collect()] == [False, False]
    zero = df.selectExpr("grp", "who", "y", "0e0 AS w").unionByName(spark.createDataFrame([(3, "c", 1.0, 1.0), (3, "d", 4.0, 1.0)], COLUMNS))
    for family in ("binomial", "gamma"):
        got = {r.grp: r for r in models.group_fit(zero, "grp", "y", "w", family).collect()}
        assert got[1].fit is None and got[1].link is None and got[1].se_fit is None and got[3].fit == 2.5
    assert np.isclose(models.group_fit(zero, "grp", "y", "w", "gamma").where("grp = 3").first().dispersion, 2 * 0.36)
    none = models.von_mises_fit(zero.where("grp < 3"), "grp", "y", "w").collect()
    assert {r.kappa for r in none} == {None}
