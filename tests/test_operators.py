"""Operators against brute force, also with the paths for hot keys and many blocks switched on."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from fieldtrace.functions.jaro import jaro_distances
from fieldtrace.operators import density, joins, keyed, mixed, models, ranks, resample, resolve, spatial, timeline
from fieldtrace.plans import regions


@pytest.fixture
def blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(spark, n=3000):
    """One key holds a third of the rows; some keys are missing."""
    rng = random.Random(3)
    rows = [(i, None if i % 50 == 7 else (0 if i % 3 == 0 else rng.randrange(40)), rng.randrange(500), rng.choice("BCCR"))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, ring long, at long, k string")


def test_attach_with_hot_keys(spark):
    rows, df = skewed(spark)
    got = {r.id: r.n for r in keyed.add_count(df, ["ring"], "n").collect()}
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    assert got == {r[0]: sizes[r[1]] for r in rows}


def gate(events):
    out = []
    for ring in {e[1] for e in events}:
        started = ended = False
        kept = []
        for e in sorted((e for e in events if e[1] == ring), key=lambda e: (e[2], e[0])):
            if e[3] is None:
                break
            started = started or e[3] == "BAGUAGE"
            if started and (e[3] == "REPRISE" or not ended):
                kept.append(e)
            ended = ended or (started and e[3] == "REPRISE")
        out += [(e[0], len(kept), any(k[3] == "REPRISE" for k in kept)) for e in kept]
    return sorted(out)


@pytest.mark.parametrize("unknown", [False, True])
def test_timeline_gate(spark, unknown):
    rng = random.Random(5)
    kinds = ["BAGUAGE", "CONTROLE", "CONTROLE", "REPRISE"]
    events = [(i, 0 if i % 3 == 0 else rng.randrange(30), rng.randrange(90), rng.choice(kinds)) for i in range(900)]
    if unknown:
        events = [(a, b, c, None if a % 60 == 11 else k) for a, b, c, k in events]
    df = spark.createDataFrame(events, "id long, ring long, datetime long, obs string")
    got = timeline.gate_timeline(df)
    assert sorted((r.id, r.nobs, r.reprise) for r in got.collect()) == gate(events)
    again = timeline.gate_timeline(got.select("id", "ring", "datetime", "obs"))
    assert again.count() == got.count()


def test_ranks_over_blocks(spark, blocks):
    rows, df = skewed(spark)
    got = {r.id: r.n for r in ranks.row_numbers(df, ["ring"], ["at", "id"], "n").collect()}
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[r[1]] = want[r[0]] = seen.get(r[1], 0) + 1
    assert got == want
    total = {r.id: r.t for r in ranks.running_total(df, [], ["at", "id"], "at", "t").collect()}
    s, expect = 0, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        s += r[2]
        expect[r[0]] = s
    assert total == expect


def test_quantiles_over_blocks(spark, blocks):
    rows, df = skewed(spark)
    probs = [0, 1 / 7, 0.25, 0.5, 0.9, 1]
    got = {(r.ring, r.q_id): r.quantile for r in ranks.quantiles(df, ["ring"], "at", probs).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r[2])
    for ring, values in groups.items():
        for i, p in enumerate(probs):
            assert abs(got[(ring, i)] - np.quantile(values, p)) < 1e-9


def test_nested_parts_are_full_and_in_order(spark):
    rows, df = skewed(spark)
    packed = keyed.nested(df, ["ring"], ["at", "id"], rows_per_part=100).collect()
    by_ring = {}
    for r in sorted(packed, key=lambda r: r.part):
        by_ring.setdefault(r.ring, []).append(r)
    for ring, parts in by_ring.items():
        assert [p.part for p in parts] == list(range(len(parts)))
        assert all(p.part_rows == len(p.data) == 100 for p in parts[:-1]) and 0 < parts[-1].part_rows <= 100
        order = [(x["at"] is None, x["at"], x["id"]) for p in parts for x in p.data]
        assert order == sorted(order)
    assert sorted(x["id"] for p in packed for x in p.data) == [r[0] for r in rows]
    again = keyed.unnested(keyed.nested(df, ["ring"], ["at", "id"], rows_per_part=64))
    assert sorted(r.id for r in again.collect()) == [r[0] for r in rows]


def test_running_total_with_missing_values(spark, blocks):
    rows = [(i, None if i % 3 == 0 or i < 300 else 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    want, total = {}, None
    for i, v in rows:
        total = total if v is None else (total or 0) + v
        want[i] = total
    assert {r.id: r.s for r in ranks.running_total(df, [], ["id"], "v", "s").collect()} == want


def test_binomial_fit_with_categories_of_no_and_only_successes(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 2.0), ("b", 1.0, 1.0), ("c", 0.0, 1.0), ("c", 1.0, 3.0)], "g string, y double, w double")
    fit = {r.g: r for r in models.group_fit(df, "g", "y", "w", "binomial").collect()}
    assert (fit["a"].fit, fit["a"].link, fit["a"].se_link) == (0.0, None, None) and fit["b"].fit == 1.0
    assert abs(fit["c"].fit - 0.75) < 1e-12 and abs(fit["c"].link - math.log(3)) < 1e-12
    assert models.coefficients(models.group_fit(df, "g", "y", "w", "binomial"), "g").count() == 3


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", None)], "g string, v double")
    rows = density.histogram(df, ["g"], "v", bins=10).collect()
    assert [(r.weight, r.density) for r in rows] == [(2.0, 1.0)]


def test_densities_ignore_missing_values_and_need_no_groups(spark):
    rows = [(i, float(i % 10), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows + [(100 + i, None, 1.0) for i in range(50)] + [(200, 3.0, None)], "id long, v double, w double")
    bare = spark.createDataFrame(rows, "id long, v double, w double")
    for make in (lambda d: density.kernel_density(d, [], "v", "w"), lambda d: density.circular_density(d, [], "v", "w"),
                 lambda d: density.positive_share(d, [], "v", "w")):
        got, want = (sorted(map(tuple, make(d).collect())) for d in (df, bare))
        assert np.allclose(got, want)
    points = density.kernel_density(df, [], "v", "w").orderBy("x").collect()
    assert abs(sum(p.density for p in points) * (points[1].x - points[0].x) - 1) < 1e-2
    assert density.density_2d(bare.withColumn("u", F.col("id") % 7 * 1.0), [], "v", "u", ((0.0, 0.0), (10.0, 7.0)), points=10).count() > 0


def test_draws_keep_weightless_sites_and_tiny_weights(spark):
    birds = spark.createDataFrame([("s", 1), ("empty", 2), ("s", 3)], "site string, ring long")
    choices = spark.createDataFrame([("s", "x", 1.0), ("s", "y", 1e-300), ("empty", "z", 0.0)], "site string, wb string, w double")
    got = resample.weighted_draws(birds, choices, "site", "ring", "wb", "w", 5).collect()
    assert sorted((r.ring, r.replicate) for r in got) == [(b, i) for b in (1, 2, 3) for i in range(1, 6)]
    assert {r.wb for r in got if r.ring == 2} == {None} and {r.wb for r in got if r.ring != 2} <= {"x", "y"}


def test_beta_with_replicates_at_the_ends(spark):
    shares = spark.createDataFrame([("a", i, "East", p) for i, p in enumerate([0.4, 0.2, 0.0, 0.6, 0.9])] + [
        ("b", i, "East", p) for i, p in enumerate([0.4, 0.2, 0.5, 0.6, 0.9])] + [("c", i, "East", 0.5) for i in range(4)],
        "sp string, id int, axis string, prop double")
    stats = {r.sp: r for r in resample.beta_statistics(shares, "sp").collect()}
    assert (stats["a"].n, stats["a"].at_ends, stats["a"].log_p) == (4, 1, None) and stats["b"].at_ends == 0
    assert abs(stats["b"].low - np.quantile([0.2, 0.5, 0.6, 0.9], 0.025)) < 1e-12
    test = {r.sp: r for r in resample.tropism_test(shares, "sp").collect()}
    assert test["a"].shape1 is None and test["c"].shape1 is None and test["b"].shape1 > 0


def test_an_unfinished_fit_raises(spark):
    rng = random.Random(2)
    rows = [("a" if i % 2 else "b", i // 4, float(rng.random() < 0.3 + 0.3 * (i % 2)), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, ring long, y double, w double")
    with pytest.raises(ArithmeticError):
        mixed.random_intercept_fit(df, "g", "ring", "y", "w", "binomial", max_rounds=1)


def test_fuzzy_join_loses_nothing(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeér -") for _ in range(rng.randrange(0, 14))) for _ in range(60)]

    def slip(s):
        s = list(s)
        for _ in range(rng.randrange(3)):
            if s:
                i = rng.randrange(len(s))
                s[i:i + 1] = rng.choice([[], ["z"], [s[i], "q"], s[i:i + 2][::-1]])
        return "".join(s)

    left, right = sorted({slip(b) for b in base for _ in range(3)}), sorted(set(base))
    pairs = [(a, b) for a in left for b in right]
    d = jaro_distances([a for a, _ in pairs], [b for _, b in pairs])
    want = {p for p, x in zip(pairs, d) if x <= 0.1 + 1e-9}
    got = resolve.near_texts(spark.createDataFrame([(x,) for x in left], "t string"),
                             spark.createDataFrame([(x,) for x in right], "t string"), "t").collect()
    assert len(got) == len(want) and {(r.t, r.t_2) for r in got} == want


def test_jaro_values():
    got = jaro_distances(["MARTHA", "DIXON", "", "abc", ""], ["MARHTA", "DICKSONX", "", "xyz", "a"])
    assert np.allclose(got, [1 - 0.944444444, 1 - 0.766666667, 0, 1, 1])
    long = "ab" * 9000
    assert jaro_distances([long, "x"], [long, "x"]).tolist() == [0.0, 0.0]


def test_nearest_feature_in_clusters(spark):
    rng = random.Random(2)
    features = [(i, 2 + rng.gauss(0, 0.01), 47 + rng.gauss(0, 0.01)) for i in range(200)]
    features += [(1000 + i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(50)]
    points = [(i, rng.uniform(-180, 180), rng.uniform(-89, 89)) for i in range(100)]
    points += [(500 + i, 2 + rng.gauss(0, 0.05), 47 + rng.gauss(0, 0.05)) for i in range(50)]

    def km(a, b):
        p, q = np.radians(a), np.radians(b)
        h = math.sin((q[1] - p[1]) / 2) ** 2 + math.cos(p[1]) * math.cos(q[1]) * math.sin((q[0] - p[0]) / 2) ** 2
        return 2 * 6371.01 * math.asin(min(1, math.sqrt(h)))

    edges = spark.createDataFrame([(i, x, y, x, y) for i, x, y in features], "f long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.lon, r.lat): r.dist_km for r in spatial.nearest_feature(
        spark.createDataFrame(points, "id long, lon double, lat double"), edges, "f").collect()}
    for _, x, y in points:
        best = min(km((x, y), (a, b)) for _, a, b in features)
        assert abs(got[(x, y)] - best) < 1e-6, (x, y)


def test_components_match_union_find(spark):
    rng = random.Random(9)
    n = 300
    pairs = [(i, i + 1) for i in range(0, 120)] + [(200, j) for j in range(201, 260)]
    pairs += [(rng.randrange(120, 200), rng.randrange(120, 200)) for _ in range(40)]
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in spatial.connected_components(
        spark.range(n).withColumnRenamed("id", "node"), df, "node", "a", "b").collect()}
    assert got == {i: find(i) for i in range(n)}


def test_group_fits_equal_the_iterative_solver(spark, tables):
    rows = tables.seasonal_orders.where("sp is not null").withColumn("mig", F.col("mig").cast("double"))
    rows = StringIndexer(inputCol="sp", outputCol="s").fit(rows).transform(rows)
    from pyspark.ml.feature import VectorAssembler
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(rows)
    for y, family, link in (("mig", "binomial", "logit"), ("dist_pt_km", "gamma", "log")):
        model = GeneralizedLinearRegression(family=family, link=link, labelCol=y, weightCol="wgt_co", maxIter=50, tol=1e-12).fit(rows)
        ours = {r.sp: r for r in models.group_fit(rows, "sp", y, "wgt_co", family).collect()}
        for r in model.transform(rows.select("sp", "features").distinct()).collect():
            assert abs(r.prediction / ours[r.sp].fit - 1) < 1e-6
        if family == "gamma":
            assert abs(model.summary.dispersion / next(iter(ours.values())).dispersion - 1) < 1e-6


def test_densities_and_weights_add_up(spark, tables):
    rows = tables.seasonal_orders.where("sp is not null").withColumn("v", F.col("dist_pt_km") / 1000)
    d = density.kernel_density(rows, ["sp"], "v", "wgt_co")
    for r in d.groupBy("sp").agg(F.sum("density").alias("s"), ((F.max("x") - F.min("x")) / 511).alias("h")).collect():
        assert abs(r.s * r.h - 1) < 5e-3
    h = density.histogram(rows, ["sp"], "v", "wgt_co", bins=10)
    width = (rows.agg(F.max("v") - F.min("v")).first()[0]) / 9
    assert all(abs(r.s * width - 1) < 1e-9 for r in h.groupBy("sp").agg(F.sum("density").alias("s")).collect())
    picked = models.pressure_weights(rows.drop("wgt_co").withColumn("winter", F.year("datetime")), "ring", "winter", "nes_reg")
    a, b, n = picked.agg(F.sum("wgt_co"), F.sum("pres_co"), F.count(F.lit(1))).first()
    assert abs(a - n) < 1e-6 * n and abs(b - n) < 1e-6 * n


def test_kernel_density_is_the_plain_sum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)], "id long, g string, v double")
    d = density.kernel_density(df, ["g"], "v", bw=0.3).orderBy("point").collect()
    at = np.array([r.x for r in d])
    exact = np.exp(-0.5 * ((at[:, None] - x) / 0.3) ** 2).sum(1) / (len(x) * 0.3 * math.sqrt(2 * math.pi))
    assert np.abs(exact - np.array([r.density for r in d])).max() < 1e-3


def test_draws_follow_the_weights(spark, blocks):
    choices = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate([5, 1, 0, 3, 1])], "site long, c long, w double")
    birds = spark.createDataFrame([(1, i) for i in range(100)], "site long, bird long")
    got = resample.weighted_draws(birds, choices, "site", "bird", "c", "w", 200)
    counts = {r.c: r["count"] for r in got.groupBy("c").count().collect()}
    assert sum(counts.values()) == 20000 and 2 not in counts
    for c, p in ((0, 0.5), (1, 0.1), (3, 0.3), (4, 0.1)):
        assert abs(counts[c] - 20000 * p) < 4 * math.sqrt(20000 * p * (1 - p))


def test_beta_fit_and_interval():
    rng = np.random.default_rng(4)
    p = rng.beta(8, 3, 20000)
    a, b = resample.beta_fit(np.log(p).mean(), np.log1p(-p).mean(), (1.0, 1.0))
    assert abs(a / 8 - 1) < 0.05 and abs(b / 3 - 1) < 0.05
    assert abs(resample.beta_cdf(0.3, 2, 2) - (3 * 0.09 - 2 * 0.027)) < 1e-12
    assert abs(resample.beta_cdf(resample.beta_quantile(0.025, a, b), a, b) - 0.025) < 1e-9
    assert abs((p < resample.beta_quantile(0.975, a, b)).mean() - 0.975) < 0.01


def test_random_intercepts_are_recovered(spark):
    rng = np.random.default_rng(6)
    rows = []
    for ring in range(1500):
        sp = "AYTFER" if ring % 2 else "AYTFUL"
        eta = (0.6 if ring % 2 else -0.8) + rng.normal() * 1.0
        rows += [(sp, ring, float(rng.random() < 1 / (1 + math.exp(-eta))), 1.0) for _ in range(12)]
    df = spark.createDataFrame(rows, "sp string, ring long, y double, w double")
    fit = {r.sp: r for r in mixed.random_intercept_fit(df, "sp", "ring", "y", "w", "binomial").collect()}
    assert abs(fit["AYTFER"].link - 0.6) < 0.15 and abs(fit["AYTFUL"].link + 0.8) < 0.15
    assert abs(fit["AYTFER"].sigma - 1.0) < 0.15


def test_without_spread_the_fit_is_the_plain_one():
    sw, swy = np.array([10.0, 20.0]), np.array([4.0, 11.0])
    got = mixed.laplace_terms(sw, swy, np.array([0.2, 0.2]), 1e-6, "binomial")
    assert np.allclose(got, swy * 0.2 - sw * np.log1p(np.exp(0.2)), atol=1e-9)


def test_random_intercepts_of_distances(spark):
    rng = np.random.default_rng(8)
    rows = []
    for ring in range(800):
        sp = "AYTFER" if ring % 2 else "AYTFUL"
        mean = math.exp((6.0 if ring % 2 else 5.0) + rng.normal() * 0.5)
        rows += [(sp, ring, float(v), 1.0) for v in rng.gamma(3.0, mean / 3.0, 10)]
    df = spark.createDataFrame(rows, "sp string, ring long, y double, w double")
    fit = {r.sp: r for r in mixed.random_intercept_fit(df, "sp", "ring", "y", "w", "gamma").collect()}
    # the dispersion is that of the plain model, so the spread is only bounded here
    assert abs(fit["AYTFER"].link - 6.0) < 0.15 and abs(fit["AYTFUL"].link - 5.0) < 0.15
    assert 0.2 < fit["AYTFER"].sigma < 0.7


def test_registered_draws_are_as_many_as_in_the_reference(tables):
    from fieldtrace.catalog import all_queries
    drawn = all_queries()["weighted_draws"].run(tables).groupBy("ring").agg(F.count_distinct("replicate").alias("n"), F.max("replicate").alias("last"))
    assert {(r.n, r.last) for r in drawn.collect()} == {(1000, 1000)}


def test_timeline_matches_all_communes(tables, monkeypatch):
    from fieldtrace.catalog import flows
    given = []

    def build(raw, spots, communes, *args, **kwargs):
        given.append(communes)
        raise StopIteration

    monkeypatch.setattr(flows.dataset, "build_dataset", build)
    with pytest.raises(StopIteration):
        flows.dataset_timeline(tables)
    assert given[0].count() == tables.communes.count()


def test_quantiles_of_odd_values(spark):
    rng = random.Random(8)
    values = {0: [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(700)], 1: [0.0] * 50, 2: [5.0], 3: [1.0 + i * 2.0**-52 for i in range(300)],
              None: [rng.gauss(0, 1) for _ in range(400)] + [3.25] * 900, 4: [float(i) for i in range(-500, 500)], 5: [1e9 + i / 7 for i in range(5000)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [(0, None), (9, None)], "g long, v double").repartition(5)
    probs = [0, 0.1, 1 / 3, 0.5, 0.77, 1]
    got = {(r.g, r.q_id): r.quantile for r in ranks.quantiles(df, ["g"], "v", probs).collect()}
    assert {g for g, _ in got} == set(values)
    for g, vs in values.items():
        for i, p in enumerate(probs):
            assert got[g, i] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-300)
    alone = ranks.quantiles(df.where("g = 5"), [], "v", [0.5]).first().quantile
    assert alone == got[5, 3]
    plan = ranks.quantiles(df, ["g"], "v", probs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    special = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (float("-inf"),), (-2.0,)], "v double")
    assert [r.quantile for r in ranks.quantiles(special, [], "v", [0, 0.25, 0.5, 0.75]).sort("q_id").collect()] == [float("-inf"), -2.0, 1.0, float("inf")]
    assert ranks.quantiles(special.limit(0), [], "v", probs).collect() == []


@pytest.mark.parametrize("lookup", [True, False])
def test_ranges_of_long_tailed_and_equal_values(spark, lookup):
    rng = random.Random(6)
    rows = [(i, 10 ** rng.uniform(-6, 12)) for i in range(800)] + [(i, 0.0) for i in range(800, 1000)] + [(1000, None)]
    edges = sorted([0.0] + [10 ** rng.uniform(-6, 12) for _ in range(9)])
    ranges = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))] + [(90, 5.0, 5e9), (91, 3.0, 2.0), (92, 0.0, 0.0)]
    df, r = spark.createDataFrame(rows, "id long, v double"), spark.createDataFrame(ranges, "k long, a double, b double")
    find = joins.range_lookup if lookup else joins.range_join
    want = sorted((i, k) for i, v in rows for k, a, b in ranges if v is not None and a <= v <= b)
    assert sorted((x.id, x.k) for x in find(df, "v", r, "a", "b").collect()) == want
    zeros = df.where("v = 0")
    assert find(zeros, "v", r, "a", "b").count() == 200 * sum(a <= 0 <= b for _, a, b in ranges)
    assert find(df.limit(0), "v", r, "a", "b").count() == 0 and find(df, "v", r.limit(0), "a", "b").count() == 0
    if not lookup:  # values of a long tail are spread over the cells
        spread = joins.range_join(df.where("v > 0"), "v", spark.createDataFrame([(i, 10.0**i, 10.0 ** (i + 1)) for i in range(-6, 12)], "k long, a double, b double"), "a", "b", cells=16)
        assert spread.count() >= 800


def test_habitat_weights_of_equal_areas(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(20)], "id long, v double")
    bins = models.occupied_bins(df, df, "v")
    got = models.habitat_weights(bins, df, "v").where("wgt > 0").groupBy("bin").agg({"wgt_area": "sum"}).collect()
    assert all(abs(r[1] - 1) < 1e-12 for r in got)


def test_nearest_feature_where_nearly_all_is_in_one_place(spark):
    rng = random.Random(12)

    def places(n):
        dense = [(4.5 + rng.random() / 100, 47.2 + rng.random() / 100) for _ in range(9 * n // 10)]
        return dense + [(rng.uniform(-179, 179), rng.uniform(-80, 80)) for _ in range(n - len(dense))]

    features, points = places(3000), places(1500)
    edges = spark.createDataFrame([(i, a, b, a, b) for i, (a, b) in enumerate(features)], "f long, x1 double, y1 double, x2 double, y2 double")
    df = spark.createDataFrame(points, "lon double, lat double").repartition(8)
    got = {(r.lon, r.lat): (r.f, r.dist_km) for r in spatial.nearest_feature(df, edges, "f").collect()}
    fx, fy = np.radians(np.array(features)).T
    for (lon, lat), (f, d) in got.items():
        a, b = math.radians(lon), math.radians(lat)
        h = np.sin((fy - b) / 2) ** 2 + math.cos(b) * np.cos(fy) * np.sin((fx - a) / 2) ** 2
        all_d = 2 * 6371.01 * np.arcsin(np.sqrt(h))
        assert abs(all_d.min() - d) < 1e-6 and abs(all_d[f] - d) < 1e-6
    assert len(got) == len(set(points))
    leaves, levels = spatial._packed_tree(edges, "f", [])
    sizes = [r.n for r in leaves.selectExpr("size(_edges) AS n").collect()]
    assert max(sizes) == spatial._FAN and sum(n < spatial._FAN for n in sizes) <= 1  # count decides, not place
    assert levels[-1].count() == 1 and all(r.n <= spatial._FAN for t in levels for r in t.selectExpr("size(_children) AS n").collect())
    assert spatial.nearest_feature(df, edges.limit(0), "f").collect() == [] and spatial.nearest_feature(df.limit(0), edges, "f").collect() == []


def test_polygons_and_densities_of_nothing(spark):
    flat = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 1.0), (2, 0.0, 1.0, 0.0, 0.0)],
                                 "p long, x1 double, y1 double, x2 double, y2 double")
    got = {r.p: r for r in spatial.polygon_measures(flat, ["p"]).collect()}
    assert (got[1].area, got[1].x, got[1].y) == (0.0, None, None) and got[2].area == 0.5
    none = spark.createDataFrame([(1, float(i), 0.0) for i in range(5)] + [(2, float(i), 1.0) for i in range(5)], "g long, v double, w double")
    for curve in (density.kernel_density(none, ["g"], "v", "w"), density.circular_density(none, ["g"], "v", "w")):
        rows = curve.collect()
        assert all((r.density is None) == (r.g == 1) for r in rows) and {r.g for r in rows} == {1, 2}
    assert {r.g: r.prop is None for r in density.positive_share(none, ["g"], "v", "w").collect()} == {1: True, 2: False}


def test_regions_by_priority(spark):
    def box(xa, xb, ya, yb):
        xa, xb, ya, yb = map(float, (xa, xb, ya, yb))
        c = [(xa, ya), (xb, ya), (xb, yb), (xa, yb)]
        return [(*a, *b) for a, b in zip(c, c[1:] + c[:1])]

    side = "x1 double, y1 double, x2 double, y2 double"
    countries = spark.createDataFrame([("France", "EUROPE", *e) for e in box(0, 4, 0, 4)] + [("United Kingdom", "EUROPE", *e) for e in box(6, 8, 0, 4)]
                                      + [("Japan", "ASIA", *e) for e in box(10, 12, 0, 4)], "name string, continent string, " + side)
    layer = regions.region_layer(countries, spark.createDataFrame(box(1, 2, 1, 2), side), "EUROPE", "LAKE")
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 3.0, 3.0), (3, 7.0, 1.0), (4, 11.0, 1.0), (5, 5.0, 1.0), (6, 3.0, 3.0), (7, None, 1.0)], "id long, lon double, lat double")
    weights = spark.createDataFrame([("LAKE", 9.0), ("FRANCE", 2.0), ("JAPAN", 5.0)], "region string, w double")
    got = {r.id: (r.region, r.w) for r in regions.label_regions(points, layer, weights, "w").collect()}
    assert got == {1: ("LAKE", 9.0), 2: ("FRANCE", 2.0), 6: ("FRANCE", 2.0), **dict.fromkeys((3, 4, 5, 7), (None, 1.0))}
    # Without a weight the site is still cut out of the country around it.
    less = {r.id: (r.region, r.w) for r in regions.label_regions(points, layer, weights.where("region <> 'LAKE'"), "w").collect()}
    assert less[1] == (None, 1.0) and less[2] == ("FRANCE", 2.0)


def test_site_draws_have_the_exact_shares(spark):
    rng = random.Random(4)
    water = [(i, rng.uniform(-3, 9), rng.uniform(41, 51), rng.choice([0.0, 1.0, 2.5])) for i in range(120)] + [(200 + i, 2.01, 47.01 + i * 1e-4, 1.0) for i in range(40)]
    sites = [(1, "a", 2.0, 47.0), (2, "b", 8.0, 44.0), (3, "none", 0.0, 45.0)]
    fit = spark.createDataFrame([("a", 300.0, 0.6), ("b", 150.0, 0.4)], "sp string, fit double, dispersion double")
    birds = spark.createDataFrame([(1, f"r{i}") for i in range(30)] + [(2, "s0"), (3, "t0"), (9, "u0")], "site_id long, ring string")
    w = spark.createDataFrame(water, "wb_id long, lon double, lat double, wgt_area double")
    s = spark.createDataFrame(sites, "site_id long, sp string, n_lon double, n_lat double")
    got = resample.site_draws(birds, s, w, fit, 400, block=16, birds_at_once=7).collect()
    again = resample.site_draws(birds.repartition(5), s, w, fit, 400, block=16, birds_at_once=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 33 * 400
    assert {r.wb_id for r in got if r.site_id in (3, 9)} == {None}
    weights = {}
    for wb, lon, lat, area in water:
        p, q = math.radians(47.0), math.radians(lat)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon - 2.0) / 2) ** 2
        d, k, rate = 2 * 6371.01 * math.asin(math.sqrt(h)), 1 / 0.6, 1 / (0.6 * 300.0)
        weights[wb] = area * d ** (k - 1) * math.exp(-rate * d)
    total, drawn = sum(weights.values()), [r.wb_id for r in got if r.site_id == 1]
    for wb, weight in weights.items():
        p = weight / total
        assert abs(drawn.count(wb) - len(drawn) * p) <= 5 * math.sqrt(len(drawn) * p) + 5
    assert not {wb for wb, *_, area in water if area == 0} & set(drawn)
    assert resample.site_draws(birds.limit(0), s, w, fit, 3).collect() == []


def test_site_draws_are_dealt_by_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "_DRAWS_A_TASK", 500)
    birds = spark.createDataFrame([(1, i) for i in range(40)], "site_id long, ring long")
    s = spark.createDataFrame([(1, "A", 0.0, 45.0)], "site_id long, sp string, n_lon double, n_lat double")
    w = spark.createDataFrame([(i, float(i), 46.0, 1.0) for i in range(8)], "wb_id long, lon double, lat double, wgt_area double")
    fit = spark.createDataFrame([("A", 300.0, 0.5)], "sp string, fit double, dispersion double")
    got = resample.site_draws(birds, s, w, fit, 100, birds_at_once=4).withColumn("task", F.spark_partition_id())
    assert got.count() == 4000 and got.select("task").distinct().count() > 4  # few bytes go in, but they are long to draw


def test_shares_of_many_rows_are_added_up_where_the_rows_are(spark):
    rng = random.Random(8)
    rows = [(g, rng.uniform(-1, 1) ** 3, rng.choice([1.0, 2.0])) for g in (None, *range(70)) for _ in range(30 if g else 2000)]
    df = spark.createDataFrame(rows, "g long, v double, w double").repartition(3)
    shares = density.positive_share(df, ["g"], "v", "w")
    assert "Generate" not in shares._jdf.queryExecution().optimizedPlan().toString()  # no row per node and point in reach
    got = {r.g: r.prop for r in shares.collect()}
    assert len(got) == 71
    for g in (None, 0, 5, 69):
        v, w = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        bw = 0.9 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2
        x = np.linspace(-1, 1, 512)
        y = (np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2) * w).sum(axis=1)
        assert abs(got[g] - y[x > 0].sum() / y.sum()) < 1e-3


def test_uniform_numbers_are_those_of_md5(spark):
    heads, numbers = ["1|9|", "12|r7|", "3|é|", "4|" + "x" * 49 + "|", "5|" + "y" * 80 + "|"], [1, 9, 10, 100, 9999]
    got = resample.uniforms([h.encode() for h in heads], [str(r).encode() for r in numbers])
    want = spark.createDataFrame([(i, h + str(r)) for i, (h, r) in enumerate((h, r) for h in heads for r in numbers)], "i long, t string").select("i", resample.uniform("t").alias("u"))
    assert got.tolist() == [r.u for r in want.orderBy("i").collect()]


def test_draws_and_shares_write_no_row_per_draw(spark, monkeypatch):
    monkeypatch.setattr(resample, "_DRAWS_A_TASK", 5000)
    monkeypatch.setattr(density, "_ROWS_GATHERED", 3000)
    rng = random.Random(3)
    birds = spark.createDataFrame([(1 + i % 2, i) for i in range(300)], "site_id long, ring long")
    s = spark.createDataFrame([(1, "A", 0.0, 45.0), (2, "B", 3.0, 44.0)], "site_id long, sp string, n_lon double, n_lat double")
    w = spark.createDataFrame([(i, rng.uniform(-6, 9), rng.uniform(40, 50), 1.0) for i in range(90)], "wb_id long, lon double, lat double, wgt_area double")
    fit = spark.createDataFrame([("A", 300.0, 0.5), ("B", 200.0, 0.4)], "sp string, fit double, dispersion double")
    drawn = resample.site_draws(birds, s, w, fit, 40, block=16)
    steps = drawn._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert all(a in b for a, b in zip(("MapInArrow", "Sort", "Repartition", "Union"), steps))  # nothing is joined or dealt once it is drawn
    seen = birds.join(s, "site_id").select("sp", "ring", (F.col("ring") % 360 - 179.5).alias("angle_deg"), (1.0 + F.col("ring") % 3).alias("wgt"))
    directions = resample.with_realized(drawn, seen, "sp", "ring", "angle_deg", "wgt")
    written = []
    for module in (density, resample):
        if hasattr(module, "staged"):
            keep = module.staged
            monkeypatch.setattr(module, "staged", lambda df, keep=keep, **how: written.append(keep(df, **how)) or written[-1])
    got = {(r.sp, r.id, r.axis): r.prop for r in resample.axis_shares(directions, "sp", "angle_deg", "wgt", "ring").collect()}
    rows = directions.collect()
    assert len(rows) == 300 * 41 and len(got) == 2 * 41 * 2
    assert max(t.count() for t in written) < len(rows) / 10  # rows of arrays, quartiles and bandwidths, none per direction
    gathered = [t for t in written if "n" in t.columns and "x" in t.columns]
    assert sum(r.s for t in gathered for r in t.selectExpr("aggregate(n, 0, (a, b) -> a + b) AS s").collect()) == len(rows)
    for key in (("A", 0, "East"), ("B", 7, "North"), ("A", 40, "North")):
        mine = [(math.sin(math.radians(r.angle_deg)) if key[2] == "East" else math.cos(math.radians(r.angle_deg)), r.wgt) for r in rows if (r.sp, r.id) == key[:2]]
        v, weight = np.array(mine).T
        bw = 0.9 * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2
        x = np.linspace(-1, 1, 512)
        y = (np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2) * weight).sum(axis=1)
        assert abs(got[key] - y[x > 0].sum() / y.sum()) < 1e-3
