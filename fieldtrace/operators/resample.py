"""Weighted draws with replacement and the Monte Carlo test built on them."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.geo import EARTH_RADIUS_KM, east_share, north_share
from fieldtrace.functions.special import log_gamma
from fieldtrace.operators.density import gathered_values, share_of_gathered
from fieldtrace.operators.joins import natural_join, union_all
from fieldtrace.operators.ranks import row_numbers, running_total
from fieldtrace.sources.store import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_UNIT = 2**52


def uniform(*parts) -> Column:
    """Repeatable uniform number in [0, 1) from the values that identify a draw."""
    text = F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(_UNIT))


def weighted_draws(birds: DataFrame, choices: DataFrame, site: str, uid: str, choice: str, weight: str,
                   replicates: int, cells: int = 4096) -> DataFrame:
    """For each individual and replicate one choice of its site, drawn in proportion to weight.

    Weights become whole units whose running total gives every choice an interval; a draw is a
    unit of its site's total.  Intervals and draws meet on (site, part of the total), so a draw
    is compared with the few intervals around it and not with all choices of the site.  Every
    positive choice has one unit at least, and an individual whose site has no positive weight
    keeps its replicates with a missing choice.
    """
    totals = choices.where(F.col(weight) > 0).groupBy(site).agg(F.sum(weight).alias("_w"))
    units = F.greatest(F.lit(1), F.round(F.col(weight) / F.col("_w") * F.lit(float(_UNIT))).cast("bigint"))
    sized = choices.where(F.col(weight) > 0).join(totals, site).withColumn("_units", units).drop("_w")
    upto = running_total(sized, [site], [choice], "_units", "_hi")
    whole = upto.groupBy(site).agg(F.max("_hi").alias("_total"))
    part = lambda c: F.floor(c / (F.col("_total") / cells)).cast("int")
    spans = upto.withColumn("_lo", F.col("_hi") - F.col("_units")).join(whole, site)
    filed = spans.withColumn("_cell", F.explode(F.sequence(part(F.col("_lo")), part(F.col("_hi") - 1)))).drop("_total", "_units")
    asked = birds.select(site, uid, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).withColumn(
        "_u", uniform(site, uid, "replicate")).join(whole, site, "left")
    asked = asked.withColumn("_at", F.least(F.floor(F.col("_u") * F.col("_total")).cast("bigint"), F.col("_total") - 1)).withColumn(
        "_cell", part(F.col("_at"))).drop("_u", "_total")
    mine = filed.select(F.col(site).alias("_site"), F.col("_cell").alias("_part"), "_lo", "_hi",
                        *[c for c in choices.columns if c != site])
    hit = asked.join(mine, (F.col(site) == F.col("_site")) & (F.col("_cell") == F.col("_part"))
                     & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")), "left")
    return hit.drop("_cell", "_at", "_lo", "_hi", "_site", "_part")


#: Place of a site and the model of its distances.  Weights worked out together; draws worked out together; draws and weights of a task.
_MODEL = ("n_lon", "n_lat", "_shape", "_rate", "_log")
_AT_ONCE, _DRAWS_AT_ONCE, _DRAWS_A_TASK, _WEIGHTS_A_TASK = 1 << 18, 1 << 20, 1_500_000, 16_000_000
#: Draws that a task holds at most; replicates that lie together at least.
_DRAWS_HELD, _SPAN = 1 << 24, 16
#: Rotations and constants of md5, messages worked out together.
_TURNS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for n in four]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_DIGESTS_AT_ONCE = 1 << 14


def _numbers(lists: pa.Array, i: int) -> np.ndarray:
    return lists[i].values.to_numpy(zero_copy_only=False)


def _md5_words(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First 64 bits of the md5 of messages of one block, given as 16 words that may be broadcast to ``shape``."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(shape, x) for x in start)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        kind = i >> 4
        if kind == 0:
            np.bitwise_xor(c, d, out=f); f &= b; f ^= d  # noqa: E702
        elif kind == 1:
            np.bitwise_xor(b, c, out=f); f &= d; f ^= c  # noqa: E702
        elif kind == 2:
            np.bitwise_xor(b, c, out=f); f ^= d  # noqa: E702
        else:
            np.invert(d, out=f); f |= b; f ^= c  # noqa: E702
        f += a
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16] + _SINES[i]
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = a + start[0], b + start[1]
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def uniforms(heads: list[bytes], numbers: list[bytes]) -> np.ndarray:
    """Numbers in [0, 1) of every head followed by every number, as ``uniform`` has them of the whole texts."""
    out = np.empty((len(heads), len(numbers)), np.uint64)
    sizes, digits = (np.array([len(x) for x in xs]) for xs in (heads, numbers))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        for m in np.unique(digits):
            cols = np.flatnonzero(digits == m)
            if n + m > 55:  # more than one block
                found = b"".join(hashlib.md5(heads[i] + numbers[j]).digest()[:8] for i in rows for j in cols)
                out[np.ix_(rows, cols)] = np.frombuffer(found, ">u8").reshape(len(rows), len(cols))
                continue
            head, tail = np.zeros((len(rows), 64), np.uint8), np.zeros((len(cols), 64), np.uint8)
            head[:, :n] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(len(rows), n)
            head[:, n + m], head[:, 56], head[:, 57] = 0x80, (n + m) * 8 & 0xFF, (n + m) * 8 >> 8
            tail[:, n:n + m] = np.frombuffer(b"".join(numbers[j] for j in cols), np.uint8).reshape(len(cols), m)
            head, tail = head.view("<u4"), tail.view("<u4")
            step = max(1, _DIGESTS_AT_ONCE // len(cols))
            for low in range(0, len(rows), step):
                part = head[low:low + step]
                words = [part[:, [j]] | tail[:, j] if tail[:, j].any() else part[:, [j]] for j in range(16)]
                out[np.ix_(rows[low:low + step], cols)] = _md5_words(words, (len(part), len(cols)))
    return (out >> np.uint64(12)).astype(np.float64).ravel() / _UNIT


def _km(lon1, lat1, lon2, lat2) -> np.ndarray:
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _bearing(lon1, lat1, lon2, lat2) -> np.ndarray:
    d, a, b = np.radians(lon2 - lon1), np.radians(lat1), np.radians(lat2)
    return np.degrees(np.arctan2(np.cos(b) * np.sin(d), np.cos(a) * np.sin(b) - np.sin(a) * np.cos(b) * np.cos(d)))


def _weights(n_lon, n_lat, shape, rate, log, lon, lat, area) -> np.ndarray:
    """sites x bodies of weights: area by the gamma density of the distance, nothing at a distance of 0 or a missing one."""
    x = _km(n_lon[:, None], n_lat[:, None], lon, lat)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.exp((shape - 1)[:, None] * np.log(x) + log[:, None] - rate[:, None] * x)
    return area * np.where(x > 0, density, 0.0)


def water_blocks(water: DataFrame, choice: str = "wb_id", weight: str = "wgt_area", cell: float = 2.0, block: int = 512) -> DataFrame:
    """Water bodies of positive weight in blocks: those of one cell of the map, at most ``block`` of them, as an array."""
    placed = water.where(F.col(weight) > 0).select(
        F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"), F.col(choice).alias("c"), "lon", "lat", F.col(weight).alias("area"))
    numbered = row_numbers(placed, ["cx", "cy"], ["c"], "_n")
    return numbered.groupBy("cx", "cy", F.floor((F.col("_n") - 1) / block).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("c", "lon", "lat", "area"))).alias("bodies"))


def site_draws(birds: DataFrame, sites: DataFrame, water: DataFrame, fit: DataFrame, replicates: int, group: str = "sp",
               uid: str = "ring", choice: str = "wb_id", cell: float = 2.0, block: int = 512, birds_at_once: int = 256) -> DataFrame:
    """For each individual and replicate one water body, drawn by its area weight and its distance to the nesting site.

    ``birds`` has site_id and ``uid``, ``sites`` site_id, ``group``, n_lon, n_lat, ``water`` ``choice``, lon, lat, wgt_area,
    ``fit`` the mean and the dispersion of the distances of each group.  Adds the choice, its distance and its bearing.

    Water bodies stand in blocks of neighbours.  A site has one total per block, added up where the block is, so the
    table of all sites and water bodies is never written or shuffled.  A draw is settled in two steps: it meets the running
    totals of its site's blocks, then, as the blocks come by in order, the site's running total inside its block.  This is
    the inverse of the whole running total, so shares are exact, and repeatable.  Birds of a site without any weight keep a
    missing choice.

    A task draws a span of replicates for some lots of birds and reads the blocks itself, so no draw is shuffled or written,
    and rows of a replicate come from few tasks.  Spans and tasks are as long as it takes for draws to outnumber the birds
    and blocks that are sent to them.
    """
    shape, rate = 1 / F.col("dispersion"), 1 / (F.col("dispersion") * F.col("fit"))
    models = fit.select(F.col(group).alias("_group"), shape.alias("_shape"), rate.alias("_rate"), (shape * F.log(rate) - log_gamma(shape)).alias("_log"))
    known = staged(sites.join(models, F.col(group) == F.col("_group")).select("site_id", group, *_MODEL))
    blocks = staged(water_blocks(water, choice, "wgt_area", cell, block))
    n_sites, n_birds = known.count(), birds.count()
    n_bodies = blocks.agg(F.coalesce(F.sum(F.size("bodies")), F.lit(0))).first()[0]
    packs = max(1, n_sites // 256)
    packed = known.groupBy(F.pmod(F.xxhash64("site_id"), F.lit(packs)).alias("_pack")).agg(F.collect_list(F.struct("site_id", *_MODEL)).alias("s")).select(
        *[F.col(f"s.{c}").alias(c) for c in ("site_id", *_MODEL)])
    bodies = [F.col(f"bodies.{c}").alias(a) for c, a in (("c", "cs"), ("lon", "lons"), ("lat", "lats"), ("area", "areas"))]
    place = ("cx", "cy", "part")

    def add_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                site, body = ([_numbers(batch.column(c), i) for c in names] for names in (_MODEL, ("lons", "lats", "areas")))
                upto = [_weights(*(x[j:j + _AT_ONCE // len(body[0]) + 1] for x in site), *body).cumsum(axis=1)[:, -1]
                        for j in range(0, len(site[0]), _AT_ONCE // len(body[0]) + 1)]
                ids = batch.column("site_id")[i].values
                yield pa.RecordBatch.from_arrays([ids, *(pa.repeat(batch.column(c)[i], len(ids)) for c in place), pa.array(np.concatenate(upto))],
                                                 names=["site_id", *place, "total"])

    site_type = birds.schema["site_id"].dataType
    key = [T.StructField(c, T.LongType()) for c in place]
    spread = packed.repartition(-(-packs // 8)).hint("shuffle_replicate_nl").crossJoin(blocks.select(*place, *bodies[1:]))
    totals = spread.mapInArrow(add_up, T.StructType([T.StructField("site_id", site_type), *key, T.StructField("total", T.DoubleType())])).where("total > 0")
    running = totals.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct(*place, "total"))).alias("_b")).select(
        F.col("site_id").alias("_with"), *[F.col(f"_b.{c}").alias(c) for c in (*place, "total")])
    running = staged(known.join(running, F.col("site_id") == F.col("_with"), "left").drop("_with").withColumnRenamed("site_id", "_site"))
    # A lot is small to store and long to draw: tasks are dealt by draws and weights, not by the bytes that go in.
    some = max(n_birds, 1)
    per_task = max(_DRAWS_A_TASK, min(25 * n_bodies, _DRAWS_HELD))
    span = min(max(replicates, 1), max(_SPAN, -(-per_task // some), -(-n_sites * n_bodies // (4 * some))))
    spans = -(-replicates // span)
    parts = 1 + n_birds * span // per_task + min(n_sites * n_bodies, n_birds * span * block) // _WEIGHTS_A_TASK
    lot_of = birds.groupBy("site_id").agg(F.ceil(F.count(F.lit(1)) / -(-birds_at_once * replicates // span)).cast("int").alias("_lots")).withColumnRenamed("site_id", "_of")
    lots = birds.join(lot_of, F.col("site_id").eqNullSafe(F.col("_of"))).groupBy("site_id", F.pmod(F.xxhash64(uid), F.col("_lots")).alias("_lot")).agg(
        F.collect_list(F.col(uid)).alias("uids"))
    lists = [f"{c}s" for c in (*place, "total")]
    lots = lots.join(running, F.col("site_id") == F.col("_site"), "left").select(
        F.pmod(F.xxhash64("site_id", "_lot"), F.lit(parts)).alias("_part"), "site_id", group, *_MODEL, "uids", *[F.col(c).alias(a) for c, a in zip((*place, "total"), lists)])
    asked = lots.withColumn("_span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).select(
        (F.col("_span") * parts + F.col("_part")).cast("int").alias("task"), (F.col("_span") * span + 1).alias("first"), *lots.columns[1:])
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(spans * parts - 1))).alias("task"), *place, *bodies)
    together = union_all(asked, sent).repartitionById(spans * parts, "task").sortWithinPartitions("task", F.col("first").isNull(), *place)
    uid_type, choice_type = birds.schema[uid].dataType, water.schema[choice].dataType
    names = ["site_id", group, uid, "replicate", choice, "dist_km", "angle_deg"]

    def drawn_from(batch):
        """Draws of some lots that share their replicates: where in ``order`` those of each block are, and what to settle them by."""
        first = batch.column("first")[0].as_py()
        numbers = [str(r).encode() for r in range(first, min(first + span, replicates + 1))]
        lens, has = pc.list_value_length(batch.column("uids")).to_numpy(), pc.fill_null(pc.list_value_length(batch.column("totals")), 0).to_numpy(zero_copy_only=False)
        uids, totals = batch.column("uids").flatten(), batch.column("totals").flatten().to_numpy()
        heads = [f"{s}|{u}|".encode() for s, n, us in zip(batch.column("site_id").to_pylist(), lens, np.split(np.array(uids.to_pylist(), object), np.cumsum(lens)[:-1])) for u in us]
        u = uniforms(heads, numbers)
        entry, rest = np.full(len(u), -1), np.zeros(len(u))
        begin, low = 0, 0
        for n, m in zip(lens * len(numbers), has):
            if m:
                upto = np.cumsum(totals[low:low + m])
                point = u[begin:begin + n] * upto[-1]
                at = np.minimum(np.searchsorted(upto, point, "right"), m - 1)
                rest[begin:begin + n] = point - np.append(0.0, upto)[at]
                entry[begin:begin + n] = low + at
            begin, low = begin + n, low + m
        places = np.stack([batch.column(c).flatten().to_numpy() for c in lists[:3]], axis=1)
        different, code = np.unique(places, axis=0, return_inverse=True)
        code = np.append(code.ravel(), len(different)).astype(np.int16 if len(different) < 1 << 15 else np.int32)  # the last for birds that have no block
        block_of = code[entry]
        order = np.argsort(block_of, kind="stable").astype(np.int32)
        ends = np.searchsorted(block_of[order], np.arange(len(different) + 2))
        spots = {tuple(p): (low, high) for p, low, high in zip([*different.tolist(), (None,)], ends[:-1], ends[1:])}
        site = {c: batch.column(c) for c in ("site_id", group)} | {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _MODEL}
        return spots, order, rest[order], np.repeat(np.arange(len(lens), dtype=np.int32), lens * len(numbers))[order], uids, first, len(numbers), site

    def settled(held, spot, kind, body):
        """Rows of the draws in one block, or of those that have none."""
        spots, order, rest, row, uids, first, k, site = held
        low, high = spots.get(spot, (0, 0))
        for begin in range(low, high, _DRAWS_AT_ONCE):
            mine = slice(begin, min(high, begin + _DRAWS_AT_ONCE))
            lot, of = np.unique(row[mine], return_inverse=True)
            same = [site[c].take(pa.array(row[mine])) for c in ("site_id", group)]
            drawn = [uids.take(pa.array(order[mine] // k)), pa.array((order[mine] % k + first).astype(np.int32))]
            if body is None:
                found = [pa.nulls(len(of), t) for t in (kind, pa.float64(), pa.float64())]
            else:
                cs, *at_body = body
                at, step = np.empty(len(of), np.int64), _AT_ONCE // len(cs) + 1
                ends = np.searchsorted(row[mine], np.append(lot, lot[-1] + 1))
                for j in range(0, len(lot), step):
                    upto = _weights(*(site[c][lot[j:j + step]] for c in _MODEL), *at_body).cumsum(axis=1)
                    for i, weights in enumerate(upto, j):
                        at[ends[i]:ends[i + 1]] = weights.searchsorted(rest[mine][ends[i]:ends[i + 1]], "right")
                at = np.minimum(at, len(cs) - 1)
                pair, of_pair = np.unique(of * len(cs) + at, return_inverse=True)
                seen = (*(site[c][lot[pair // len(cs)]] for c in _MODEL[:2]), *(x[pair % len(cs)] for x in at_body[:2]))
                found = [cs.take(pa.array(at)), pa.array(_km(*seen)[of_pair]), pa.array(_bearing(*seen)[of_pair])]
            yield pa.RecordBatch.from_arrays([*same, *drawn, *found], names=names)

    def draw(batches):
        task, held = None, []
        for batch in batches:
            kind = batch.schema.field("cs").type.value_type
            tasks, is_lot = batch.column("task").to_numpy(), batch.column("first").is_valid().to_numpy(zero_copy_only=False)
            n_draws = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("uids")), 0).to_numpy(zero_copy_only=False).astype(np.int64) * span)
            cuts = np.flatnonzero(np.diff(n_draws // _DRAWS_AT_ONCE, prepend=-1).astype(bool) | np.append(True, tasks[1:] != tasks[:-1]) | ~is_lot)
            for low, high in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                if tasks[low] != task:
                    task, held = tasks[low], []
                if is_lot[low]:
                    held.append(drawn_from(batch.slice(low, high - low)))
                    yield from settled(held[-1], (None,), kind, None)
                else:
                    body = (batch.column("cs")[low].values, *(_numbers(batch.column(c), low) for c in ("lons", "lats", "areas")))
                    for part in held:
                        yield from settled(part, tuple(batch.column(c)[low].as_py() for c in place), kind, body)

    return together.mapInArrow(draw, T.StructType([
        T.StructField("site_id", site_type), sites.schema[group], T.StructField(uid, uid_type), T.StructField("replicate", T.IntegerType()),
        T.StructField(choice, choice_type), T.StructField("dist_km", T.DoubleType()), T.StructField("angle_deg", T.DoubleType())]))


def with_realized(potential: DataFrame, realized: DataFrame, group: str, uid: str, angle: str, weight: str) -> DataFrame:
    """Drawn and observed directions in one table; replicate 0 is what was observed."""
    drawn = potential.select(group, uid, angle, F.col("replicate").alias("id"), F.lit("potential").alias("migration"))
    seen = realized.select(group, uid, angle, F.lit(0).alias("id"), F.lit("realized").alias("migration"), weight)
    return union_all(seen, drawn).withColumn(weight, F.coalesce(weight, F.lit(1.0)))


def axis_shares(directions: DataFrame, group: str, angle: str, weight: str, uid: str) -> DataFrame:
    """Share of each replicate's directions on the east and on the north side.

    Directions are drawn once and written in arrays, both axes read these; ``uid`` only names the individuals.
    """
    held = gathered_values(directions, [group, "id"], angle, weight)
    on = lambda axis, share: F.struct(F.lit(axis).alias("axis"), F.transform("x", share).alias("x"))
    projected = held.select(group, "id", F.explode(F.array(on("East", east_share), on("North", north_share))).alias("_a"), "w", "n")
    return share_of_gathered(projected.select(group, "id", "_a.axis", "_a.x", "w", "n"), [group, "id", "axis"])


def _digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _trigamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def beta_fit(log_p: float, log_q: float, start: tuple[float, float]) -> tuple[float, float]:
    """Shapes whose expected ln p and ln(1 - p) are the given means."""
    a, b = start
    for _ in range(200):
        s = _digamma(a + b)
        g1, g2 = log_p - _digamma(a) + s, log_q - _digamma(b) + s
        t = _trigamma(a + b)
        h11, h22 = t - _trigamma(a), t - _trigamma(b)
        det = h11 * h22 - t * t
        da, db = (h22 * g1 - t * g2) / det, (h11 * g2 - t * g1) / det
        a, b = max(a / 10, a - da), max(b / 10, b - db)
        if abs(da) + abs(db) < 1e-12 * (a + b):
            break
    return a, b


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / d
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def beta_statistics(shares: DataFrame, group: str) -> DataFrame:
    """What the beta likelihood needs of the replicates, and the observed share, per group and axis.

    A replicate at 0 or 1 has no finite logarithm: ``at_ends`` counts these, and with any of them both means of
    logarithms are missing, as the likelihood then has no maximum.  ``low`` and ``high`` are the replicates' own 2.5 % and
    97.5 % quantiles.
    """
    p = F.col("prop")
    inside = (p > 0) & (p < 1)
    drawn = shares.where(F.col("id") != 0).groupBy(group, "axis").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("at_ends"),
        F.avg(F.when(inside, F.log(p))).alias("log_p"), F.avg(F.when(inside, F.log(1 - p))).alias("log_q"),
        F.avg(p).alias("mean"), F.var_samp(p).alias("var"), F.percentile(p, [0.025, 0.975]).alias("_q"))
    whole = F.col("at_ends") == 0
    drawn = drawn.withColumns({"log_p": F.when(whole, F.col("log_p")), "log_q": F.when(whole, F.col("log_q")),
                               "low": F.col("_q")[0], "high": F.col("_q")[1]}).drop("_q")
    seen = shares.where(F.col("id") == 0).select(group, "axis", p.alias("realized"))
    return natural_join(drawn, seen, "left", on=[group, "axis"])


def tropism_test(shares: DataFrame, group: str) -> DataFrame:
    """Beta fit of the replicates per group and axis, its 95 % interval, and twice the upper tail
    beyond the observed share (may exceed 1).  Missing where the likelihood has no maximum."""
    stats = beta_statistics(shares, group)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if pd.isna(r.log_p) or not r.var > 0:  # no maximum: replicates at 0 or 1, or all equal
                    rows.append((getattr(r, group), r.axis, r.realized, *[np.nan] * 5))
                    continue
                size = r.mean * (1 - r.mean) / r.var - 1
                a, b = beta_fit(r.log_p, r.log_q, (r.mean * size, (1 - r.mean) * size))
                tail = np.nan if pd.isna(r.realized) else 2 * (1 - beta_cdf(r.realized, a, b))
                rows.append((getattr(r, group), r.axis, r.realized, tail, beta_quantile(0.025, a, b),
                             beta_quantile(0.975, a, b), a, b))
            yield pd.DataFrame(rows, columns=[group, "axis", "realized", "p_critique", "conf_int_low", "conf_int_high",
                                              "shape1", "shape2"])

    return stats.mapInPandas(solve, f"{group} string, axis string, realized double, p_critique double, "
                                    "conf_int_low double, conf_int_high double, shape1 double, shape2 double")
