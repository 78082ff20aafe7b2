"""Place names resolved against gazetteers by exact and near-equal names.

Near-equality is a Jaro distance of at most ``max_dist`` in every shared text column.  Names are
compared once per distinct value, all columns in one pass, and only where a condition that every
near pair meets holds, so nothing is lost and no all-pairs comparison is made:

A Jaro similarity of ``s`` needs ``m >= (3 s - 1) la lb / (la + lb)`` matching characters, and
matching characters are common to the two bags of characters.  Two bags with ``m`` common elements
share ``j`` of them among the rarest ``la - m + j`` elements of the one and ``lb - m + j`` of the
other, for every ``j`` up to ``m``.  Each name is therefore filed under (both lengths, two of those
rare elements), or one of them where a single match is enough.  A block then holds names that share
two rare characters, not one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.geo import distance_km
from fieldtrace.functions.jaro import jaro_distance
from fieldtrace.operators.joins import natural_join, union_all
from fieldtrace.operators.keyed import attach_per_key, first_per_key
from fieldtrace.sources.store import staged

_SLACK = 1e-9


def _bag(text: str | Column) -> Column:
    """Characters with their occurrence number: ``aba`` gives a1, a2, b1."""
    letters = F.array_sort(F.split(text, ""))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c) + 2).cast("string")))


def _with_sorted_bag(names: DataFrame, rarity: DataFrame) -> DataFrame:
    """``_bag``: elements of the name, rarest of its column first.  A name's bag is as long as the name."""
    elements = names.select("field", "text", F.explode(_bag(F.col("text"))).alias("_e"))
    ranked = elements.join(rarity, ["field", "_e"], "left").groupBy("field", "text").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_count", F.lit(0)).alias("c"), "_e"))).alias("_r"))
    return ranked.select("field", "text", F.transform("_r", lambda x: x["_e"]).alias("_bag"))


def _signatures(prefix: Column, need: Column) -> Column:
    """Pairs of rare elements, in order; the elements themselves where one match is enough."""
    pairs = F.flatten(F.transform(prefix, lambda x, i: F.transform(
        F.slice(prefix, i + 2, F.size(prefix)), lambda y: F.concat_ws("\x01", x, y))))
    return F.when(need >= 2, pairs).otherwise(prefix)


def _filed(bags: DataFrame, max_dist: float, own: str, other: str) -> DataFrame:
    """One row per partner length and signature."""
    s = 3 * (1 - max_dist)
    length = F.length("text").cast("double")
    low = F.ceil((s - 2) * length - _SLACK)
    high = F.floor(length / (s - 2) + _SLACK)
    rows = bags.withColumn(other, F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    own_len, other_len = F.col(own).cast("double"), F.col(other).cast("double")
    need = F.ceil((s - 1) * own_len * other_len / (own_len + other_len) - _SLACK)
    rows = rows.withColumn(own, F.length("text").cast("bigint")).withColumn("_need", need)
    size = F.col(own) - F.col("_need") + F.least(F.lit(2), F.greatest(F.lit(1), F.col("_need")))
    rows = rows.withColumn("_prefix", F.slice("_bag", F.lit(1), F.greatest(F.lit(0), size).cast("int")))
    return rows.select("field", "text", own, other, "_need", "_prefix",
                       F.explode(_signatures(F.col("_prefix"), F.col("_need"))).alias("_e"))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, text``: the distinct values of each column."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("v"))
    return stacked.select("v.field", "v.text").where(F.col("text").isNotNull()).distinct()


def _candidates(left: DataFrame, right: DataFrame, max_dist: float) -> DataFrame:
    """Pairs of values of one field that may be near, each once: ``field, text, text_2``."""
    rarity = right.select("field", F.explode(_bag(F.col("text"))).alias("_e")).groupBy("field", "_e").agg(
        F.count(F.lit(1)).alias("_count"))
    l_bags = _with_sorted_bag(left.where(F.length("text") > 0), rarity)
    r_bags = _with_sorted_bag(right.where(F.length("text") > 0), rarity)
    lf = _filed(l_bags, max_dist, "_la", "_lb")
    rf = _filed(r_bags, max_dist, "_lb", "_la").select(
        "field", F.col("text").alias("text_2"), "_la", "_lb", "_e", F.col("_prefix").alias("_prefix_2"))
    met = lf.join(rf, ["field", "_la", "_lb", "_e"])
    # a pair that shares several signatures is kept at the first of them
    common = F.slice(F.array_intersect("_prefix", "_prefix_2"), F.lit(1), F.when(F.col("_need") >= 2, 2).otherwise(1))
    return met.where(F.col("_e") == F.array_join(common, "\x01")).select("field", "text", "text_2")


def near_values(left: DataFrame, right: DataFrame, max_dist: float = 0.1) -> DataFrame:
    """Near values of tables of distinct ``field, text``: ``field, text, text_2, d``."""
    if max_dist >= 1 / 3:
        raise ValueError("the length condition needs max_dist below 1/3")
    pairs = _candidates(left, right, max_dist)
    near = pairs.withColumn("d", jaro_distance("text", "text_2")).where(F.col("d") <= max_dist + _SLACK)
    blank = left.where(F.length("text") == 0).join(right.where(F.length("text") == 0), ["field", "text"]).select(
        "field", "text", F.col("text").alias("text_2"), F.lit(0.0).alias("d"))
    return near.unionByName(blank)


def near_texts(left: DataFrame, right: DataFrame, text: str, max_dist: float = 0.1) -> DataFrame:
    """Distinct values of the two sides that are near: ``text``, ``<text>_2`` and ``<text>_d``."""
    return near_values(_values(left, [text]), _values(right, [text]), max_dist).select(
        F.col("text").alias(text), F.col("text_2").alias(f"{text}_2"), F.col("d").alias(f"{text}_d"))


def _present(df: DataFrame, on: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))


def _routed(keys: DataFrame, reference: DataFrame, near: DataFrame, on: list[str]) -> DataFrame:
    """Key tuples and the reference tuples that are near in every column, looked up by equality."""
    routed = _present(keys, on).select(*on).distinct()
    for c in on:
        routed = routed.join(near.where(F.col("field") == c).select(
            F.col("text").alias(c), F.col("text_2").alias(f"{c}_2"), F.col("d").alias(f"{c}_d")), c)
    names = [f"{c}_2" for c in on]
    known = _present(reference, on).select(*on).distinct().toDF(*names)
    return routed.join(known, names, "left_semi").select(*on, *names, *[f"{c}_d" for c in on])


def fuzzy_join(left: DataFrame, right: DataFrame, on: list[str], max_dist: float = 0.1) -> DataFrame:
    """Distinct key tuples of both sides that are near in every column.

    Gives the left keys, the right keys as ``<c>_2`` and the distances as ``<c>_d``.  The columns
    are matched value by value; a tuple then looks up the combinations of its near values among
    the right tuples by equality, so tuples that share one value are never paired with each other.
    """
    near = staged(near_values(_values(left, on), _values(right, on), max_dist))
    return _routed(left, right, near, on)


def best_match(
    keys: DataFrame, reference: DataFrame, on: list[str], ref_id: str, max_dist: float = 0.1,
    ranked_by: list[str] | None = None,
) -> DataFrame:
    """Nearest reference row of each distinct key tuple: smallest sum of distances, then id."""
    found = fuzzy_join(keys, reference, on, max_dist)
    refs = reference.select(*[F.col(c).alias(f"{c}_2") for c in on], ref_id)
    total = F.round(reduce(add, [F.col(f"{c}_d") for c in (ranked_by or on)]), 9)
    scored = found.join(refs, [f"{c}_2" for c in on]).withColumn("d", total)
    return first_per_key(scored.select(*on, ref_id, "d"), on, ["d", ref_id])


def _hits(keys: DataFrame, reference: DataFrame, near: DataFrame, on: list[str], ref_id: str, ranked_by: list[str],
          stages: tuple[int, int], names: list[str]) -> DataFrame:
    """Every reference row near a key, with its place in the cascade: the first stage if equal, else the second.

    ``names`` are the reference names that a near match carries; an equal one has none, as they are the same.
    """
    refs = _present(reference, on).select(*[F.col(c).alias(f"{c}_2") for c in on], F.col(ref_id).alias("ref"), "lon_2", "lat_2")
    equal = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_2") for c in on])
    scored = _routed(keys, reference, near, on).join(refs, [f"{c}_2" for c in on]).select(
        *on, F.when(equal, stages[0]).otherwise(stages[1]).alias("stage"),
        F.when(equal, 0.0).otherwise(F.round(reduce(add, [F.col(f"{c}_d") for c in ranked_by]), 9)).alias("d"),
        F.struct("ref", *[(F.when(~equal, F.col(f"{c}_2")) if c in names else F.lit(None).cast("string")).alias(f"{c}_2")
                          for c in ("co", "com", "spot")], "lon_2", "lat_2").alias("hit"))
    return natural_join(_present(keys, on), scored, on=on)


def resolve_places(
    records: DataFrame, spots: DataFrame, communes: DataFrame, found: DataFrame | None = None,
    home: str = "FRANCE", max_dist: float = 0.1, uid: str = "id",
) -> DataFrame:
    """Cascade of matches for records with ``co, dpt, com, spot``, each stage on what is left:

    exact locality, near locality, exact commune (with department at home, without abroad),
    near commune, hand-found position, none.  Adds the reference names ``co_2, com_2, spot_2``,
    its position ``lon_2, lat_2`` and ``match``: spot, com, search or -.  Exact matches carry no
    reference names, as they are the same.  A reference place listed several times and met exactly
    gives the record once per listing.

    All stages are candidates of one table with the stage as rank, and a place keeps those of its
    smallest rank: an exact match is a near one at distance 0, so no stage waits for another.
    """
    place = ["co", "dpt", "com", "spot"]
    keys = staged(records.select(*place).distinct())
    refs = _present(spots, ["spot"])
    at_home, abroad = communes.where(F.col("co") == home), communes.where(F.col("co") != home)
    known = _values(refs, ["co", "com", "spot"]).unionByName(_values(communes, ["co", "com", "dpt"])).distinct()
    near = staged(near_values(_values(keys, place), known, max_dist))
    listed = staged(union_all(
        _hits(keys, refs, near, ["co", "com", "spot"], "id_spo", ["co", "com", "spot"], (1, 2), ["co", "com", "spot"]),
        _hits(keys, at_home, near, ["co", "com", "dpt"], "id_co", ["co", "com"], (3, 4), ["co", "com"]),
        _hits(keys, abroad, near, ["co", "com"], "id_co", ["co", "com"], (3, 4), ["co", "com"])))
    best = listed.groupBy(*place).agg(F.min(F.struct("stage", "d", "hit.ref")).alias("best"))
    # equal matches all count, of near ones only the best
    kept = attach_per_key(listed, best, place, "inner").where(
        (F.col("stage") == F.col("best.stage")) & (F.col("stage").isin(1, 3) | (F.struct("d", "hit.ref") == F.struct("best.d", "best.ref"))))
    hits = kept.select(*place, "hit.co_2", "hit.com_2", "hit.spot_2", "hit.lon_2", "hit.lat_2",
                       F.when(F.col("stage") <= 2, "spot").otherwise("com").alias("match"))
    out = natural_join(records, hits, "left", on=place)
    if found is not None:
        hand = found.select("co", "com", "spot", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
        out = natural_join(out, hand, "left", on=["co", "com", "spot"])
        searched = F.col("match").isNull() & (F.col("lon").isNull() | F.col("lat").isNull()) & F.col("_lon").isNotNull()
        out = out.withColumns({
            "lon_2": F.when(searched, F.col("_lon")).otherwise(F.col("lon_2")),
            "lat_2": F.when(searched, F.col("_lat")).otherwise(F.col("lat_2")),
            "match": F.when(searched, F.lit("search")).otherwise(F.col("match")),
        }).drop("_lon", "_lat")
    return out.withColumn("match", F.coalesce("match", F.lit("-")))


def reconcile_coordinates(records: DataFrame, far_km: float = 15.0) -> DataFrame:
    """Take the reference position where the own one is missing or more than ``far_km`` away.

    Adds ``dist``.  Where a commune was named by the reference its names replace the own ones;
    the commune then shows the locality, as in the source records.
    """
    dist = distance_km("lon", "lat", "lon_2", "lat_2")
    far = F.coalesce(dist > far_km, F.lit(False))
    named = F.col("com_2").isNotNull()
    return records.select(
        *[c for c in records.columns if c not in ("lon", "lat", "co", "com")],
        dist.alias("dist"),
        F.when(far | F.col("lon").isNull(), F.col("lon_2")).otherwise(F.col("lon")).alias("lon"),
        F.when(far | F.col("lat").isNull(), F.col("lat_2")).otherwise(F.col("lat")).alias("lat"),
        F.when(named, F.col("co_2")).otherwise(F.col("co")).alias("co"),
        F.coalesce("spot_2", "spot").alias("com"))
