"""The cascade of place matches against one that follows its stages record by record."""

import random

import pytest

from fieldtrace.functions.jaro import jaro_distances
from fieldtrace.operators import resolve

PLACE = ("co", "dpt", "com", "spot")


def plain(records, spots, communes, found, home="FRANCE"):
    """id -> sorted list of (co_2, com_2, spot_2, lon_2, lat_2, match)."""
    def near(key, ref, cols):
        if any(key[c] is None or ref[c] is None for c in cols):
            return None
        d = jaro_distances([key[c] for c in cols], [ref[c] for c in cols])
        return d if (d <= 0.1 + 1e-9).all() else None

    def equal(key, ref, cols):
        return all(key[c] is not None and key[c] == ref[c] for c in cols)

    def best(key, refs, cols_of, ranked, uid):
        hits = []
        for r in refs:
            cols = cols_of(r)
            d = near(key, r, cols)
            if d is not None:
                hits.append((round(sum(x for c, x in zip(cols, d) if c in ranked), 9), r[uid], r))
        return min(hits, key=lambda h: h[:2])[2] if hits else None

    out = {}
    named = [s for s in spots if s["spot"] is not None]
    commune = lambda r: ("co", "com", "dpt") if r["co"] == home else ("co", "com")
    for rec in records:
        same = [(None, None, None, s["lon_2"], s["lat_2"], "spot") for s in named if equal(rec, s, ("co", "com", "spot"))]
        if not same:
            s = best(rec, named, lambda r: ("co", "com", "spot"), ("co", "com", "spot"), "id_spo")
            same = [(s["co"], s["com"], s["spot"], s["lon_2"], s["lat_2"], "spot")] if s else []
        if not same:
            same = [(None, None, None, c["lon_2"], c["lat_2"], "com") for c in communes if c["co"] is not None and equal(rec, c, commune(c))]
        if not same:
            c = best(rec, communes, commune, ("co", "com"), "id_co")
            same = [(c["co"], c["com"], None, c["lon_2"], c["lat_2"], "com")] if c else []
        if not same:
            hand = [f for f in found if all(f[c] == rec[c] for c in ("co", "com", "spot"))] if rec["lon"] is None or rec["lat"] is None else []
            same = [(None, None, None, f["lon"], f["lat"], "search") for f in hand] or [(None, None, None, None, None, "-")]
        out[rec["id"]] = sorted(same, key=str)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_follows_its_stages(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("ABCDEÉR -") for _ in range(rng.randrange(1, 13))) for _ in range(12)]

    def slip(w):
        i = rng.randrange(len(w))
        return w if rng.random() < 0.5 else rng.choice([w[:i] + w[i + 1:], w + "S", w[:i] + "Z" + w[i + 1:], w[:i] + w[i:i + 2][::-1] + w[i + 2:]])

    maybe = lambda v: None if rng.random() < 0.15 else v
    countries = ["FRANCE", "FRANCES", "SPAIN", "SPAINE"]
    spots = [dict(co=maybe(rng.choice(countries)), com=maybe(rng.choice(words)), spot=maybe(rng.choice(words)), id_spo=i, lon_2=float(i), lat_2=0.5 * i)
             for i in range(60)]
    communes = [dict(co=maybe(rng.choice(countries)), com=maybe(rng.choice(words)), dpt=maybe(rng.choice(["44", "53"])), id_co=i, lon_2=100.0 + i, lat_2=1.0 * i)
                for i in range(25)]
    foreign = [c for c in communes if c["co"] == "SPAIN"][:3]
    communes += [c | {"id_co": 50 + i, "lon_2": 200.0 + i} for i, c in enumerate(foreign)]  # listed twice: the record comes twice
    records = [dict(id=str(i), co=maybe(rng.choice(countries)), dpt=maybe(rng.choice(["44", "53"])), com=maybe(slip(rng.choice(words))),
                    spot=rng.choice([None, "", slip(rng.choice(words)), slip(rng.choice(words))]), lon=maybe(1.0), lat=maybe(2.0)) for i in range(300)]
    records += [r | {"id": f"again {r['id']}"} for r in records[:20]]
    records += [dict(id=f"f{i}", co=c["co"], dpt=None, com=c["com"], spot=None, lon=None, lat=1.0) for i, c in enumerate(foreign)]
    found = [dict(co=r["co"], com=r["com"], spot=r["spot"], lon=9.0, lat=9.5) for r in records[40:41]]
    found += [dict(co="FRANCE", com="NOWHERE", spot=None, lon=8.0, lat=8.5)]
    records += [dict(id="hand", co="FRANCE", dpt=None, com="NOWHERE", spot=None, lon=None, lat=None)]

    def frame(rows, schema):
        names = [f.split()[0] for f in schema.split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)

    got = resolve.resolve_places(
        frame(records, "id string, co string, dpt string, com string, spot string, lon double, lat double"),
        frame(spots, "co string, com string, spot string, id_spo long, lon_2 double, lat_2 double"),
        frame(communes, "co string, com string, dpt string, id_co long, lon_2 double, lat_2 double"),
        frame(found, "co string, com string, spot string, lon double, lat double")).collect()
    have = {}
    for r in got:
        have.setdefault(r.id, []).append((r.co_2, r.com_2, r.spot_2, r.lon_2, r.lat_2, r.match))
    want = plain(records, spots, communes, found)
    assert {k: sorted(v, key=str) for k, v in have.items()} == want
    kinds = [m[-1] for v in want.values() for m in v]
    assert {"spot", "com", "search", "-"} <= set(kinds) and any(len(v) > 1 for v in want.values())


def test_cascade_without_rows(spark):
    none = spark.createDataFrame([], "id string, co string, dpt string, com string, spot string, lon double, lat double")
    spots = spark.createDataFrame([("FRANCE", "A", "B", 1, 0.0, 0.0)], "co string, com string, spot string, id_spo long, lon_2 double, lat_2 double")
    communes = spark.createDataFrame([], "co string, com string, dpt string, id_co long, lon_2 double, lat_2 double")
    assert resolve.resolve_places(none, spots, communes).count() == 0
    one = spark.createDataFrame([("1", "FRANCE", None, "A", "C", 1.0, 1.0)], none.schema)
    assert [r.match for r in resolve.resolve_places(one, spots.limit(0), communes).collect()] == ["-"]


def test_blocks_of_near_names_stay_small(spark):
    """Names that share one rare character only do not meet."""
    rng = random.Random(4)
    left = ["".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(12)) for _ in range(400)]
    rows = spark.createDataFrame([("x", t) for t in left], "field string, text string")
    pairs = resolve._candidates(rows, rows, 0.1).count()
    assert len(left) <= pairs < len(left) ** 2 / 20
