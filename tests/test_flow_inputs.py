"""Inputs of the flows at size (findings of round 3)."""

from fieldtrace.catalog import all_queries
from fieldtrace.plans import dataset


def test_rules_of_the_timeline_pair_no_events_with_parts(tables, monkeypatch):
    seen = {}

    def keep(raw, spots, communes, rules, **more):
        seen["rules"] = rules
        raise StopIteration

    monkeypatch.setattr(dataset, "build_dataset", keep)
    try:
        all_queries()["dataset_timeline"].run(tables)
    except StopIteration:
        pass
    rules = seen["rules"]
    assert "Join" not in rules._jdf.queryExecution().optimizedPlan().toString()
    parts = tables.part.count()
    brands = {r.p_partkey: r.p_brand for r in tables.part.collect()}
    want = {f"{r.event_id}_t_controle" for r in tables.events.where("event_type in ('view', 'click')").collect()
            if r.event_id % 13 == 0 and 1 + r.event_id % parts in brands}
    assert want and {r.id for r in rules.collect()} == want
    assert {(r.field, r.op) for r in rules.collect()} == {("lon", "negate")}
