"""Repaired conversations against a search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import types as T

from fieldtrace.llm import repair as R
from fieldtrace.llm.common import table
from fieldtrace.llm.queries import QUERIES

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
LEGAL = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(R.WHITE)
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Every way to edit the rows from the front on, with two insertions in a row at most; the tail is solved once."""
    @cache
    def best(k, state, inserted):
        found = []
        if k == len(rows) and state in "0a":
            found.append((0, "", ()))
        after = {"0": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 2:
            for role in after.replace("s", ""):
                found += add(best(k, role, inserted + 1), 2, "I", ((role, None),))
        if k < len(rows):
            found += add(best(k + 1, state, 0), 3, "D", ())
            if faults[k] not in "bd":
                more = faults[k] == "t"
                own = rows[k][2][:1]
                if own and own in after:
                    found += add(best(k + 1, own, 0), more, "K", ((own, k),))
                for role in after.replace("s", ""):
                    found += add(best(k + 1, role, 0), 2 + more, "R", ((role, k, "R"),))
        return min(found, default=None)

    def add(rest, cost, letter, line):
        return [] if rest is None else [(rest[0] + cost, letter + rest[1], line + rest[2])]

    return best(0, "0", 0)


def brute(rows, ids=None):
    by = {c: [] for c in (ids or [])}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2][:32], hashlib.sha256(r[2].encode()).hexdigest(), r[3][:32], hashlib.sha256(r[3].encode()).hexdigest()))
        faults = faults_of(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        letters = [r[2][:1] for r in mine]
        cost, audit, lines = cheapest(mine, faults)
        assert LEGAL.fullmatch("".join(x[0] for x in lines))
        told = []
        for line in lines:
            role = {"u": "user", "a": "assistant"}.get(line[0])
            told.append(f"{role}:" if line[1] is None else f"{role if len(line) == 3 else mine[line[1]][2]}:{mine[line[1]][3]}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:])), cost, audit,
                     hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def rows_of(df):
    got = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}
    assert len(out) == len(got)
    return out


def made(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ubu", None])
            text = rng.choice(["Yes.", "No!", "so", "it is ", " \t", "", None, "well?\n", f"{conv} {turn}.", "é "])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


def test_agenda_against_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        codes = [rng.choice("ssuuaax") + rng.choice("---tbd") for _ in range(rng.randint(0, 8))]
        fake = [(0, 0, {"x": ""}.get(c[0], c[0]), "") for c in codes]
        want = cheapest(fake, [c[1] for c in codes])[:2]
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, 2))) if len(codes) > 1 else []
        runs = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)]) if j > i]
        solved = [{(s, e): w for s in range(4) for e, w in R.solve_run(run, s).items()} for run in runs]
        weight, parts = R.join_runs(solved)
        assert weight == want and "".join(p for _, p in parts) == want[1]


def test_agenda_stops_at_the_goal():
    taken = []
    R.lightest({0: (0, "")}, lambda i: taken.append(i) or [(i + 1, 1, "x")], lambda i: i, {5})
    assert taken == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("bits", [12, 1])
def test_report_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(R, "RUN_BITS", bits)
    monkeypatch.setattr(R, "RUN_ROWS", 1 << bits)
    rows = made(2, 60)
    clean = [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in rows]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS place", "'x' AS code", "2 AS head")
    assert rows_of(R.repair_report(df)) == brute(clean)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damage(rows), {r[0] for r in rows})
    assert rows_of(QUERIES["op11_conversation_repair"](spark, sf)) == want
    assert len({w[6] for w in want.values()}) > 10


def test_odd_conversations(spark):
    rows = made(5, 40) + [(900, 0, "user", "x" * 300000 + "."), (900, 1, "assistant", "y. " * 100000), (901, 2**62, "user", "a."), (901, 2**62, "user", "a.")]
    df = spark.createDataFrame(rows, ROWS)
    assert rows_of(R.repair_report(R.damaged(df), df)) == brute(damage(rows), {r[0] for r in rows})
    assert rows_of(R.repair_report(df.limit(0))) == {}
    empty = rows_of(R.repair_report(df.limit(0), df.where("conv_id = 900")))
    assert empty == {900: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_long_conversation(spark):
    rng = random.Random(9)
    codes = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{i}.", f"{i}"])) for i in range(9000)]
    got = rows_of(R.repair_report(spark.createDataFrame(codes, ROWS)))[7]
    faults = faults_of(codes)
    # The lightest cost by a plain table over rows and last roles.
    cost = {"0": 0}
    steps = {"0": "su", "s": "u", "u": "a", "a": "u"}
    for (_, _, role, _), fault in zip(codes, faults):
        for _ in range(2):
            for s, c in list(cost.items()):
                for r in steps[s].replace("s", ""):
                    cost[r] = min(cost.get(r, 1e9), c + 2)
        new = {s: c + 3 for s, c in cost.items()}
        if fault != "d":
            for s, c in cost.items():
                for r in steps[s]:
                    if r != "s" or role == "system":
                        new[r] = min(new.get(r, 1e9), c + (fault == "t") + 2 * (r != role[0]))
        cost = new
    for _ in range(2):
        for s, c in list(cost.items()):
            for r in steps[s].replace("s", ""):
                cost[r] = min(cost.get(r, 1e9), c + 2)
    assert got[5] == min(cost.get("0", 1e9), cost["a"]) and len(re.sub("I", "", got[6])) == 9000
