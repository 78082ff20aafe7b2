"""Cheapest repair of damaged conversations by lightest derivations.

A conversation is legal if its roles follow ``(s?(ua)+)?`` by their first letters.  Repairs are deductions: the item
(k, q) says that the first k rows have become a legal beginning whose last role is q.  A row's edit, or an inserted row,
leads from one item to another and adds its cost and its letter.  The agenda takes items by (cost, rows, audit): every
rule adds to cost or to rows, so a rule's result never comes before its premise, and the weight that an item has when
it is taken is its lightest one (Knuth's generalisation of shortest paths).  It ends when the goal is taken.

Audits of one item and equal cost never begin with one another, since letters settle how many rows are used and what
they cost.  So their order stays the same when anything is put before or behind them, and whole runs of rows can be
solved on their own: for each role that a run may start after, the lightest way to each role it may end with.  These
ways are themselves weights of rules on the next level, one item per run.  A conversation of any length is cut into runs
of ``RUN_ROWS`` rows at most.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import written

RUN_BITS = 12
RUN_ROWS = 1 << RUN_BITS
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: What the last role is: none yet, system, user, assistant; a conversation may end in the first and the last.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_ROLES = {"u": "user", "a": "assistant"}
#: The role that may follow, other than a system row at the beginning.
_WANTED = {NONE: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
LEGAL_PAIRS = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
Item = Hashable


def lightest(axioms: dict[Item, Weight], rules: Callable[[Item], Iterable[tuple[Item, int, str]]], rank: Callable[[Item], int],
             goals: set) -> dict[Item, tuple[Weight, Item | None]]:
    """Lightest weight of each goal that can be derived, with the item it came from, and of all items taken before.

    ``rules`` names the conclusions of an item with the cost and the audit that they add; a conclusion of no cost
    must have a higher rank.
    """
    best: dict[Item, tuple[Weight, Item | None]] = {i: (w, None) for i, w in axioms.items()}
    agenda = [(w[0], rank(i), w[1], i) for i, w in axioms.items()]
    heapq.heapify(agenda)
    taken, left = set(), len(goals)
    while agenda and left:
        cost, _, audit, item = heapq.heappop(agenda)
        if item in taken:
            continue
        taken.add(item)
        left -= item in goals
        for head, more, letters in rules(item):
            weight = (cost + more, audit + letters)
            if head not in taken and (head not in best or weight < best[head][0]):
                best[head] = (weight, item)
                heapq.heappush(agenda, (weight[0], rank(head), weight[1], head))
    return {i: best[i] for i in taken}


def row_edits(code: str, state: int) -> list[tuple[int, int, str]]:
    """(role after it, cost, letter) of what may be done with a row; ``code`` is its role's letter and its fault."""
    role, fault = code
    out = [(state, DELETE, "D")]
    if fault not in "bd":
        more = CUT_SHORT if fault == "t" else 0
        if (state, role) in _NEXT:
            out.append((_NEXT[state, role], KEEP + more, "K"))
        out.append((_NEXT[state, _WANTED[state]], REROLE + more, "R"))
    return out


def solve_run(codes: list[str], start: int) -> dict[int, Weight]:
    """Lightest way through the rows from one role to every role at the end."""
    n = len(codes)

    def rules(item):
        k, state = item
        yield (k, _NEXT[state, _WANTED[state]]), INSERT, "I"
        if k < n:
            for after, cost, letter in row_edits(codes[k], state):
                yield (k + 1, after), cost, letter

    # A role once there, one can only return to "none yet" by not leaving it; system needs a kept system row.
    ends = {(n, s) for s in (NONE, SYSTEM, USER, ASSISTANT)}
    if start != NONE:
        ends.discard((n, NONE))
    if start != SYSTEM and not (start == NONE and any(c[0] == "s" and c[1] not in "bd" for c in codes)):
        ends.discard((n, SYSTEM))
    found = lightest({(0, start): (0, "")}, rules, lambda item: item[0], ends)
    return {s: found[n, s][0] for s in range(4) if (n, s) in found}


def join_runs(runs: list[dict[tuple[int, int], Weight]]) -> tuple[Weight, list[tuple[int, str]]]:
    """Lightest repair of a conversation of solved runs, and for each run the role before it and its audit."""
    n = len(runs)

    def rules(item):
        k, state = item
        if k < n:
            for (before, after), (cost, audit) in runs[k].items():
                if before == state:
                    yield (k + 1, after), cost, audit
        elif k == n and state in (NONE, ASSISTANT):
            yield (n + 1, NONE), 0, ""

    goal = (n + 1, NONE)
    found = lightest({(0, NONE): (0, "")}, rules, lambda item: item[0], {goal})
    item, parts = found[goal][1], []
    while found[item][1] is not None:
        before = found[item][1]
        parts.append((before[1], runs[before[0]][before[1], item[1]][1]))
        item = before
    return found[goal][0], parts[::-1]


def carry_out(codes: list[str], state: int, audit: str) -> list[tuple[str, str | None, str, str]]:
    """For each row the letters inserted before it, its role's letter (None: deleted), those after it, its edit."""
    out, before, k = [], "", 0
    for letter in audit:
        if letter == "I":
            before += _WANTED[state]
            state = _NEXT[state, _WANTED[state]]
            continue
        role = {"D": None, "K": codes[k][0], "R": _WANTED[state]}[letter]
        out.append((before, role, "", letter))
        before, k = "", k + 1
        state = state if role is None else _NEXT[state, role]
    if before:
        out[-1] = (*out[-1][:2], before, out[-1][3])
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage that the result's contract describes; nulls become a space."""
    c = {k: F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn", "role", "text")}
    kind = F.pmod(F.crc32(F.concat(c["conv_id"], F.lit(":"), c["turn"]).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(c["text"], ".!?", "")).otherwise(c["text"])
    kept = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(c["role"]).alias("role"),
                       text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kept.withColumn("_copy", F.explode(copies)).drop("_kind", "_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Written rows (conv_id, turn, role, text, place): places rise by conversation and turn, nulls first.

    Equal turns are ordered by role, the first letters and the digest of the text.  Ranges are cut by all of these and
    the row's number, so neither a long conversation nor many equal rows have to fit into one task.
    """
    found = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).select(
        "*", F.substring("role", 1, 32).alias("_r"), F.sha2("role", 256).alias("_s"), F.substring("text", 1, 32).alias("_t"), F.sha2("text", 256).alias("_u"),
        F.monotonically_increasing_id().alias("_n"))
    by = ["conv_id", "turn", "_r", "_s", "_t", "_u", "_n"]
    return written(found.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn", "role", "text").withColumn(
        "place", F.monotonically_increasing_id()))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, code of ordered rows: the role's letter (x: none of s, u, a), then b, d, t or - for the first fault."""
    def white_cut(c: str) -> Column:
        return F.rtrim(F.col(c), F.lit(WHITE))

    letter = F.substring("role", 1, 1)
    whole = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text")
    slim = rows.select("conv_id", "turn", "place", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"),
                       (white_cut("text") == "").alias("blank"), (~F.substring(white_cut("text"), -1, 1).isin(".", "!", "?")).alias("cut"),
                       F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("same"))
    # Only texts that stand twice are met with their first place; the side that adaptive execution can split is the long one.
    first = slim.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    fault = F.when(F.col("blank"), "b").when(F.col("first") < F.col("place"), "d").when(F.col("cut"), "t").otherwise("-")
    return slim.join(first, "same", "left").select("conv_id", "turn", "place", F.concat("letter", fault).alias("code"))


_WAY = "array<struct<before:int,after:int,cost:long,audit:string>>"


def _solve(batches):
    for batch in batches:
        out = []
        for codes, goes_on in zip(batch.column("codes").to_pylist(), batch.column("may_go_on").to_pylist()):
            starts = range(4) if goes_on else (NONE,)
            ways = [{"before": s, "after": e, "cost": c, "audit": a} for s in starts for e, (c, a) in solve_run(codes, s).items()]
            wrong = sum(x[0] + y[0] not in LEGAL_PAIRS for x, y in zip(codes, codes[1:]))
            out.append({"first": codes[0][0], "last": codes[-1][0], "wrong": wrong, "ways": ways})
        kind = pa.struct([("first", pa.string()), ("last", pa.string()), ("wrong", pa.int64()), ("ways", pa.list_(pa.struct(
            [("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
        made = pa.array(out, kind)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("head"), *made.flatten()],
                                         names=["conv_id", "head", "first", "last", "wrong", "ways"])


def _join(batches):
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            (cost, audit), parts = join_runs([{(w["before"], w["after"]): (w["cost"], w["audit"]) for w in r["ways"]} for r in runs])
            wrong = sum(r["wrong"] for r in runs) + sum(x["last"] + y["first"] not in LEGAL_PAIRS for x, y in zip(runs, runs[1:]))
            out.append({"cost": cost, "audit": audit, "illegal": wrong, "parts": [
                {"head": r["head"], "state": s, "part": p} for r, (s, p) in zip(runs, parts)]})
        kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("parts", pa.list_(pa.struct(
            [("head", pa.int64()), ("state", pa.int32()), ("part", pa.string())])))])
        made = pa.array(out, kind)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made.flatten()], names=["conv_id", "cost", "audit", "illegal", "parts"])


def _edit(batches):
    for batch in batches:
        place, lines = [], []
        for row in batch.to_pylist():
            place += row["places"]
            lines += carry_out(row["codes"], row["state"], row["part"])
        before, role, after, edit = zip(*lines) if lines else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64())] + [pa.array(x, pa.string()) for x in (before, role, after, edit)],
                                         names=["place", "before", "letter", "after", "edit"])



def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ordered rows; per conversation its faults, cost and audit; per place the edit and the letters inserted around it."""
    rows = ordered(rows)
    coded = written(with_faults(rows))
    runs = written(coded.groupBy("conv_id", F.shiftright("place", RUN_BITS).alias("slice")).agg(
        F.sort_array(F.collect_list(F.struct("place", "code"))).alias("r")).select(
        # A run that does not begin a slice of places begins its conversation.
        "conv_id", F.col("r.place")[0].alias("head"), (F.pmod(F.col("r.place")[0], F.lit(RUN_ROWS)) == 0).alias("may_go_on"),
        F.col("r.place").alias("places"), F.col("r.code").alias("codes")))
    solved = runs.mapInArrow(_solve, f"conv_id long, head long, first string, last string, wrong long, ways {_WAY}")
    # One row per run: what a conversation gathers is no longer than a few times the audit it has to return.
    gathered = solved.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("head", "first", "last", "wrong", "ways"))).alias("runs"))
    joined = written(gathered.mapInArrow(
        _join, "conv_id long, cost long, audit string, illegal long, parts array<struct<head:long,state:int,part:string>>"))
    parts = joined.select(F.explode("parts").alias("p")).select("p.*")
    edits = runs.join(parts, "head").mapInArrow(_edit, "place long, before string, letter string, after string, edit string")

    def faulty(c: str) -> Column:
        return F.count(F.when(F.substring("code", 2, 1) == c, 1))

    counts = coded.groupBy("conv_id").agg(
        faulty("b").alias("blank"), faulty("d").alias("duplicate"), faulty("t").alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0).cast("long")).alias("gaps"))
    report = counts.withColumnRenamed("conv_id", "_id").join(joined.drop("parts"), F.col("_id").eqNullSafe(F.col("conv_id"))).drop("_id")
    return rows, report, edits


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place, part, role, text of the rows that are left or inserted, in the order of place and part."""
    def inserted(c: str) -> Column:
        return F.transform(F.split(c, ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(F.when(F.col("letter") == "u", "user").otherwise("assistant"))
    own = F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    none = F.array().cast("array<struct<role:string,text:string>>")
    lines = F.concat(F.when(F.col("before") == "", none).otherwise(inserted("before")), F.when(F.col("edit") == "D", none).otherwise(own),
                     F.when(F.col("after") == "", none).otherwise(inserted("after")))
    return rows.join(edits, "place").select("conv_id", "place", F.posexplode(lines).alias("part", "line")).select("conv_id", "place", "part", "line.*")


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and the sha256 of its ``role:text`` lines, joined by newlines.

    A digest can only be made in order, so the lines of a conversation pass through one task; it holds one batch at a time.
    """
    def stream(batches):
        now, state, begun = None, None, False
        for batch in batches:
            done_ids, done = [], []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if not begun or conv != now:
                    if begun:
                        done_ids.append(now)
                        done.append(state.hexdigest())
                    now, state, begun = conv, hashlib.sha256(), True
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done_ids, pa.int64()), pa.array(done, pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    in_order = lines.select("conv_id", "place", "part", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions(
        "conv_id", "place", "part")
    return in_order.select("conv_id", "line").mapInArrow(stream, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text; ``ids`` lists conversations (conv_id) to report even without rows: zeros, an
    empty audit, the digest of the empty string.  A null conv_id is a conversation of its own, null turns come first, null
    roles and texts count as one space, an empty role is none that may be kept.  Rows of one turn are ordered by role and
    text, so repeated rows are duplicates of the first.  Other columns are not read; an empty table gives no rows.
    """
    placed, report, edits = plan_repairs(rows)
    hashed = digests(repaired_rows(placed, edits)).withColumnRenamed("conv_id", "_h")
    found = report.join(hashed, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    if ids is not None:
        every = ids.select(F.col("conv_id").cast("long").alias("_id")).distinct()
        found = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").withColumn("conv_id", F.col("_id"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
