"""Hierarchical residual packing of token pieces into sequences of a fixed length.

Each task packs its own pieces best-fit, longest first, and emits the nearly full sequences.  The underfull
ones become items: groups of tasks' leftovers are packed again as whole bins, group by group up a tree, until
one group is left.

What goes up is bounded whatever the data.  After best-fit at most one bin of a group is at most half full,
and a fuller bin can only take in one of those; with G groups in a round, more than G equally filled bins
can never all find a partner, so the rest of them are emitted as they are.  A group thus hands on at
most 1 + G rows for each of the fills above half.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import chunks, written
from fieldtrace.llm.tokens import encoder

FAN_IN = 8
#: A sequence with at most this share of free room is nearly full.
FREE_SHARE = 0.02

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill int"
ITEMS = "bin long, fill int, leaves array<long>, bases array<int>, done boolean"


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item and the fill of every bin; longest items first, each to the tightest bin.

    Open bins hang on their free room; a bit set of the rooms in use gives the smallest that is enough.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        enough = used >> n
        if enough:
            free = n + (enough & -enough).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, b = room, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = free - n
        by_free[left].append(b)
        used |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """Start and length of the pieces: whole if it fits, else full pieces after a first one with the rest."""
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))] if n > room else [(0, n)]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, room: int = 2048, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every text, null as an empty one, gives its ids and the end id; only documents longer than ``room`` are
    cut.  Rows are packed one by one, so repeated rows and null keys each get their own place; other columns
    are not read; an empty table gives no rows.  Offsets within a sequence are gapless from 0.
    """
    end = struct.pack("<I", end_id)
    near = int(room * (1 - FREE_SHARE))

    def local(batches):
        encode, rows = encoder(tokenizer), []
        for batch in chunks(batches, text):
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                ids = encode(t) + end
                for j, (s, n) in enumerate(cut(len(ids) // 4, room)):
                    rows.append((k, j, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])))
            if len(rows) >= 1 << 18:  # about 20 MB; a larger partition is packed in several lots
                yield from placed(rows)
                rows = []
        yield from placed(rows)

    lots = iter(range(1 << 20))

    def placed(rows):
        if not rows:
            return
        bins, offsets, fills = best_fit(np.array([r[3] for r in rows], np.int64), room)
        base = (TaskContext.get().partitionId() << 40) + (next(lots) << 20)
        doc, piece, start, length, crc = zip(*rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(crc, pa.int64()), pa.array(base + bins), pa.array(offsets), pa.array(fills[bins].astype(np.int32))],
            names=[c.split()[0] for c in PIECES.split(", ")])

    pieces = written(docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(local, PIECES))
    merged = _merge_up(pieces, room, near)
    if merged is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(merged, F.col("bin") == F.col("leaf"), "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def _merge_up(pieces: DataFrame, room: int, near: int) -> DataFrame | None:
    """Where the underfull bins of the first round ended: leaf, sequence, base."""
    lot = F.shiftright("bin", 20)
    items = pieces.where((F.col("offset") == 0) & (F.col("fill") < near)).select(
        "bin", "fill", F.array("bin").alias("leaves"), F.array(F.lit(0)).alias("bases"), F.lit(False).alias("done"))
    groups = pieces.agg(F.countDistinct(lot)).first()[0]
    if groups <= 1:
        return None
    ended, todo = [], items.withColumn("grp", F.pmod(F.xxhash64(lot), F.lit(groups)))
    while groups > 1:
        groups = -(-groups // FAN_IN)
        packed = written(todo.withColumn("grp", F.floor(F.col("grp") / FAN_IN)).groupBy("grp").applyInPandas(
            _round(room, near, groups), f"grp long, {ITEMS}"))
        ended.append(packed.where("done"))
        todo = packed.where("not done")
    ended.append(todo)
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.select(F.col("bin").alias("sequence"), F.explode(F.arrays_zip("leaves", "bases")).alias("x")).select(
        F.col("x.leaves").alias("leaf"), "sequence", F.col("x.bases").alias("base"))


def _round(room: int, near: int, groups: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", kind="stable")
        fill = pdf["fill"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(fill, room)
        first = np.full(len(fills), -1, np.int64)
        leaves: list[list[int]] = [[] for _ in fills]
        bases: list[list[int]] = [[] for _ in fills]
        for i, (b, o, name, ls, bs) in enumerate(zip(bins, offsets, pdf["bin"], pdf["leaves"], pdf["bases"])):
            if first[b] < 0:
                first[b] = name
            leaves[b].extend(ls)
            bases[b].extend(int(x) + int(o) for x in bs)
        done = fills >= near
        seen: dict[int, int] = defaultdict(int)
        for b in range(len(fills)):
            if not done[b] and 2 * fills[b] > room:
                seen[int(fills[b])] += 1
                done[b] = seen[int(fills[b])] > groups
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "bin": first, "fill": fills.astype(np.int32),
                             "leaves": leaves, "bases": bases, "done": done | (groups == 1)})

    return pack
