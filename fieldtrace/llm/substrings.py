"""Removal of long repeated byte strings by suffix order, spread over tasks by content-defined anchors.

Every window of ``LENGTH`` bytes names one anchor: its smallest K-gram by hash, the leftmost of equals.  Equal windows
have equal anchors, so only windows of one anchor need to meet.  A run of neighbouring windows with one anchor is a block,
and a block is one row: hash of the anchor, hash of all bytes of the block.

* An anchor seen once has no repeated window, and a block seen twice has no other: most blocks end here, by counting.
* Where blocks of one anchor differ, one copy of each goes to the anchor's task.  There the suffixes of the blocks are sorted
  by their first ``LENGTH`` bytes, ties by position.  Of all earlier positions the previous and the next smaller one in this order
  share the longest prefix with a suffix, so they give its longest previous factor as far as ``LENGTH``: where it is reached
  the window occurs earlier, and the position that gave it occurs again later.
* An anchor with very many different blocks is not sorted in one task; its windows are counted by hash, each by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Hashes, chunks, flat_text, written

LENGTH, K = 200, 32
#: Different blocks of an anchor that one task sorts, about 3 MB; beyond, windows are counted instead, which costs a row each.
GROUP_BLOCKS = 10_000
#: Bytes of blocks that are sorted at a time, and windows of a text that are worked on at a time.
SORT_BYTES, SEGMENT = 1 << 21, 1 << 22
_PLACE_BITS = np.uint64(24)


def blocks_of(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first window (byte in the row), windows, anchor hash and content hash of every block."""
    n = len(flat)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(flat, lower=False)
    at = np.arange(n - K + 1)
    grams = hashes.of(at, at + K)
    keyed = (grams >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    w = LENGTH - K + 1
    padded = np.full(-(-len(keyed) // w) * w, np.uint64(2**64 - 1))
    padded[:len(keyed)] = keyed
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    starts = n - LENGTH + 1
    anchor = (np.minimum(ahead[:starts], behind[w - 1:w - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    row = np.searchsorted(bounds, np.arange(starts), "right") - 1
    whole = np.arange(starts) + LENGTH <= bounds[1:][row]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) & whole
    first = np.flatnonzero(new)
    last = np.append(first[1:], starts)
    count = np.minimum(last, bounds[1:][row[first]] - LENGTH + 1) - first
    return row[first], first - bounds[:-1][row[first]], count, grams[anchor[first]], hashes.of(first, first + count - 1 + LENGTH)


def _segments(batch: pa.RecordBatch):
    """Slices of the batch's texts of at most about ``SEGMENT`` windows: flat bytes, bounds, row and offset of each piece."""
    flat, bounds = flat_text(batch.column("text"))
    if len(flat) <= SEGMENT + LENGTH:
        yield flat, bounds, np.arange(len(bounds) - 1), np.zeros(len(bounds) - 1, np.int64)
        return
    for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        for s in range(a, max(a + 1, b - LENGTH + 1), SEGMENT):
            piece = flat[s:min(b, s + SEGMENT + LENGTH - 1)]
            yield piece, np.array([0, len(piece)]), np.array([r]), np.array([s - a])


def _windows_equal(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffix order of the given positions by their first ``LENGTH`` bytes, as ranks; equal ranks are equal windows.

    Ranks of 8 bytes, then of 16, 32, 64 and 128 by doubling; two overlapping ranks of 128 make one of ``LENGTH``.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.zeros(n, np.uint64)
    for j in range(8):
        eight = (eight << np.uint64(8)) | padded[j:j + n].astype(np.uint64)
    rank = np.unique(eight, return_inverse=True)[1].astype(np.uint64)
    size = 8
    while size < 128:
        after = np.zeros(n, np.uint64)
        after[:max(n - size, 0)] = rank[size:]
        rank = np.unique(rank << np.uint64(32) | after, return_inverse=True)[1].astype(np.uint64)
        size *= 2
    both = rank[starts] << np.uint64(32) | rank[starts + LENGTH - size]
    return np.unique(both, return_inverse=True)[1]


def repeated_windows(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window of the blocks, in order: whether it occurs elsewhere, and whether it occurs earlier.

    Blocks lie behind each other in ``data`` in the order of their first occurrence; ``copies`` of a block makes all its
    windows occur elsewhere.
    """
    block = np.repeat(np.arange(len(begins)), counts)
    starts = begins[block] + np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    source = previous_factors(starts, _windows_equal(data, starts))
    earlier = source >= 0
    again = np.zeros(len(starts), bool)
    again[source[earlier]] = True
    return earlier | again | (copies[block] > 1), earlier


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the previous and of the next smaller value of each of the distinct values; -1 and the length where there is none.

    All places look at once; who meets a larger value goes on to where that one has got, as all between are larger still.
    """
    n = len(values)
    out = []
    for flipped in (values, values[::-1]):
        at, place = np.arange(n) - 1, np.arange(n)
        while len(place):
            place = place[(at[place] >= 0) & (flipped[at[place]] > flipped[place])]
            at[place] = at[at[place]]
        out.append(at)
    return out[0], n - 1 - out[1][::-1]


def previous_factors(starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each suffix an earlier one with the same first ``LENGTH`` bytes, -1 if its longest previous factor is shorter.

    ``rank`` is the order of the suffixes by these bytes, equal for equal ones.
    """
    order = np.lexsort((starts, rank))
    source = np.full(len(starts), -1)
    for neighbour in smaller_neighbours(starts[order]):
        there = np.flatnonzero((neighbour >= 0) & (neighbour < len(order)))
        mine, other = order[there], order[neighbour[there]]
        long = rank[mine] == rank[other]
        source[mine[long]] = other[long]
    return source


def _ranges(mask: np.ndarray, counts: np.ndarray) -> list[list[dict]]:
    """Runs of set windows in each block, from and to."""
    out = []
    for part in np.split(mask, np.cumsum(counts)[:-1]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
        out.append([{"f": int(a), "t": int(b)} for a, b in zip(edges[::2], edges[1::2])])
    return out


_RANGES = pa.list_(pa.struct([("f", pa.int32()), ("t", pa.int32())]))
_RANGES_DDL = "array<struct<f:int,t:int>>"


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", earlier: bool = True) -> tuple[DataFrame, DataFrame]:
    """(source, spans): the rows as key, text_key, text, and per row with repeats its spans of windows; both have the row's id
    ``doc`` with ``earlier``, as of rows equal in key and text only one is the first then.

    A span is the first window times 256 plus the number of windows; these occur at an earlier place in the order of key, then
    of text, or without ``earlier`` at any other place.
    """
    source = docs.select(F.col(key).cast("long").alias("key"), F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)).alias("text_key"),
                         F.coalesce(text, F.lit("")).alias("text"))
    numbered = source.withColumn("doc", F.monotonically_increasing_id())
    if earlier:
        source = numbered = written(numbered)  # the ids must be the same at the end

    def cut(batches):
        for batch in chunks(batches, "text"):
            docs_, keys, text_keys = batch.column("doc"), batch.column("key"), batch.column("text_key")
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([docs_, keys, text_keys, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()),
                                              none.cast(pa.int64())], names=names)
            for flat, bounds, rows, offset in _segments(batch):
                row, low, count, anchor, content = blocks_of(flat, bounds)
                if len(row):
                    none = pa.nulls(len(row))
                    yield pa.RecordBatch.from_arrays([
                        docs_.take(pa.array(rows[row])), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(low + offset[row]),
                        pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))], names=names)

    names = ["doc", "key", "text_key", "low", "n", "anchor", "content"]
    made = written(numbered.mapInArrow(
        cut, "doc long, key long, text_key binary, low long, n int, anchor long, content long"))  # a row for each text, then its blocks
    blocks = made.where("n is not null").select("doc", "low", "n", "anchor", "content")
    who = made.where("n is null").select("doc", "key", "text_key")
    seen = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("c > 1")
    rows = written(blocks.join(seen.select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchor"))

    alike, mixed = rows.where("not mixed").drop("mixed"), rows.where("mixed").drop("mixed")
    if earlier:
        alike, mixed = alike.join(who, "doc"), mixed.join(who, "doc")
    kind = mixed.groupBy("anchor", "content").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"),
                                                  F.min(F.struct(*(["key", "text_key"] if earlier else []), "doc", "low")).alias("first"))
    sizes = mixed.groupBy("anchor").agg(F.approx_count_distinct("content").alias("kinds"))
    kinds = written(kind.join(sizes, "anchor"))
    content = _content(source, kinds.join(who.withColumnsRenamed({"doc": "d", "key": "k", "text_key": "tk"}), F.col("first.doc") == F.col("d")))
    found = _sorted(content.where(F.col("kinds") <= GROUP_BLOCKS))
    if not kinds.where(F.col("kinds") > GROUP_BLOCKS).isEmpty():
        found = found.unionByName(_counted(content.where(F.col("kinds") > GROUP_BLOCKS)))
    told = kinds.select("anchor", "content", "first").join(found, ["anchor", "content"])
    every = F.array(F.struct(F.lit(0).alias("f"), F.col("n").alias("t")))
    all_of = F.col("low") * 256 + F.col("n")  # a block has at most LENGTH - K + 1 windows
    met = mixed.join(told, ["anchor", "content"])
    if earlier:
        first = alike.groupBy("anchor").agg(F.min(F.struct("key", "text_key", "doc", "low")).alias("first"))
        whole = alike.join(first, "anchor").where(F.struct("doc", "low") != F.struct("first.doc", "first.low")).select("doc", all_of.alias("span"))
        is_first = (F.col("first.doc") == F.col("doc")) & (F.col("first.low") == F.col("low"))
        part = met.select("doc", "low", F.when(is_first, F.col("later")).otherwise(every).alias("ranges"))
    else:
        whole = alike.select("doc", all_of.alias("span"))
        part = met.select("doc", "low", F.col("any").alias("ranges"))
    part = part.select("doc", "low", F.explode("ranges").alias("r")).select(
        "doc", ((F.col("low") + F.col("r.f")) * 256 + F.col("r.t") - F.col("r.f")).alias("span"))
    spans = whole.unionByName(part).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    if earlier:
        return source, spans
    # Rows that are equal in key and text are one text here: what any of them loses, each loses.
    return source, spans.join(who, "doc").groupBy("key", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _content(source: DataFrame, kinds: DataFrame) -> DataFrame:
    """anchor, content, kinds, copies, low, key, text_key, data: the bytes of one copy of each block, repeated where a row is repeated."""
    wanted = kinds.select("k", "tk", F.struct("anchor", "content", "kinds", "copies", F.col("first.low").alias("low"), "n").alias("x")).groupBy("k", "tk").agg(F.collect_list("x").alias("wanted"))
    whole = ["anchor", "content", "kinds", "copies", "low"]

    def take(batches):
        for batch in chunks(batches, "text"):
            lists = batch.column("wanted")
            wants = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            low, n = wants.field("low").to_numpy(), wants.field("n").to_numpy()
            flat, bounds = flat_text(batch.column("text"))
            data = flat.tobytes()
            at = bounds[owner] + low
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays([wants.field(c) for c in whole] + [batch.column("key").take(of), batch.column("text_key").take(of), pa.array([data[a:b] for a, b in zip(at.tolist(), (at + n - 1 + LENGTH).tolist())], pa.binary())],
                names=[*whole, "key", "text_key", "data"])

    met = source.join(wanted, source["key"].eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("tk"))).select("key", "text_key", "text", "wanted")
    return met.mapInArrow(take, "anchor long, content long, kinds long, copies long, low long, key long, text_key binary, data binary")


def _sorted(content: DataFrame) -> DataFrame:
    """Ranges of repeated windows of each block by suffix order; all blocks of an anchor are in one partition."""
    def lots(batches):
        held, size = [], 0
        for batch in batches:
            anchors = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchors)]):
                if held and size > SORT_BYTES and held[-1].column("anchor")[0].as_py() != anchors[a]:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += (b - a) * 2 * LENGTH
        if held:
            yield pa.Table.from_batches(held)

    def sort(batches):
        for lot in lots(batches):
            once = np.flatnonzero(np.append(True, np.diff(lot["content"].to_numpy()) != 0))  # a repeated row brings its blocks twice
            lot = lot.take(pa.array(once))
            pieces = lot["data"].to_pylist()
            counts = np.array([len(p) - LENGTH + 1 for p in pieces])
            begins = np.concatenate([[0], np.cumsum(counts + LENGTH - 1)[:-1]])
            any_, later = repeated_windows(np.frombuffer(b"".join(pieces), np.uint8), begins, counts, lot["copies"].to_numpy())
            yield pa.RecordBatch.from_arrays([
                lot["anchor"].combine_chunks(), lot["content"].combine_chunks(), pa.array(_ranges(any_, counts), _RANGES),
                pa.array(_ranges(later, counts), _RANGES)], names=["anchor", "content", "any", "later"])

    return content.drop("kinds").repartition("anchor").sortWithinPartitions("anchor", "key", "text_key", "low").mapInArrow(
        sort, f"anchor long, content long, any {_RANGES_DDL}, later {_RANGES_DDL}")


def _counted(content: DataFrame) -> DataFrame:
    """The same for anchors with very many blocks: windows are rows, counted by anchor and hash."""
    def windows(batches):
        for batch in batches:
            for part in batch.to_pylist():
                flat = np.frombuffer(part["data"], np.uint8)
                at = np.arange(len(flat) - LENGTH + 1)
                same = [pa.array(np.full(len(at), part[c])) for c in ("anchor", "content", "copies", "low")]
                same += [pa.array([part[c]] * len(at), kind) for c, kind in (("key", pa.int64()), ("text_key", pa.binary()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at.astype(np.int32)), pa.array(Hashes(flat, lower=False).of(
                    at, at + LENGTH).view(np.int64))], names=["anchor", "content", "copies", "low", "key", "text_key", "at", "window"])

    rows = content.dropDuplicates(["anchor", "content"]).mapInArrow(
        windows, "anchor long, content long, copies long, low long, key long, text_key binary, at int, window long")
    rows = rows.withColumn("place", F.struct("key", "text_key", "low", "at"))
    counts = rows.groupBy("anchor", "window").agg(F.sum("copies").alias("times"), F.min("place").alias("earliest")).where("times > 1")
    one = F.struct(F.col("at").alias("f"), (F.col("at") + 1).alias("t"))
    return rows.join(counts, ["anchor", "window"]).groupBy("anchor", "content").agg(
        F.sort_array(F.collect_list(one)).alias("any"), F.sort_array(F.collect_list(F.when(F.col("place") != F.col("earliest"), one))).alias("later"))


def _removed(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows of the spans."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        s, e = x >> 8, (x >> 8) + (x & 255) - 1 + LENGTH
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_first: bool = True) -> DataFrame:
    """Per document row: key, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256.

    Texts are judged as UTF-8 bytes, null as empty.  A byte goes if it lies in a string of 200 bytes that also starts
    elsewhere, in the same text or another; with ``keep_first`` only if that is an earlier place, in the order of key, then
    of text.  Texts below 200 bytes stay whole.  Rows that are equal in key and text get one result, but with ``keep_first`` one of
    them, any, comes before the others.  An empty table gives no rows; other columns are not read.
    """
    source, spans = find_repeats(docs, key, text, keep_first)
    schema = pa.schema([("key", pa.int64()), *[(c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")], ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def cut(batches):
        for batch in chunks(batches, "text"):
            rows = []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = t.encode()
                gone = _removed(found)
                kept = b"".join(data[a:b] for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(data)]))
                rows.append((len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)

    if keep_first:
        met = source.join(spans, "doc", "left").select("key", "text", "spans")
    else:
        right = spans.withColumnsRenamed({"key": "k", "text_key": "tk"})
        met = source.join(right, source["key"].eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("tk")), "left").select("key", "text", "spans")
    return met.mapInArrow(cut, "key long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("key", key)
