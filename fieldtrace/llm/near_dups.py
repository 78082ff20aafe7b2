"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles, weight = number of occurrences.  Each shingle is a Poisson process
whose rate is its weight; arrivals fall on registers at random and each register keeps the shingle that arrived first, so
two texts agree in a register with the probability of their probability Jaccard similarity.  Arrivals are made for all
shingles of a batch up to a time at which a text's registers should all be taken; a shingle whose first arrival is later
ends there, and only texts with an empty register go on to a later time.

Texts that agree in all registers of a band are candidates.  In each band's bucket one text leads and the others are
compared with it, first by registers, then by their shingles; in small buckets all lead.

Texts of larger buckets that are not of one class then are held against each other by what sets them apart from their
bucket's first leader, the pivot: the shingles that only one of text and pivot holds.  Two texts differ in just the
shingles that are in one of these two differences, and a pair of probability Jaccard t differs in at most
2 (1 - t) / (1 + t) of the longer one's weight (``most_different``).  So pairs are met at the rarest shingles of the
differences, as in a prefix filter with positions, and only those are compared that can be similar enough.  Every pair of
a bucket is compared, in one class, or shown to be below the similarity; no bucket is expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import Hashes, chunks, discard, flat_text, free_name, mix, shingles, words, written
from fieldtrace.llm.components import components

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
WORDS = 5
SIMILARITY = 0.8
#: Registers that must agree before shingles are compared: four standard errors below the similarity.
AGREE = int(REGISTERS * (SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5))
#: In buckets of up to so many texts all lead, in larger ones one does.
ALL_LEAD = 32
#: One in so many texts asks for those that differ from it in little, round by round, as their classes grow; in the end all.
ASKING = (16, 1)


def _salt(i: int) -> np.uint64:
    return np.uint64((i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))


def weighted_shingles(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and number of occurrences of the distinct shingles of each row, sorted by row, then hash."""
    starts, ends, row = words(flat, bounds)
    hashes, row = shingles(Hashes(flat).of(starts, ends), row, len(bounds) - 1, WORDS)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))[:len(hashes)])
    return hashes[first], row[first], np.diff(np.append(first, len(hashes)))


def signatures(hashes: np.ndarray, row: np.ndarray, weight: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """rows x registers of 32-bit shingle names; rows without shingles hold 0."""
    total = np.bincount(row, weight, n_rows)
    out = np.zeros((n_rows, registers), np.uint32)
    todo = total > 0
    limit = np.where(todo, registers * (np.log(registers) + 1) / np.maximum(total, 1), 0)
    while todo.any():
        mine = np.flatnonzero(todo[row])
        h, r, w = hashes[mine], row[mine], weight[mine]
        clock = np.zeros(len(mine))
        points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        draw = 0
        while len(h):  # the next arrival of every shingle still within its text's time
            draw += 1
            x = mix(h + _salt(2 * draw))
            clock = clock - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            inside = clock <= limit[r]
            h, r, w, clock = h[inside], r[inside], w[inside], clock[inside]
            where = mix(h + _salt(2 * draw + 1)) % np.uint64(registers)
            points.append((r * registers + where.astype(np.int64), clock, (h >> np.uint64(32)).astype(np.uint32)))
        place, at, name = (np.concatenate(p) for p in zip(*points))
        order = np.argsort(-at, kind="stable")  # the earliest arrival is written last and stays
        filled = np.zeros(n_rows * registers, bool)
        got = np.zeros(n_rows * registers, np.uint32)
        got[place[order]] = name[order]
        filled[place] = True
        full = filled.reshape(n_rows, registers).all(axis=1) & todo
        out[full] = got.reshape(n_rows, registers)[full]
        todo &= ~full
        limit = limit * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS of 64-bit keys of the bands, different for different bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    total = np.zeros(parts.shape[:2], np.uint64)
    for j in range(ROWS):
        total = mix(total + parts[:, :, j] + _salt(j + 1))
    return mix(total + np.array([_salt(100 + b) for b in range(BANDS)])).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets given as sorted hashes and weights."""
    (x, w), (y, v) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    w1, v1 = w[i].astype(float), v[j].astype(float)
    order = np.argsort(w1 / v1, kind="stable")
    w1, v1 = w1[order], v1[order]
    ratio = w1 / v1
    first = np.searchsorted(ratio, ratio, "left")  # shingles below weigh more in the second text, the others in the first
    w_sums, v_sums = np.append(0, np.cumsum(w1)), np.append(0, np.cumsum(v1))
    only_w, only_v = w.sum() - w1.sum(), v.sum() - v1.sum()
    return float((1 / ((only_w + w_sums[-1] - w_sums[first]) / w1 + (only_v + v_sums[first]) / v1)).sum())


def _text_key(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _has_word(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))


def find_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text_key, first_key (the smallest), class_id, class_key, n_links of every distinct text that holds a word."""
    slim = docs.where(_has_word(text)).select(F.col(key).cast("long").alias("key"), _text_key(text).alias("text_key"), F.col(text).alias("text"))

    def sign(batches):
        for batch in chunks(batches, "text"):
            flat, bounds = flat_text(batch.column("text"))
            sig = signatures(*weighted_shingles(flat, bounds), batch.num_rows)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("text_key"), pa.array([s.astype(np.uint16).tobytes() for s in sig], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(sig) * BANDS + 1, BANDS, dtype=np.int32), band_keys(sig).ravel())],
                names=["key", "text_key", "signature", "bands"])

    signed = slim.mapInArrow(sign, "key long, text_key binary, signature binary, bands array<long>")
    texts = signed.groupBy("text_key").agg(F.min("key").alias("first_key"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()))
    links, classes, stages = _links(texts, slim.select("text_key", "text"))
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    several = texts.select("node", "text_key", "first_key").join(classes, "node")
    first = several.groupBy("component").agg(F.min("first_key").alias("class_id"), F.min("text_key").alias("class_key"))
    found = several.select("node", "component").join(first, "component").join(linked, "node").drop("component")
    out = written(texts.select("node", "text_key", "first_key").join(found, "node", "left").select(
        "text_key", "first_key", F.when(F.col("class_key").isNotNull(), F.col("class_id")).otherwise(F.col("first_key")).alias("class_id"),
        F.coalesce("class_key", "text_key").alias("class_key"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))
    discard(texts, *stages)
    return out


def _links(texts: DataFrame, slim: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Verified links between texts (a, b), the classes that they make (node, component), and the tables both read.

    A round's own tables go as soon as the next ones are written.
    """
    spark = texts.sparkSession
    buckets = texts.select("node", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(buckets.join(sizes, "bucket"))
    # The text that meets most others leads first: it is the likely origin of the copies around it.
    rank = written(members.groupBy("node").agg(F.struct((-F.sum("size")).alias("less"), "node").alias("rank")))
    first, members = members, written(members.select("bucket", "node", "size").join(rank, "node"))
    discard(first)
    wanted = rank.select("node").join(texts.select("node", "text_key"), "node")
    full = written(slim.join(wanted, "text_key").dropDuplicates(["text_key"]).select("node", "text"))
    links = spark.createDataFrame([], "a long, b long")
    classes = spark.createDataFrame([], "node long, component long")
    stages = [full]
    discard(rank)

    def linked(pairs: DataFrame) -> None:
        nonlocal links, classes
        new = _verified(pairs, texts, full)
        stages.append(new)
        if not new.isEmpty():
            links = links.unionByName(new)
            classes = written(components(links, "a", "b"))
            stages.append(classes)

    slot = F.when(F.col("size") <= ALL_LEAD, F.col("node"))  # none in a large bucket, where the first of all leads
    leaders = written(members.groupBy("bucket", slot.alias("slot")).agg(F.min("rank").getField("node").alias("leader")).select("bucket", "leader"))
    stages.append(leaders)
    linked(members.join(leaders, "bucket").where(F.col("node") != F.col("leader")).select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    # Buckets where all have led, or of one class, are done.
    now = members.where(F.col("size") > ALL_LEAD).join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rank").getField("node").alias("pivot")).where("lo <> hi")
    crowd = written(members.join(several.select("bucket", "pivot"), "bucket").select("pivot", "node").distinct())
    stages += [members, crowd]
    if not crowd.isEmpty():
        apart = _differences(crowd, full)
        stages.append(apart)
        for one_in in ASKING:
            linked(_alike(apart, classes, one_in))
    return links, classes, stages


def shingle_sets(full: DataFrame) -> DataFrame:
    """node, its distinct shingles and the number of all."""
    def sets(batches):
        for batch in chunks(batches, "text"):
            h, r, w = weighted_shingles(*flat_text(batch.column("text")))
            at = np.searchsorted(r, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), pa.ListArray.from_arrays(at, h.view(np.int64)),
                pa.array(np.bincount(r, w, batch.num_rows).astype(np.int64))], names=["node", "items", "total"])

    return full.select("node", "text").mapInArrow(sets, "node long, items array<long>, total long")


def most_different(total: Column) -> Column:
    """Shingles that two texts of the asked similarity may have alone, both together, ``total`` being the larger weight.

    If a share x of one text's weight lies on shingles that the other lacks, and y of the other's, their probability
    Jaccard is (1 - x) (1 - y) / (1 - x y) at most; where that is t or more, x + y is 2 (1 - t) / (1 + t) at most, and a
    shingle takes 1 / total of its text's weight at least.
    """
    least = SIMILARITY - 1e-9
    return F.lit(2 * (1 - least) / (1 + least)) * total + 1e-6


def _differences(crowd: DataFrame, full: DataFrame) -> DataFrame:
    """pivot, node, total, differing, largest, marks of each text that may have a similar one in the pivot's crowd.

    ``differing`` counts the shingles that only one of text and pivot holds, ``marks`` are those that set several texts
    apart, the rarest first, with the number of others before each.
    """
    sets = written(shingle_sets(full.join(crowd.select("node").distinct(), "node")))
    pivots = sets.join(crowd.select(F.col("pivot").alias("node")).distinct(), "node").select(F.col("node").alias("pivot"), F.col("items").alias("held"))
    apart = written(crowd.join(sets, "node").join(pivots, "pivot").select(
        "pivot", "node", "total", F.array_except("items", "held").alias("own"), F.array_except("held", "items").alias("lacking")))
    discard(sets)
    each = apart.repartition("pivot", "node").select("pivot", "node", F.size("own").alias("n_own"), F.posexplode(F.concat("own", "lacking")).alias("at", "item"))
    found = each.groupBy("pivot", "item").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min(F.col("at") < F.col("n_own")).alias("mine"))
    # What sets one text apart alone differs from all others; no similar text lacks over 1 - SIMILARITY of its weight.
    alone = found.where("n = 1").groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("alone"), F.count_if("mine").alias("alone_own"))
    largest = apart.groupBy("pivot").agg(F.max("total").alias("largest"))
    able = apart.join(largest, "pivot").join(alone, ["pivot", "node"], "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long"))).where(
        (F.col("alone") <= most_different(F.col("largest"))) & (F.coalesce("alone_own", F.lit(0)) <= (1 - SIMILARITY + 1e-9) * F.col("total") + 1e-6))
    able = written(able.withColumn("items", F.concat("own", "lacking")).select(
        "pivot", "node", "total", "largest", "alone", F.size("items").alias("differing"), "items"))
    shared = able.repartition("pivot", "node").select("pivot", "node", F.explode("items").alias("item")).join(
        found.where("n > 1").select("pivot", "item", "n"), ["pivot", "item"]).groupBy("pivot", "node").agg(
        F.array_sort(F.collect_list(F.struct("n", "item"))).alias("shared"))
    marks = F.transform("shared", lambda x, i: F.struct(x["item"].alias("item"), (F.col("alone") + i).alias("before")))
    out = written(able.drop("items").join(shared, ["pivot", "node"], "left").select(
        "pivot", "node", "total", "differing", "largest", F.filter(marks, lambda m: m["before"] <= most_different(F.col("largest"))).alias("marks")))
    discard(apart, able)
    return out


def _alike(apart: DataFrame, classes: DataFrame, one_in: int) -> DataFrame:
    """Pairs of texts of different classes that may be similar by their differences from a pivot; one in so many texts asks.

    A text of the pivot's class need not ask: of two classes, one is not the pivot's.
    """
    now = apart.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = classes.select(F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
    asking = now.where(F.pmod(F.xxhash64("node"), F.lit(one_in)) == 0).join(own, "pivot", "left").where(
        F.col("component") != F.coalesce("of_pivot", "pivot")).drop("of_pivot").withColumnsRenamed(
        {c: f"my_{c}" for c in ("node", "component", "total", "differing")})
    other = (F.col("component") != F.col("my_component"))
    room = most_different(F.greatest("total", "my_total"))
    # Before the first shingle that both differences hold, none is shared; after it, no more than the shorter rest has.
    marked = now.select("pivot", "node", "component", "total", "differing", F.inline("marks"))
    asked = asking.select("pivot", "my_node", "my_component", "my_total", "my_differing", F.inline("marks")).withColumnRenamed("before", "my_before")
    rest, my_rest = F.col("differing") - F.col("before"), F.col("my_differing") - F.col("my_before")
    met = marked.join(asked, ["pivot", "item"]).where(other & (F.col("before") + F.col("my_before") + F.abs(rest - my_rest) <= room))
    # Two small differences may have nothing in common.
    upto = F.floor(most_different(F.col("largest"))).cast("int") - F.col("my_differing")
    wanted = asking.where(upto >= 0).select("pivot", "my_node", "my_component", "my_total", "my_differing", F.explode(F.sequence(F.lit(0), upto)).alias("differing"))
    small = now.join(wanted, ["pivot", "differing"]).where(other & (F.col("differing") + F.col("my_differing") <= room))
    ends = [F.least("node", "my_node").alias("a"), F.greatest("node", "my_node").alias("b")]
    return met.select(*ends).unionByName(small.select(*ends)).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, full: DataFrame) -> DataFrame:
    """Written pairs whose registers agree well enough and whose shingles are as similar as asked."""
    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    signed = pairs.join(texts.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    likely = written(signed.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long"))

    def compare(batches):
        for batch in batches:
            for part in chunks(chunks([batch], "ta"), "tb"):
                sets = []
                for c in ("ta", "tb"):
                    h, r, w = weighted_shingles(*flat_text(part.column(c)))
                    at = np.searchsorted(r, np.arange(part.num_rows + 1))
                    sets.append([(h[i:j], w[i:j]) for i, j in zip(at[:-1], at[1:])])
                like = [probability_jaccard(x, y) >= SIMILARITY - 1e-9 for x, y in zip(*sets)]
                yield part.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    met = likely.join(full.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
        full.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    found = written(met.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))
    discard(likely)
    return found


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: key, class_id, class_key, n_links.

    ``class_id`` is the smallest key of the class, ``class_key`` names its smallest text digest, ``n_links`` counts the
    verified links of the document's text that were used to join the class; pairs already in one class are not compared.  Equal texts are of one class.  A text without a word (null,
    empty, punctuation) is like no other: its class is its own key, its class_key null.  A text of fewer than five
    words is one shingle.  Null keys join classes like others but never name one that has a key; repeated rows
    each give a row; an empty table gives no rows; other columns are not read.
    """
    rows = docs.where(_has_word(text)).select(F.col(key).cast("long").alias("key"), _text_key(text).alias("text_key"))
    with_words = rows.join(find_classes(docs, key, text), "text_key").select(
        "key", "class_id", F.lower(F.hex("class_key")).alias("class_key"), "n_links")
    without = docs.where(~_has_word(text)).select(F.col(key).cast("long").alias("key"), F.col(key).cast("long").alias("class_id"),
                                                  F.lit(None).cast("string").alias("class_key"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without).withColumnRenamed("key", key)


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one row of each class: that of the smallest key, then the smallest text digest.

    Rows without a word all stay; of repeated rows with one key and one text one stays; an empty table gives no rows;
    columns may have any names.
    """
    order = F.struct(F.col("first_key").isNull().alias("n"), "first_key", "text_key")
    kept = find_classes(docs, key, text).groupBy("class_key").agg(F.min(order).alias("k")).select(
        F.col("k.first_key").alias("_key"), F.col("k.text_key").alias("_text_key"))
    my_text, my_key = free_name(docs, "_text_key"), free_name(docs, "_key")
    marked = docs.where(_has_word(text)).withColumn(my_text, _text_key(text)).withColumn(my_key, F.col(key).cast("long"))
    # One text can hold a third of all rows; only rows that carry a kept key as well go on to be told apart.
    mine = marked.join(kept, (marked[my_text] == kept["_text_key"]) & marked[my_key].eqNullSafe(kept["_key"]), "left_semi")
    one = mine.dropDuplicates([my_text, my_key]).select(*docs.columns)
    return one.unionByName(docs.where(~_has_word(text)))
