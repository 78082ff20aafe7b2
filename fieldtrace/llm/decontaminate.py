"""Benchmark decontamination with DataFrame functions only.

The word windows of the benchmark are a small table of 64-bit hashes with their wording and items.  Every document is
read once.  A window of L words covers at least one of the blocks of (L + 1) // 2 words that stand at every
L - (L + 1) // 2 + 1 words of the document, so only these blocks meet the benchmark's own blocks; around a block that
is known, each window is looked up and its words are compared.  Only hits and one row per document are shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import written

#: Between words: ASCII characters that are neither letters nor digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Largest benchmark table, in bytes of wording, hashes and item names, that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def words_of(text: str) -> Column:
    """The words as they are written; ``_lower`` gives the form in which they are compared."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once and not once per element of what ``body`` makes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word_hashes(words: Column) -> Column:
    """Hashes that do not depend on case: words that are equal after lower-casing A-Z have equal ones."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _block(length: int) -> tuple[int, int]:
    """Words of a block and the step between blocks for windows of ``length`` words."""
    size = (length + 1) // 2
    return size, length - size + 1


def _blocks(hashes: Column, size: int, step: int) -> Column:
    last = F.size(hashes) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.xxhash64(F.slice(hashes, i + 1, size)))
                  ).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """length, wording, hashes (of the words), items of the distinct windows.

    An item with fewer than ``n`` words, but not none, is one window.
    """
    size = F.size("words")
    length = F.least(F.lit(n), size)
    items = benchmark.select(F.col(key).cast("string").alias("item"), words_of(text).alias("words")).where(size > 0)
    at = items.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), size - length + 1)).alias("at"))
    window = at.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("window"))
    wording = window.select("item", "length", _lower(F.array_join("window", " ")).alias("wording"), _word_hashes(F.col("window")).alias("hashes"))
    return wording.groupBy("length", "wording").agg(F.first("hashes").alias("hashes"), F.collect_set("item").alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text",
                       item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: ``key``, text_hash, n_words, n_hit, items (sorted as strings), spans, contaminated.

    ``spans`` holds start (in words, from 0) and length of every occurrence of a benchmark window.  A null or
    empty text has no words; a null item key keeps its windows, which hit without naming an item; an empty
    benchmark hits nothing; repeated rows each give a row; other columns are not read.  The
    benchmark tables are broadcast up to ``broadcast_bytes`` and joined by their hashes beyond.
    """
    windows = written(benchmark_windows(benchmark, n, item, item_text))
    facts = windows.agg(F.collect_set("length").alias("lengths"), F.sum(
        F.octet_length("wording") + 200 + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 16)).alias("bytes")).first()
    lengths = sorted(facts["lengths"], reverse=True) or [n]
    small = F.broadcast if (facts["bytes"] or 0) <= broadcast_bytes else (lambda t: t)
    parts = [windows.where(F.col("length") == m).select(
        F.lit(m).alias("b_length"), F.explode(_blocks(F.col("hashes"), _block(m)[0], 1)).alias("b_hash")) for m in lengths]
    blocks = parts[0]
    for part in parts[1:]:
        blocks = blocks.unionByName(part)
    blocks = blocks.distinct()

    read = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    n_words = F.size("words")
    mark = F.array(F.xxhash64("key", "text_hash"))  # stands for the document itself; its length 0 meets no block
    hashed = read.select("key", "text_hash", "words", _let(
        _word_hashes(F.col("words")), lambda h: F.concat(mark, *[_blocks(h, *_block(m)) for m in lengths])).alias("hashes"))
    place = hashed.select("key", "text_hash", "words", F.posexplode("hashes").alias("pos", "hash"))
    length, start, before = F.lit(0), F.lit(-1), F.lit(1)
    for m in lengths:  # blocks of the lengths follow each other in the array, after the mark
        size, step = _block(m)
        mine = F.col("pos") >= before
        length, start = F.when(mine, F.lit(m)).otherwise(length), F.when(mine, (F.col("pos") - before) * step).otherwise(start)
        before = before + F.greatest(F.floor((n_words - size) / step).cast("int") + 1, F.lit(0))
    place = place.select("key", "text_hash", "words", "hash", length.alias("length"), start.alias("start"))
    # Compared by a difference, so that the hash alone is the key of the join.
    met = place.join(small(blocks), (F.col("hash") == F.col("b_hash")) & (F.col("b_length") - F.col("length") == 0), "left").where(
        (F.col("length") == 0) | F.col("b_hash").isNotNull())
    reach = F.col("length") - F.floor((F.col("length") + 1) / 2).cast("int")
    first, last = F.greatest(F.col("start") - reach, F.lit(0)), F.least(F.col("start"), n_words - F.col("length"))
    around = met.select("key", "text_hash", n_words.alias("n_words"), "words", "length", F.explode(
        F.when(F.col("length") == 0, F.array(F.lit(-1))).when(last >= first, F.sequence(first, last)).otherwise(
            F.array().cast("array<int>"))).alias("start"))
    wording = _lower(F.array_join(F.slice("words", F.greatest(F.col("start") + 1, F.lit(1)), F.col("length")), " "))
    said = F.when(F.col("length") > 0, wording).otherwise(F.concat(F.lit(" "), F.col("text_hash")))  # no wording starts with a space
    tried = around.select("key", "text_hash", "n_words", "start", "length", said.alias("said"))
    hits = tried.join(small(windows.select("wording", "items")), F.col("said") == F.col("wording"), "left").where(
        (F.col("length") == 0) | F.col("wording").isNotNull()).select(
        "key", "text_hash", "n_words", "items", F.when(F.col("length") > 0, F.struct("start", "length")).alias("span"))
    found = hits.groupBy("key", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(F.col("span").isNull()).cast("int").alias("_rows"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")))
    rows = found.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))))
    return rows.select(F.col("key").alias(key), "text_hash", "n_words", covered["n"].cast("long").alias("n_hit"), "items",
                       "spans", (F.size("spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they are, without an occurrence of a benchmark window.

    Null and empty texts stay; repeated rows stay or go together; an empty table or benchmark leaves the documents as
    they are; columns may have any names.
    """
    bad = find_contamination(docs, benchmark, n, key, text).where("contaminated").select(
        F.col(key).alias("_bad_key"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["_bad_key"]) & (F.xxhash64(docs[text]) == bad["_bad_hash"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns as they are, with the words of every hit, and what follows each up to the next word, removed.

    Null and empty texts stay as they are; repeated rows stay repeated; an empty table or benchmark changes nothing;
    columns may have any names.
    """
    found = find_contamination(docs, benchmark, n, key, text).where("contaminated").select(
        F.col(key).alias("_bad_key"), F.col("text_hash").alias("_bad_hash"), "spans").dropDuplicates(["_bad_key", "_bad_hash"])
    spans = found["spans"]
    met = docs.join(found, docs[key].eqNullSafe(found["_bad_key"]) & (F.xxhash64(docs[text]) == found["_bad_hash"]), "left")
    letter = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(docs[text], F.lit(f"{letter}+(?:(?!{letter})[\\s\\S])*"), F.lit(0))
    lead = F.regexp_extract(docs[text], f"^(?:(?!{letter})[\\s\\S])*", 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["start"] + s["length"])))
    return met.select(*[F.when(spans.isNull(), docs[c]).otherwise(F.concat(lead, F.array_join(kept, ""))).alias(c)
                        if c == text else docs[c] for c in docs.columns])
