"""Spelling variants by a trie of letter counts.

A word is described by how many of its letters fall into each of ``GROUPS`` letter groups; the counts, group after group,
are the path of the word in a trie.  One inserted, deleted or replaced letter changes at most two counts: one goes up by
one (a surplus), one goes down by one (a deficit).  A depth-first search follows every child whose count differs by a
part of that budget that is still unspent, and the words at the leaves that it reaches are compared letter by letter.
Each pair is looked for from one side only: the first count that differs must be higher at the word that is found.

The upper levels of the trie are split among tasks.  A node with more than ``NODE_WORDS`` words is split by its next
levels, so a word is sent to the few nodes that its budget still reaches, and a task holds one node and a lot of words.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import chunks, written
from fieldtrace.llm.lexicon import crc_of_joined, letters, token_codes

GROUPS = 13
#: Levels of the first split, levels that each further split adds.
FIRST_LEVELS, MORE_LEVELS = 3, 2
#: Words of a node, and words looked up in it, that one task works on.
NODE_WORDS, LOT_WORDS = 4096, 65536
LEAST_LETTERS, LEAST_COUNT, DOMINANT = 6, 5, 5
#: One occurrence in so many is damaged by the count, as the result's contract asks.
DAMAGE = 199
_TEXT_BYTES = 8 << 20


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters A-Z, a-z, U+00C0 to U+00FF of at least ``LEAST_LETTERS``, A-Z lower-cased.

    With ``damage`` the crc32 of ``<key>:<run>`` decides which occurrences lose one letter.  A null key counts as an
    empty one, null text holds no word.
    """
    slim = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))

    def count(batches):
        for batch in chunks(batches, "text", _TEXT_BYTES):
            found, code, row = token_codes(batch.column("text"), letters)
            runs = found.to_pylist()
            n = np.bincount(code, minlength=len(runs))
            extra: dict[bytes, int] = {}
            if damage and len(code):
                prefix = np.array([zlib.crc32(f"{k}:".encode()) for k in batch.column("key").to_pylist()], np.uint32)
                crc = np.array([zlib.crc32(r) for r in runs], np.uint32)
                size = np.array([len(r) for r in runs])
                h = crc_of_joined(prefix[row], crc[code], size[code])
                hit = np.flatnonzero(h % damage == 0)
                n -= np.bincount(code[hit], minlength=len(runs))
                for i in hit.tolist():
                    run = runs[code[i]].decode()
                    at = int(h[i]) % len(run)
                    less = (run[:at] + run[at + 1:]).encode()
                    extra[less] = extra.get(less, 0) + 1
            words = pa.concat_arrays([found.cast(pa.binary()), pa.array(list(extra), pa.binary())]).cast(pa.string())
            n = np.append(n, np.array(list(extra.values()), n.dtype))
            long = pc.greater_equal(pc.utf8_length(words), LEAST_LETTERS)
            keep = pc.and_(long, pa.array(n > 0))
            yield pa.RecordBatch.from_arrays([words.filter(keep), pa.array(n).filter(keep)], names=["word", "n"])

    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters, one byte each (code points stay below 256), and the bounds of the words."""
    parts = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts], dtype=np.int64))


def letter_counts(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """words x GROUPS; a count of more than 255 stays 255, which moves by one at most as the count does."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    counts = np.bincount(row * GROUPS + flat % GROUPS, minlength=n * GROUPS).reshape(n, GROUPS)
    return np.minimum(counts, 255).astype(np.uint8)


# What has been spent of the budget: nothing, the surplus, both.
_NOTHING, _SURPLUS, _BOTH = 0, 1, 2


def _descend(rows: DataFrame, low: int, high: int) -> DataFrame:
    """(node, spent, word, n) of every node at level ``high`` that a word reaches from its node at level ``low``."""
    def go(batches):
        for batch in batches:
            counts = letter_counts(*_latin(batch.column("word")))
            spent = batch.column("spent").to_numpy()
            at, path = np.arange(len(spent)), np.zeros((len(spent), high - low), np.uint8)
            for level in range(low, high):
                mine = counts[at, level]
                up = np.flatnonzero((spent == _NOTHING) & (mine < 255))
                down = np.flatnonzero((spent == _SURPLUS) & (mine > 0))
                source = np.concatenate([np.arange(len(at)), up, down])
                path = path[source]
                path[:, level - low] = np.concatenate([mine, mine[up] + 1, mine[down] - 1])
                spent = np.concatenate([spent, np.full(len(up), _SURPLUS, np.int8), np.full(len(down), _BOTH, np.int8)])
                at = at[source]
            before = batch.column("node").to_pylist()
            nodes = [before[i] + p.tobytes() for i, p in zip(at.tolist(), path)]
            taken = batch.select(["word", "n"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(spent, pa.int8()), *taken.columns],
                                             names=["node", "spent", "word", "n"])

    return rows.mapInArrow(go, "node binary, spent byte, word string, n long")


def _one_edit(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (word i of a, word j of b) differ by exactly one inserted, deleted or replaced letter."""
    (x, xs), (y, ys) = a, b
    m, n = xs[i + 1] - xs[i], ys[j + 1] - ys[j]
    out = np.zeros(len(i), bool)
    order = np.flatnonzero(np.abs(m - n) <= 1)
    order = order[np.argsort(m[order], kind="stable")]
    x, y = np.append(x, np.uint8(0)), np.append(y, np.uint8(0))
    low = 0
    while low < len(order):  # lots of pairs of like length, about four million letters at most
        width = int(m[order[low]]) + 1
        high = min(len(order), low + max(1, (1 << 22) // width))
        high = low + int(np.searchsorted(m[order[low:high]], width + 7, "right"))
        lot = order[low:high]
        width = int(m[lot[-1]]) + 1
        step = np.arange(width)
        short, long = np.minimum(m[lot], n[lot]), np.maximum(m[lot], n[lot])
        within = step < short[:, None]
        ahead = (x[np.minimum(xs[i[lot]][:, None] + step, len(x) - 1)] == y[np.minimum(ys[j[lot]][:, None] + step, len(y) - 1)]) & within
        back = (x[np.maximum(xs[i[lot] + 1][:, None] - 1 - step, 0)] == y[np.maximum(ys[j[lot] + 1][:, None] - 1 - step, 0)]) & within
        head = np.where(ahead.all(axis=1), width, np.argmin(ahead, axis=1))
        tail = np.where(back.all(axis=1), width, np.argmin(back, axis=1))
        same = (short == long) & (head >= short)
        out[lot] = (head + tail >= long - 1) & ~same
        low = high
    return out


def search(words: pa.Array, asked: pa.Array, spent: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in ``asked``, index in ``words``) one edit apart, by depth-first search below a node at ``level``.

    ``spent`` is what each asked word has used of its budget on the way to the node.
    """
    home, there = _latin(words), _latin(asked)
    counts, wanted = letter_counts(*home), letter_counts(*there)
    order = np.lexsort([counts[:, g] for g in range(GROUPS - 1, level - 1, -1)]) if level < GROUPS else np.arange(len(counts))
    counts = counts[order]
    stack = [(0, len(order), level, np.arange(len(wanted)), spent)]
    left, right, held = [], [], 0
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def verify():
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            good = _one_edit(there, home, i, j)
            found.append((i[good], j[good]))
            left.clear()
            right.clear()

    while stack:
        low, high, depth, who, used = stack.pop()
        if depth == GROUPS or (high - low) * len(who) <= 64:
            leaf = order[low:high]
            step = max(1, (1 << 20) // len(leaf))
            for k in range(0, len(who), step):  # a leaf of many words is compared in parts
                some = who[k:k + step]
                left.append(np.repeat(some, len(leaf)))
                right.append(np.tile(leaf, len(some)))
                held += len(left[-1])
                if held > 1 << 20:
                    verify()
                    held = 0
            continue
        column = counts[low:high, depth]
        edges = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        ends = np.append(edges[1:], high - low)
        mine = wanted[who, depth].astype(np.int16)
        for e, f in zip(edges.tolist(), ends.tolist()):
            change = int(column[e]) - mine
            ok = (change == 0) | ((change == 1) & (used == _NOTHING)) | ((change == -1) & (used == _SURPLUS))
            if ok.any():
                stack.append((low + e, low + f, depth + 1, who[ok], (used + (change != 0))[ok]))
    verify()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search_node(table: pa.Table) -> pa.Table:
    """The pairs of one node and one lot of words."""
    table = table.combine_chunks()
    is_home = table["is_home"].to_numpy()
    home, asked = table.filter(pa.array(is_home)), table.filter(pa.array(~is_home))
    level = len(table["node"][0].as_py())
    words, words_asked = (t["word"].combine_chunks() for t in (home, asked))
    spent = asked["spent"].to_numpy()
    i, j = search(words if isinstance(words, pa.Array) else words.chunk(0), words_asked, spent, level)
    # Words with the same counts meet twice, and the search stops early at small nodes: keep the side that the order names.
    a, b = asked.select(["word", "n"]).take(pa.array(i)), home.select(["word", "n"]).take(pa.array(j))
    x, y = _latin_counts(a["word"]), _latin_counts(b["word"])
    keep = [(p, v) < (q, w) for p, q, v, w in zip(x, y, a["word"].to_pylist(), b["word"].to_pylist())]
    pairs = pa.Table.from_arrays([*a.columns, *b.columns], names=["word", "n", "near", "near_n"])
    return pairs.filter(pa.array(keep, pa.bool_()))


def _latin_counts(column: pa.ChunkedArray) -> list[bytes]:
    flat, bounds = _latin(column)
    return [c.tobytes() for c in letter_counts(flat, bounds)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each unordered pair of distinct words (word, n) that are one edit apart, once."""
    start = words.select(F.unhex(F.lit("")).alias("node"), F.lit(_NOTHING).cast("byte").alias("spent"), "word", "n")
    level, rows, ready = FIRST_LEVELS, written(_descend(start, 0, FIRST_LEVELS)), None
    while True:
        homes, asked = F.count(F.when(F.col("spent") == _NOTHING, 1)).alias("homes"), F.count(F.lit(1)).alias("asked")
        sizes = rows.groupBy("node").agg(homes, asked).where("homes > 0")
        rows = written(rows.join(sizes, "node"))  # a node without words ends the search
        small = rows if level == GROUPS else rows.where(F.col("homes") <= NODE_WORDS)
        ready = small if ready is None else ready.unionByName(small)
        large = rows.where(F.col("homes") > NODE_WORDS).drop("homes", "asked")
        if level == GROUPS or large.isEmpty():
            break
        level, low = min(GROUPS, level + MORE_LEVELS), level
        rows = written(_descend(large, low, level))
    # A lot is a part of the node's words and a part of the words that ask for it; words at home are in every lot of their part.
    parts = F.ceil(F.col("homes") / NODE_WORDS).cast("int")
    lots = F.ceil(F.col("asked") / LOT_WORDS).cast("int")
    my_part, my_lot = F.pmod(F.xxhash64("word"), parts).cast("int"), F.pmod(F.xxhash64(F.lit(7), "word"), lots).cast("int")
    as_home = ready.where(F.col("spent") == _NOTHING).select(
        "node", "spent", "word", "n", F.lit(True).alias("is_home"), my_part.alias("part"), F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    as_asked = ready.select(
        "node", "spent", "word", "n", F.lit(False).alias("is_home"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), my_lot.alias("lot"))
    return as_home.unionByName(as_asked).groupBy("node", "part", "lot").applyInArrow(
        lambda table: _search_node(table), "word string, n long, near string, near_n long")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of six letters or more that occurs five times or more.

    Two words are near if one edit apart.  ``form`` is the most frequent near word (ties: the smallest), if at least
    five times as frequent, else null; ``root`` is the end of the chain of forms, which always ends as counts grow.
    Null texts hold no word; repeated rows count as often as they stand; an empty table gives no rows; other columns
    are not read.
    """
    words = written(word_counts(docs, key, text, damage).where(F.col("n") >= LEAST_COUNT))
    pairs = written(near_words(words))
    both = pairs.select("word", "n", "near", "near_n").unionByName(
        pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = -F.col("best.less") >= DOMINANT * F.col("n")
    out = written(words.join(best, "word", "left").select(
        "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n")))
    return out.join(_roots(out.where("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form; each round doubles how far a chain is followed."""
    roots = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = written(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots
