"""Language identification by a byte-level convolutional network, written and trained in numpy.

A text is cut into windows of a fixed number of bytes.  Each byte has a small vector; filters of several
widths slide over the vectors; every filter keeps its largest answer in the window; a softmax over these
gives the languages of the window.  A document's score is the mean log-probability of all its windows,
weighted by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.llm.common import chunks, flat_text, labelled_sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
DIMENSIONS = 8
#: Bounds of the training sample: documents of a language, windows of a document, size of a text.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, SAMPLE_TEXT_BYTES = 500, 6, 1 << 20
_ROWS = 512  # windows in one pass
_ASCII_LETTER = re.compile("[A-Za-z]").search


@dataclass(frozen=True)
class Network:
    labels: tuple[str, ...]
    vectors: np.ndarray  # 256 x DIMENSIONS
    filters: np.ndarray  # max(WIDTHS) * DIMENSIONS x filters; unused taps of narrow filters are 0
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def windows_of(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows padded with byte 0, the row of each and the bytes in each."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    start = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    used = np.minimum(WINDOW, bounds[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return np.where(inside, np.append(flat, np.uint8(0))[np.minimum(at, len(flat))], 0), row, used


def _patches(net: Network, windows: np.ndarray) -> np.ndarray:
    span = max(WIDTHS)
    x = net.vectors[windows].reshape(len(windows), -1)
    shape = (len(windows), WINDOW - span + 1, span * DIMENSIONS)
    return np.lib.stride_tricks.as_strided(x, shape, (x.strides[0], 4 * DIMENSIONS, 4))


def _pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    patches = _patches(net, windows)
    answers = (np.ascontiguousarray(patches).reshape(-1, patches.shape[2]) @ net.filters).reshape(len(windows), -1, net.filters.shape[1])
    return patches, answers, answers.max(axis=1)


def log_probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    out = np.empty((len(windows), len(net.labels)), np.float32)
    for i in range(0, len(windows), _ROWS):
        top = np.maximum(_pooled(net, windows[i:i + _ROWS])[2] + net.shift, 0)
        z = top @ net.out + net.bias
        z -= z.max(axis=1, keepdims=True)
        out[i:i + _ROWS] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def train(windows: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Stochastic gradient steps with adaptive moments; 400 steps at least; the same sample gives the same network."""
    names, y = np.unique(np.array(labels, dtype=object), return_inverse=True)
    rng = np.random.default_rng(seed)
    span, n = max(WIDTHS), FILTERS * len(WIDTHS)
    taps = np.repeat([[w > t for t in range(span) for _ in range(DIMENSIONS)] for w in WIDTHS], FILTERS, axis=0).T
    p = {
        "vectors": rng.normal(0, 0.5, (256, DIMENSIONS)), "filters": rng.normal(0, 0.3, (span * DIMENSIONS, n)) * taps,
        "shift": np.zeros(n), "out": rng.normal(0, 0.3, (n, len(names))), "bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    per_epoch = max(1, -(-len(windows) // batch))
    epochs = max(epochs, -(-400 // per_epoch))
    step, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            w, rows = windows[pick], len(pick)
            net = Network((), **p)
            patches, answers, top = _pooled(net, w)
            where = answers.argmax(axis=1)
            hidden = np.maximum(top + p["shift"], 0)
            z = hidden @ p["out"] + p["bias"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(rows), y[pick]] -= 1
            d /= rows
            d_top = (d @ p["out"].T) * (hidden > 0)
            chosen = patches[np.arange(rows)[:, None], where]  # rows x filters x taps
            d_patch = d_top[:, :, None] * p["filters"].T[None]
            d_vectors = np.zeros_like(p["vectors"])
            byte_at = w[np.arange(rows)[:, None, None], where[:, :, None] + np.arange(span)]
            np.add.at(d_vectors, byte_at.reshape(-1), d_patch.reshape(-1, DIMENSIONS))
            grads = {"vectors": d_vectors, "filters": np.einsum("rf,rft->tf", d_top, chosen) * taps,
                     "shift": d_top.sum(axis=0), "out": hidden.T @ d, "bias": d.sum(axis=0)}
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p[k] = (p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Network(tuple(names.tolist()), **p)


def held_out(key: str, parts: int, left_out: int) -> Column:
    """Whether the document is kept from learning; a row without a key is not, and is not learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == left_out, F.lit(False))


def fit_language_network(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Network of a bounded sample: ``SAMPLE_DOCUMENTS`` of each language, ``SAMPLE_WINDOWS`` windows of each; None without labels."""
    learnable = docs.select(key, text, lang).where(F.col(key).isNotNull() & (F.octet_length(text) <= SAMPLE_TEXT_BYTES))
    sample = labelled_sample(learnable, lang, SAMPLE_DOCUMENTS, key)

    def cut(batches):
        for batch in chunks(batches, text):
            made, row, used = windows_of(*flat_text(batch.column(text)))
            keep = np.concatenate([i[np.unique(np.linspace(0, len(i) - 1, SAMPLE_WINDOWS).astype(int))] for i in (
                np.flatnonzero(row == r) for r in range(batch.num_rows)) if len(i)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(row[keep])), batch.column(lang).take(pa.array(row[keep])), pa.array(keep),
                pa.array([w.tobytes() for w in made[keep]], pa.binary())], names=["k", "lang", "place", "window"])

    rows = sample.select(F.col(key).cast("long").alias(key), text, F.col(lang).cast("string").alias(lang)).mapInArrow(
        cut, "k long, lang string, place long, window binary").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("k", "ascending"), ("window", "ascending"), ("lang", "ascending")])
    made = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(made, rows["lang"].to_pylist())


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER(text) is not None or any(map(str.isalpha, text)))


def _scored(net: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    known = np.array([has_letter(t) for t in column.to_pylist()], bool)
    pred, score = np.full(len(known), "und", object), np.zeros(len(known))
    if net is not None and known.any():
        made, row, used = windows_of(*flat_text(column))
        total = np.zeros((len(known), len(net.labels)))
        logs = log_probabilities(net, made) * used[:, None]
        for j in range(len(net.labels)):
            total[:, j] = np.bincount(row, logs[:, j], len(known))
        total /= np.maximum(np.bincount(row, used, len(known)), 1)[:, None]
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        pred[known] = np.array(net.labels, object)[best[known]]
        score[known] = (odds.max(axis=1) / odds.sum(axis=1))[known]
    return pred.tolist(), score


def predict_language(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents, all columns, with the predicted language and its probability over the whole text.

    A text that is null or without a letter, and any text where there was nothing to learn from, is ``und`` with score
    0.  Rows are independent; an empty table gives no rows; columns named like the two new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in (pred, score)]
    src = docs.select(*kept)

    def label(batches):
        for batch in chunks(batches, text):
            names, values = _scored(net, batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(values)],
                                             names=[*batch.schema.names, pred, score])

    out = T.StructType([*src.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return src.mapInArrow(label, out)
