"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels belong to documents, so token labels are derived first: features (a word, or its first bytes) that stand
in many toxic documents and hardly in others mark the tokens of toxic documents.  A two-state chain is trained on
these tokens.  Forward-backward gives every token its probability; a document's score is a logistic function of the
largest one and of the expected number of toxic tokens.

Nearly all tokens carry no known feature and score alike, so the step from one of them to the next is one fixed matrix.
The recursions go from one known token to the next over a power of it; what the chain says of the tokens between is
read off the two ends of their gap.  This is the whole chain, not a part of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.llm.common import Hashes, chunks, flat_text, labelled_sample, mix, words

#: Bounds of the training sample: documents of each label, size of a text.
SAMPLE_DOCUMENTS, SAMPLE_TEXT_BYTES = 1500, 1 << 20
#: A feature marks tokens if it is in this share of the sampled toxic documents and this much likelier there.
MARK_SHARE, MARK_LOG_ODDS = 0.015, 3.0
PREFIXES = (4, 5, 6)
_SEQUENCE = 48  # tokens of a training sequence
_SEQUENCES = 8000


def token_features(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One column per kind: hash of the word and of its first bytes; 0 where the word is too short."""
    hashes = Hashes(flat)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = hashes.of(starts, ends)
    for j, n in enumerate(PREFIXES, 1):
        long = ends - starts >= n
        salted = mix(hashes.of(starts, np.where(long, starts + n, ends)) + np.uint64(j))
        out[:, j] = np.where(long, salted, np.uint64(0))
    return out


class Vocabulary:
    """Known feature hashes; unknown ones mostly end at one look into a small bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self._may = np.zeros(1 << 20, bool)
        self._may[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among the keys, ``len(keys)`` where it is none of them."""
        flat = hashes.reshape(-1)
        out = np.full(flat.shape, len(self.keys), np.int32)
        may = np.flatnonzero(self._may[flat >> np.uint64(44)])
        if len(may) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, flat[may]), len(self.keys) - 1)
            same = self.keys[at] == flat[may]
            out[may[same]] = at[same]
        return out.reshape(hashes.shape)


@dataclass(frozen=True)
class Tagger:
    vocabulary: Vocabulary
    weights: np.ndarray  # of the features, 0 for unknown ones at the end
    bias: float
    step: np.ndarray  # 2 x 2 scores of state pairs
    start: np.ndarray  # 2 scores of the first state
    scale: np.ndarray  # logistic function of the document: constant, largest logit, log of the expected count


def _exp_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def marginals(unary: np.ndarray, lengths: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward scores (rows x places x 2) and the log normaliser of padded sequences.

    ``unary`` holds the score of state 1 at each place, 0 for state 0.
    """
    rows, n = unary.shape
    forward = np.zeros((n, rows, 2))
    backward = np.zeros((n, rows, 2))
    if n:
        forward[0, :, 0], forward[0, :, 1] = start[0], start[1] + unary[:, 0]
    for t in range(1, n):
        for s in (0, 1):
            forward[t, :, s] = _exp_sum(forward[t - 1, :, 0] + step[0, s], forward[t - 1, :, 1] + step[1, s]) + s * unary[:, t]
    for t in range(n - 2, -1, -1):
        go = t + 1 < lengths
        for s in (0, 1):
            value = _exp_sum(backward[t + 1, :, 0] + step[s, 0], backward[t + 1, :, 1] + step[s, 1] + unary[:, t + 1])
            backward[t, :, s] = np.where(go, value, 0)
    last = np.maximum(lengths - 1, 0)
    end = forward[last, np.arange(rows)] if n else np.zeros((rows, 2))
    return forward, backward, _exp_sum(end[:, 0], end[:, 1])


def _log_odds(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    both = forward + backward
    return (both[:, :, 1] - both[:, :, 0]).T


def _fit_chain(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, rounds: int = 200, rate: float = 0.1,
               ridge: float = 1e-3):
    """Maximum likelihood with a small ridge by gradient steps with adaptive moments."""
    rows, n, kinds = features.shape
    p = {"w": np.zeros(n_features + 1), "b": np.full(1, -3.0), "t": np.zeros((2, 2)), "s": np.zeros(2)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    inside = np.arange(n) < lengths[:, None]
    pairs = inside[:, 1:]
    seen = {
        "w": np.bincount(features.ravel(), np.repeat((labels * inside).ravel(), kinds), n_features + 1),
        "b": np.array([(labels * inside).sum()], float), "s": np.bincount(labels[:, 0], minlength=2).astype(float),
        "t": np.array([[((labels[:, :-1] == a) & (labels[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float),
    }
    total = max(1, rows)
    for i in range(1, rounds + 1):
        unary = p["w"][features].sum(axis=2) + p["b"]
        forward, backward, norm = marginals(unary, lengths, p["t"], p["s"])
        one = np.where(inside, np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - norm, 0)).T, 0)
        hoped = {"w": np.bincount(features.ravel(), np.repeat(one.ravel(), kinds), n_features + 1), "b": np.array([one.sum()]),
                 "s": np.array([(1 - one[:, 0]).sum(), one[:, 0].sum()]), "t": np.zeros((2, 2))}
        for a in (0, 1):
            for b in (0, 1):
                joint = forward[:-1, :, a] + p["t"][a, b] + b * unary.T[1:] + backward[1:, :, b] - norm
                hoped["t"][a, b] = np.exp(np.minimum(joint, 0)).T[pairs].sum()
        for k in p:
            g = (hoped[k] - seen[k]) / total + ridge * (p[k] if k != "b" else 0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
        p["w"][-1] = 0
    return p


class _Gaps:
    """Powers of the step between tokens without known features, scaled by their largest root."""

    def __init__(self, tagger: Tagger, longest: int):
        self.step = np.exp(tagger.step)
        (a, b), (c, d) = step = self.step * np.array([1.0, np.exp(tagger.bias)])
        spread = np.sqrt((a - d) ** 2 + 4 * b * c)
        large, small = (a + d + spread) / 2, (a + d - spread) / 2
        self._ends = (step - small * np.eye(2)) / spread  # A^g / large^g = ends + (small / large)^g * (1 - ends)
        self._fades = np.power(small / large, np.arange(longest + 2))
        start = np.exp(tagger.start - tagger.start.max())
        self.first, self.before = start * [1.0, np.exp(tagger.bias)], start

    def after(self, vector: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """rows x 2: row vectors times the power; never 0."""
        far = vector @ self._ends
        return np.maximum(far + self._fades[steps][:, None] * (vector - far), 1e-300)

    def ahead(self, vector: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """rows x 2: the power times column vectors."""
        far = vector @ self._ends.T
        return np.maximum(far + self._fades[steps][:, None] * (vector - far), 1e-300)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def token_odds(tagger: Tagger, found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log odds of every token, texts given by the bounds of their tokens."""
    sizes = np.diff(bounds)
    known = np.flatnonzero((found != len(tagger.vocabulary.keys)).any(axis=1))
    gaps = _Gaps(tagger, int(sizes.max(initial=0)))
    unary = tagger.weights[found[known]].sum(axis=1) + tagger.bias
    lift = np.stack([np.exp(-np.maximum(unary, 0)), np.exp(np.minimum(unary, 0))], axis=1)  # (1, e^unary) up to a factor
    of = np.searchsorted(bounds, known, "right") - 1
    first = np.searchsorted(of, np.arange(len(sizes) + 1))
    place, n_known = known - bounds[of], np.diff(first)
    forward, backward = np.empty((len(known), 2)), np.empty((len(known), 2))
    order = np.argsort(-n_known, kind="stable")
    many = -n_known[order]
    for k in range(int(n_known.max(initial=0))):  # the k-th known token of every text that has one, from both ends
        text = order[:np.searchsorted(many, -k, "left")]
        at = first[text] + k
        if k == 0:
            here = np.where((place[at] == 0)[:, None], gaps.before, gaps.after(gaps.first, np.maximum(place[at] - 1, 0)) @ gaps.step)
        else:
            here = gaps.after(forward[at - 1], place[at] - place[at - 1] - 1) @ gaps.step
        forward[at] = _scaled(here * lift[at])
        at = first[text + 1] - 1 - k
        if k == 0:
            back = gaps.ahead(np.ones((len(at), 2)), sizes[text] - 1 - place[at])
        else:
            back = gaps.ahead((lift[at + 1] * backward[at + 1]) @ gaps.step.T, place[at + 1] - place[at] - 1)
        backward[at] = _scaled(back)
    out = np.empty(len(found))
    out[known] = np.log(forward[:, 1] * backward[:, 1]) - np.log(forward[:, 0] * backward[:, 0])
    # A gap lies before each known token and before the end of each text.
    gap_text = np.repeat(np.arange(len(sizes)), n_known + 1)
    nth = np.arange(len(gap_text)) - np.repeat(first[:-1] + np.arange(len(sizes)), n_known + 1)
    left, right = first[gap_text] + nth - 1, first[gap_text] + nth
    opens, closes = nth == 0, nth == n_known[gap_text]
    begin = np.where(opens, bounds[gap_text], np.append(known, 0)[left] + 1)
    length = np.where(closes, bounds[gap_text + 1], np.append(known, 0)[np.minimum(right, len(known))]) - begin
    one, ends = np.ones((1, 2)), np.concatenate([forward, np.ones((1, 2))])
    entered = np.where(opens[:, None], gaps.first, gaps.after(ends[left], np.ones(len(left), int)))
    behind = np.concatenate([(lift * backward) @ gaps.step.T, one])[np.where(closes, len(known), right)]
    gap = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(gap)) - np.repeat(np.cumsum(length) - length, length)
    f, b = gaps.after(_scaled(entered)[gap], inside), gaps.ahead(_scaled(behind)[gap], length[gap] - 1 - inside)
    out[begin[gap] + inside] = np.log(f[:, 1] * b[:, 1]) - np.log(f[:, 0] * b[:, 0])
    return out


def _document_numbers(tagger: Tagger, found: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest log odds and expected number of likely tokens of each document, and the log odds of each token.

    A document without tokens has the largest log odds of one unknown token.
    """
    bounds = np.searchsorted(row, np.arange(n_rows + 1), "left")
    odds = token_odds(tagger, found, bounds)
    some = np.flatnonzero(np.diff(bounds))
    top = np.full(n_rows, tagger.start[1] + tagger.bias - tagger.start[0])
    if len(some):
        top[some] = np.maximum.reduceat(odds, bounds[some])
    return top, np.bincount(row, np.where(odds > 0, 1 / (1 + np.exp(-np.maximum(odds, 0))), 0), n_rows), odds


def _columns(top: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(top), np.clip(top, -20, 20) / 5, np.log1p(count)], axis=1)


def _fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (p - y) + ridge * beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-6) * np.eye(len(beta)), grad)
    return beta


def train(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Tagger | None:
    """Tagger of labelled texts; None where one of the two labels is missing."""
    kept: dict[str, int] = {}
    for t, y in zip(texts, toxic):
        kept.setdefault(t, int(y))
    texts, toxic = list(kept), np.array(list(kept.values()), np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    flat, bounds = flat_text(pa.array(texts, pa.string()))
    starts, ends, row = words(flat, bounds)
    feats = token_features(flat, starts, ends)
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    keys, marking = [], []
    for j in range(feats.shape[1]):  # distinct documents of each feature, by label
        order = np.lexsort((row, feats[:, j]))
        f, r = feats[order, j], row[order]
        new = np.append(True, (f[1:] != f[:-1]) | (r[1:] != r[:-1])) & (f != 0) if len(f) else np.zeros(0, bool)
        key, at = np.unique(f[new], return_inverse=True)
        bad = np.bincount(at, toxic[r[new]], len(key))
        good = np.bincount(at, 1 - toxic[r[new]], len(key))
        odds = np.log((bad + 0.5) / (n_toxic + 1)) - np.log((good + 0.5) / (n_clean + 1))
        keys.append(key[(odds >= 1.5) & (bad >= 3)])
        marking.append(key[(odds >= MARK_LOG_ODDS) & (bad >= max(4, MARK_SHARE * n_toxic))])
    marks, vocabulary = Vocabulary(np.concatenate(marking)), Vocabulary(np.concatenate([*keys, *marking]))
    label = ((marks.find(feats) != len(marks.keys)).any(axis=1) & (toxic[row] == 1)).astype(np.int64)
    found = vocabulary.find(feats)

    first = np.searchsorted(row, np.arange(len(texts)), "left")
    piece = (np.arange(len(row)) - first[row]) // _SEQUENCE
    begin = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(piece) != 0)))[:len(row)]
    length = np.diff(np.append(begin, len(row)))
    told = np.add.reduceat((found != len(vocabulary.keys)).any(axis=1).astype(np.int64), begin) > 0 if len(begin) else np.zeros(0, bool)
    rng = np.random.default_rng(seed)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(told))[:3 * _SEQUENCES // 4], rng.permutation(np.flatnonzero(~told))[:_SEQUENCES // 4]])
    place = np.minimum(begin[chosen][:, None] + np.arange(_SEQUENCE), max(len(row) - 1, 0))
    fit = _fit_chain(found[place], label[place], length[chosen], len(vocabulary.keys))
    tagger = Tagger(vocabulary, fit["w"], float(fit["b"][0]), fit["t"], fit["s"], np.zeros(3))
    top, count, _ = _document_numbers(tagger, found, row, len(texts))
    return Tagger(vocabulary, fit["w"], tagger.bias, fit["t"], fit["s"], _fit_scale(_columns(top, count), toxic))


def fit_tagger(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Tagger | None:
    """Tagger of a bounded sample: ``SAMPLE_DOCUMENTS`` rows of each label, texts up to ``SAMPLE_TEXT_BYTES``.

    Rows with a null key or label teach nothing; of a key with several labels the largest counts.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(toxic).cast("int")).alias("_toxic"))
    picked = labelled_sample(known, "_toxic", SAMPLE_DOCUMENTS, "_key")  # a few thousand rows
    rows = docs.where(F.octet_length(text) <= SAMPLE_TEXT_BYTES).join(F.broadcast(picked), F.col(key) == F.col("_key")).select(
        F.col("_key").cast("long"), F.col(text).alias("_text"), "_toxic").toArrow().sort_by([("_key", "ascending"), ("_text", "ascending")])
    return train(rows["_text"].to_pylist(), rows["_toxic"].to_numpy())


def score_texts(tagger: Tagger | None, column: pa.Array, spans: bool = True) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text and the byte spans of its toxic tokens, neighbouring ones joined."""
    n = len(column)
    if tagger is None:
        return np.zeros(n), [[] for _ in range(n)]
    flat, bounds = flat_text(column)
    starts, ends, row = words(flat, bounds)
    top, count, odds = _document_numbers(tagger, tagger.vocabulary.find(token_features(flat, starts, ends)), row, n)
    score = 1 / (1 + np.exp(-(_columns(top, count) @ tagger.scale)))
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    last = -2
    for i in np.flatnonzero(odds > 0).tolist() if spans else ():
        r, s, e = int(row[i]), int(starts[i] - bounds[row[i]]), int(ends[i] - bounds[row[i]])
        if last == i - 1 and out[r]:
            out[r][-1] = (out[r][-1][0], e)
        else:
            out[r].append((s, e))
        last = i
    return score, out


def score_toxicity(docs: DataFrame, tagger: Tagger | None, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """The documents, all columns, with the score of the whole text and the toxic spans (start, end in bytes of UTF-8).

    Null counts as empty and scores like a text without any known word; without a tagger every score is 0.  Rows are
    independent; an empty table gives no rows; columns named like the two new ones are replaced.
    """
    src = docs.select(*[c for c in docs.columns if c not in (score, spans)])

    def tag(batches):
        for batch in chunks(batches, text):
            values, found = score_texts(tagger, batch.column(text))
            pairs = pa.array([[{"start": s, "end": e} for s, e in f] for f in found],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pairs], names=[*batch.schema.names, score, spans])

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([*src.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(spans, T.ArrayType(pair))])
    return src.mapInArrow(tag, out)
