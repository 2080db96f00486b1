"""Toxicity: a linear-chain conditional random field over word tokens.

Labels exist for documents only, so token labels are derived from them on a bounded sample of learning rows: a token of
a toxic document is toxic where one of its features (the word, its prefixes of 3 to 5 bytes, its last 3 bytes) occurs in
toxic documents almost only.  A two-state chain (clean, toxic) is then fitted on windows of the sample by the exact
likelihood gradient.  Forward-backward marginals of every token of every whole text are summed into a document score
through a logistic layer, and tokens whose marginal reaches 0.5 are reported with their code-point offsets.

Edge cases: null and empty texts, and texts without words, have the score of no toxic token; with no labelled rows, or
rows of one kind only, every score is 0; repeated rows are scored each; null doc_id: scored, never learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Spans, chunks, fold, labelled_sample, logistic, sigmoid, stored, table, with_field, words

SAMPLE_ROWS = 12_000
WINDOW = 12
MIN_TOXIC = 4
PURE = 0.93

_LETTER = np.ones(256, bool)  # separators: everything but ASCII letters and bytes of other characters
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KINDS = 5


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words, and a (kinds x words) array of feature hashes."""
    low = LOWER[data]
    s, e, row = words(low, off, _LETTER)
    span = Spans(low)
    h = [span(s, e, 1)] + [span(s, np.minimum(s + k, e), k) for k in (3, 4, 5)] + [span(np.maximum(e - 3, s), e, 9)]
    return s, e, row, np.stack(h)


class Vocabulary:
    """Exact lookup of 64-bit feature hashes: a bit table first, then a binary search of what it lets through."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are known, and their values."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], self.values[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], self.values[k[good]]


def marginals(e: np.ndarray, length: np.ndarray, start: np.ndarray, model: dict) -> np.ndarray:
    """P(toxic) of each token.  e: log-odds of each token; length, start: tokens of each row, by forward-backward."""
    out = np.zeros(len(e))
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return out
    first, size = start[order], length[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    t = np.exp(model["transition"])  # from, to
    w = np.exp(np.clip(e, -40, 40))
    fwd = np.zeros(len(e))  # odds of toxic given what came before and the token itself
    odds = None
    for i, k in enumerate(active.tolist()):
        at = first[:k] + i
        if i == 0:
            odds = np.exp(model["start"]) * w[at]
        else:
            p = odds[:k]
            odds = (t[0, 1] + p * t[1, 1]) / (t[0, 0] + p * t[1, 0]) * w[at]
        fwd[at] = odds
    back = np.ones(len(order))  # ratio of what follows a toxic token to what follows a clean one
    for i in range(len(active) - 1, -1, -1):
        k = active[i]
        at = first[:k] + i
        out[at] = fwd[at] * back[:k]
        m = w[at] * back[:k]
        back[:k] = (t[1, 0] + t[1, 1] * m) / (t[0, 0] + t[0, 1] * m)
    return out / (1 + out)


def _forward_backward(e: np.ndarray, mask: np.ndarray, model: dict):
    """Node marginals, pair marginals summed and start marginal of equal-length windows (rows of e); mask: real tokens."""
    n, length = e.shape
    t = np.exp(model["transition"])
    w = np.stack([np.ones_like(e), np.exp(np.clip(e, -40, 40))], -1)
    w = np.where(mask[..., None], w, 1.0)
    f = np.zeros((n, length, 2))
    f[:, 0] = w[:, 0] * np.array([1.0, np.exp(model["start"])])
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for i in range(1, length):
        f[:, i] = np.where(mask[:, i, None], (f[:, i - 1] @ t) * w[:, i], f[:, i - 1])
        f[:, i] /= f[:, i].sum(1, keepdims=True)
    b = np.ones((n, length, 2))
    pair = np.zeros((2, 2))
    for i in range(length - 2, -1, -1):
        nxt = w[:, i + 1] * b[:, i + 1]
        real = mask[:, i + 1]
        p = f[:, i, :, None] * t[None] * nxt[:, None, :]
        p /= p.sum((1, 2), keepdims=True)
        pair += p[real].sum(0)
        step = nxt @ t.T
        b[:, i] = np.where(real[:, None], step / step.sum(1, keepdims=True), b[:, i + 1])
    m = f * b
    m /= m.sum(-1, keepdims=True)
    return m[..., 1], pair


def train(x: np.ndarray, y: np.ndarray, mask: np.ndarray, size: int, rounds: int = 120) -> dict:
    """Adam on the mean log-likelihood.  x: (windows, WINDOW, kinds) feature numbers, -1 where unknown."""
    theta, bias = np.zeros(size + 1), -3.0
    model = {"transition": np.zeros((2, 2)), "start": 0.0}
    n = mask.sum()
    real_pair = mask[:, 1:]
    want = np.zeros((2, 2))
    np.add.at(want, (y[:, :-1][real_pair], y[:, 1:][real_pair]), 1)
    m1 = m2 = np.zeros(size + 1 + 1 + 4 + 1)
    for r in range(1, rounds + 1):
        theta[-1] = 0
        e = bias + theta[x].sum(-1)
        p, pair = _forward_backward(e, mask, model)
        d = np.where(mask, y - p, 0.0)
        g_theta = np.bincount(np.where(x < 0, size, x).ravel(), weights=np.repeat(d.ravel(), x.shape[2]), minlength=size + 1)
        g = np.concatenate([g_theta, [d.sum()], (want - pair).ravel(), [d[:, 0].sum()]]) / n
        g[: size + 1] -= 2e-6 * theta
        g[size + 2 : size + 6] -= 1e-4 * model["transition"].ravel()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.15 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
        theta = theta + step[: size + 1]
        bias += step[size + 1]
        model["transition"] = model["transition"] + step[size + 2 : size + 6].reshape(2, 2) * 0.3
        model["start"] += step[-1] * 0.3
    theta[-1] = 0
    return model | {"theta": theta[:-1], "bias": bias}


def fit(documents: DataFrame, labels: DataFrame, learn=None, rows: int = SAMPLE_ROWS) -> dict:
    """Fit on at most ``rows`` labelled documents.

    What reaches the driver is bounded by the sample: its informative features, at most 6 windows of ``WINDOW`` tokens
    and two numbers of each document.
    """
    learn = fold("doc_id", 5) > 0 if learn is None else learn
    sample = stored(labelled_sample(documents, labels, "toxic", learn, rows).select("text", "label", F.xxhash64("doc_id").alias("h")))

    def count(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                label = part.column("label").to_numpy(zero_copy_only=False)
                _, _, row, h = tokens(data, off)
                keys, owner = h.ravel(), np.tile(row, len(h))
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])] if len(keys) else np.zeros(0, bool)
                kinds, back = np.unique(keys[new], return_inverse=True)
                toxic = np.bincount(back, weights=label[owner[new]], minlength=len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(kinds)) - toxic)], ["k", "t", "c"])

    counts = sample.select("label", "text").mapInArrow(count, "k bigint, t bigint, c bigint").groupBy("k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    known = counts.where((F.col("t") >= MIN_TOXIC) & (F.col("t") > 0.3 * (F.col("t") + F.col("c")))).toPandas().sort_values("k")
    if not len(known):
        return {"flat": True}
    keys = known["k"].to_numpy(np.int64).view(np.uint64)
    pure = (known["t"] >= PURE * (known["t"] + known["c"])).to_numpy()
    vocabulary = Vocabulary(keys, np.arange(len(keys)))

    def windows(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                label = part.column("label").to_numpy(zero_copy_only=False)
                hashes = part.column("h").to_numpy(zero_copy_only=False)
                s, _, row, h = tokens(data, off)
                x = np.full((len(s), _KINDS), -1, np.int32)
                y = np.zeros(len(s), bool)
                for k in range(_KINDS):
                    at, v = vocabulary(h[k])
                    x[at, k] = v
                    y[at] |= pure[v] & (label[row[at]] == 1)
                start = np.searchsorted(row, np.arange(len(off)))
                out = []
                for r in range(len(off) - 1):
                    lo, hi = start[r], start[r + 1]
                    if hi == lo:
                        continue
                    rng = np.random.default_rng(int(hashes[r]) & 0xFFFFFFFF)
                    spots = np.flatnonzero(y[lo:hi])
                    picks = rng.choice(spots, min(4, len(spots)), replace=False).tolist() if len(spots) else []
                    for p in [*picks, *rng.integers(0, hi - lo, 2).tolist()]:
                        a = lo + max(0, min(p - int(rng.integers(0, WINDOW)), hi - lo - WINDOW))
                        b = min(a + WINDOW, hi)
                        out.append((x[a:b].ravel(), y[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.bool_()))], ["x", "y"])

    got = sample.select("label", "h", "text").mapInArrow(windows, "x array<int>, y array<boolean>").toPandas()
    n = len(got)
    x, y, mask = np.full((n, WINDOW, _KINDS), -1), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    order = sorted(range(n), key=lambda i: np.asarray(got["x"].iat[i]).tobytes())  # any layout trains alike
    for j, i in enumerate(order):
        v, w = np.asarray(got["x"].iat[i]).reshape(-1, _KINDS), np.asarray(got["y"].iat[i])
        x[j, : len(w)], y[j, : len(w)], mask[j, : len(w)] = v, w, True
    model = train(x, y, mask, len(keys))
    model |= {"flat": False, "vocabulary": Vocabulary(keys, model.pop("theta"))}

    def totals(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column("label"), *[pa.array(v) for v in tag(model, data, off)[:2]]], ["label", "total", "most"])

    seen = sample.select("label", "text").mapInArrow(totals, "label int, total double, most double").toPandas()
    x, y = evidence(seen["total"].to_numpy(), seen["most"].to_numpy()), seen["label"].to_numpy(float)
    return model | {"layer": logistic(x, y, l2=1e-5) if 0 < y.mean() < 1 else None} if len(y) and 0 < y.mean() < 1 else {"flat": True}


def evidence(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), most])


def tag(model: dict, data: np.ndarray, off: np.ndarray):
    """Summed and largest marginal of each row; tokens with a marginal of 0.5 or more: row, start, end (bytes)."""
    n = len(off) - 1
    s, e, row, h = tokens(data, off)
    score = np.full(len(s), model["bias"])
    for k in range(_KINDS):
        at, v = model["vocabulary"](h[k])
        score[at] += v
    start = np.searchsorted(row, np.arange(n + 1))
    m = marginals(score, np.diff(start), start[:-1], model)
    most = np.zeros(n)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        most[some] = np.maximum.reduceat(m, start[some])
    hit = np.flatnonzero(m >= 0.5)
    return np.bincount(row, weights=m, minlength=n), most, row[hit], s[hit], e[hit]


def score(documents: DataFrame, model: dict) -> DataFrame:
    """All columns of ``documents`` (clashing result names are replaced), score and toxic_spans (start:end in code points)."""
    documents = documents.drop("score", "toxic_spans")
    schema = with_field(with_field(documents.schema, "score", "double"), "toxic_spans", "string")

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                n = len(off) - 1
                spans = [""] * n
                value = np.zeros(n)
                if not model["flat"]:
                    total, most, row, s, e = tag(model, data, off)
                    value = sigmoid(evidence(total, most) @ model["layer"])
                    if len(row):
                        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                        base = lead[off[row]]
                        for r, a, b in zip(row.tolist(), (lead[s] - base).tolist(), (lead[e] - base).tolist(), strict=True):
                            spans[r] += f",{a}:{b}" if spans[r] else f"{a}:{b}"
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(spans, pa.string())], [*part.schema.names, "score", "toxic_spans"])

    return documents.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")
