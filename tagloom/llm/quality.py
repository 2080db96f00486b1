"""Quality classifier: Bradley-Terry pairwise ranking.

Every text becomes a short vector of shape statistics.  On a bounded sample of labelled rows, preference
pairs (a document labelled 1 over one labelled 0) are fitted by logistic loss on feature differences, which
gives each document a worth.  The cut is the quantile of the worths at the share of rejected documents in the
sample; a score of 0.7 is put exactly there.

Edge cases: a null or empty text is scored like any other (its features are zero); repeated rows are scored each;
with no labelled rows, or labels of one kind only, every score is the neutral 0.7 (kept).  Null doc_id: scored, not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, chunks, fold, labelled_sample, logistic, mix, per_row, sigmoid, span_hashes, table, with_field, words

SAMPLE_ROWS = 12_000
PAIRS = 60_000
CUT = 0.7

_LUT = np.zeros((8, 256), np.uint8)
_LUT[0, 65:91] = 1  # upper case
_LUT[1, 97:123] = 1  # lower case
_LUT[2, [ord(c) for c in "#$%&*+<=>@\\^_`|~{}[]/"]] = 1  # symbols
_LUT[3, [ord(c) for c in "!?"]] = 1
_LUT[4, 48:58] = 1
_LUT[5, [ord(c) for c in ".,;:"]] = 1
_LUT[6, 128:] = 1
_LUT[7, 10] = 1
NAMES = ("length", "upper", "symbol", "exclaim", "digit", "stop", "other", "newline", "word_length", "repeat_next", "distinct_trigram", "distinct_word", "top_word", "upper_word", "empty")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    some = np.maximum(size, 1)
    count = [per_row(_LUT[i][data], off) for i in range(8)]
    letters = np.maximum(count[0] + count[1], 1)
    low = LOWER[data]
    s, e, row = words(low, off)
    h = span_hashes(low, s, e)
    total = np.bincount(row, minlength=n).astype(np.float64)
    many = np.maximum(total, 1)

    def distinct(keys, rows):
        if not len(keys):
            return np.zeros(n), np.zeros(n)
        key = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (keys >> np.uint64(24)))  # 40 bits of hash are ample for a ratio
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        r = (key[first] >> np.uint64(40)).astype(np.int64)
        run = np.diff(np.r_[first, len(key)])
        top = np.zeros(n)
        begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        top[r[begin]] = np.maximum.reduceat(run, begin)
        return np.bincount(r, minlength=n).astype(np.float64), top

    uniq, top = distinct(h, row)
    same = np.zeros(n)
    tri, tri_n = np.zeros(n), np.maximum(total - 2, 1)
    if len(h) > 1:
        pair = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        same = np.bincount(row[1:][pair], minlength=n).astype(np.float64)
    if len(h) > 2:
        inside = row[2:] == row[:-2]
        key = mix((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:])
        tri, _ = distinct(key[inside], row[2:][inside])
    upper = np.bincount(row, weights=((data[s] >= 65) & (data[s] <= 90) & (data[e - 1] < 97)).astype(float) if len(s) else None, minlength=n)
    x = [np.log1p(size) / 10, count[0] / letters]
    x += [np.sqrt(count[i] / some) for i in (2, 3, 4, 5, 6, 7)]
    x += [np.minimum(size / many, 40) / 10, np.sqrt(same / many), np.where(total > 2, tri / tri_n, 1.0), uniq / many, top / many, upper / many, (total == 0).astype(float)]
    return np.column_stack(x)


def _featurise(batches):
    for batch in batches:
        for part, data, off in chunks(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(features(data, off)), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(documents: DataFrame, labels: DataFrame, learn=None, rows: int = SAMPLE_ROWS, pairs: int = PAIRS) -> dict:
    """Fit on at most ``rows`` labelled documents (12 to 20 floats each reach the driver) and ``pairs`` pairs."""
    learn = fold("doc_id", 4) != 2 if learn is None else learn
    sample = labelled_sample(documents, labels, "quality", learn, rows).groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of a repeated id the least text
    id_type = documents.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "label", "text").mapInArrow(_featurise, f"doc_id {id_type}, label int, x array<double>").toPandas().sort_values("doc_id")
    y = got["label"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    if len(set(y.tolist())) < 2:
        return {"flat": True}
    x = np.vstack(got["x"].to_numpy())
    mean, sd = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / sd, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(11)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = logistic(diff, np.ones(pairs), l2=1e-3)
    worth = z @ w
    share = len(bad) / len(y)
    low, high = np.quantile(worth, share, method="lower"), np.quantile(worth, share, method="higher")
    cut = (low + high) / 2
    slope = logistic(((worth - cut) / (worth.std() + 1e-9))[:, None], y.astype(float), l2=1e-4)[0] / (worth.std() + 1e-9)
    return {"flat": False, "mean": mean, "sd": sd, "w": w, "cut": cut, "slope": max(float(slope), 1e-6)}


def scores(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    if model["flat"]:
        return np.full(len(off) - 1, CUT)
    z = np.clip((features(data, off) - model["mean"]) / model["sd"], -8, 8)
    return sigmoid(model["slope"] * (z @ model["w"] - model["cut"]) + np.log(CUT / (1 - CUT)))


def score(documents: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """All columns of ``documents`` (a clashing ``column`` is replaced) and the score of its text."""
    documents = documents.drop(column)
    schema = with_field(documents.schema, column, "double")

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(model, data, off))], [*part.schema.names, column])

    return documents.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
