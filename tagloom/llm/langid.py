"""Language identification by hyperdimensional profiles.

Each letter owns a random bipolar vector, drawn from a generator seeded by its code point.  A letter trigram is the
product of its letters' vectors, cyclically permuted by their place; a text is the sum (bundle) of its trigrams, and a
language the sum of its learning texts.  A text takes the language whose prototype has the largest cosine.

Prototypes are bundled from about ``SAMPLE_PER_LANGUAGE`` learning documents of each language (hash-thresholded by the
language's count, so rare languages keep all theirs); everything else covers every row.

Edge cases: null text, or text with no letter: ``und`` with score 0; no learning rows: ``und`` everywhere; rows with a null
lang are never learnt from; ties go to the smaller language name; repeated rows are scored each.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fold, table, with_field

DIMENSIONS = 1024
SAMPLE_PER_LANGUAGE = 1500
SEED = 20_017
_SLAB = 8192
_GROUP = 192


_tables: dict[str, np.ndarray] = {}  # a worker's own; functions travel by value, so nothing here may need the module by name


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane, 0 for what is no letter."""
    if "letters" in _tables:
        return _tables["letters"]
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low[0])
    _tables["letters"] = out
    return out


def _symbols(code: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(code, 0xFFFF)]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        kinds, back = np.unique(code[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if unicodedata.category(chr(c))[0] == "L" else 0 for c in kinds], np.uint32)[back]
    return out


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, middle and right symbol and row of each letter; runs of non-letters are one boundary symbol, 0."""
    n = len(off) - 1
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[off]
    if at[-1] != len(code):  # bytes that are no UTF-8
        parts = [np.frombuffer(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32) for i in range(n)]
        code = np.concatenate(parts) if parts else code
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    sym = np.insert(_symbols(code), at[:-1], 0)
    row = np.repeat(np.arange(n), np.diff(at) + 1)
    keep = np.flatnonzero((sym > 0) | (np.concatenate([[1], sym[:-1]]) > 0))
    sym, row = np.append(sym[keep], 0).astype(np.uint32), row[keep]
    mid = np.flatnonzero(sym[:-1] > 0)
    return sym[mid - 1] if len(mid) else sym[:0], sym[mid], sym[mid + 1], row[mid]


_vectors: dict[int, np.ndarray] = {}


def letter(c: int, d: int) -> np.ndarray:
    got = _vectors.get((c, d))
    if got is None:
        got = _vectors[(c, d)] = (np.random.default_rng((SEED, c)).integers(0, 2, d, np.int8) * 2 - 1).astype(np.float32)
    return got


def _bind(alphabet: np.ndarray, codes: np.ndarray, d: int) -> np.ndarray:
    own = np.stack([letter(int(c), d) for c in alphabet])
    k = len(alphabet)
    left, mid = np.roll(own, 2, axis=1), np.roll(own, 1, axis=1)
    return left[codes // (k * k)] * mid[codes // k % k] * own[codes % k]


def bundles(data: np.ndarray, off: np.ndarray, groups: np.ndarray | None = None, d: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The hypervector and the number of letters of each row (or of each group of rows)."""
    n = len(off) - 1 if groups is None else int(groups.max()) + 1 if len(groups) else 0
    out, count = np.zeros((n, d), np.float32), np.zeros(n, np.int64)
    a, b, c, row = trigrams(data, off)
    if not len(a):
        return out, count
    if groups is not None:
        row = groups[row]
        order = np.argsort(row, kind="stable")
        a, b, c, row = a[order], b[order], c[order], row[order]
    count = np.bincount(row, minlength=n)
    alphabet = np.unique(np.concatenate([np.unique(x) for x in (a, b, c)]))
    k = len(alphabet)
    if int(alphabet[-1]) < 1 << 17:
        ids = np.zeros(int(alphabet[-1]) + 1, np.int64)
        ids[alphabet] = np.arange(k)
        code = (ids[a] * k + ids[b]) * k + ids[c]
    else:
        code = (np.searchsorted(alphabet, a).astype(np.int64) * k + np.searchsorted(alphabet, b)) * k + np.searchsorted(alphabet, c)
    if k**3 <= 1 << 21:
        kinds = np.flatnonzero(np.bincount(code, minlength=k**3))
        dense = np.zeros(k**3, np.int64)
        dense[kinds] = np.arange(len(kinds))
        code = dense[code]
    else:
        kinds, code = np.unique(code, return_inverse=True)
    for low in range(0, len(kinds), _SLAB):
        bound = _bind(alphabet, kinds[low : low + _SLAB], d)
        size = len(bound)
        for g in range(0, n, _GROUP):
            s, e = np.searchsorted(row, [g, g + _GROUP])
            part = code[s:e] - low
            if len(kinds) > _SLAB:
                inside = (part >= 0) & (part < size)
                part, r = part[inside], row[s:e][inside]
            else:
                r = row[s:e]
            if len(part):
                rows = min(_GROUP, n - g)
                out[g : g + rows] += np.bincount((r - g) * size + part, minlength=rows * size).reshape(rows, size).astype(np.float32) @ bound
    return out, count


def fit(documents: DataFrame, learn: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE, d: int = DIMENSIONS) -> dict:
    """Language names and unit prototypes, from at most about ``per_language`` documents of each."""
    learn = (fold("doc_id", 5) > 0) if learn is None else learn
    rows = documents.select("doc_id", "text", "lang").where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {"names": [], "prototypes": np.zeros((0, d), np.float32)}
    names = sorted(counts)
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, per_language / counts[name]))])
    unit = F.xxhash64("doc_id", F.lit(SEED)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = rows.where(unit < share[F.col("lang")]).select("lang", "text")

    def partial(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                langs = part.column("lang").to_pylist()
                kinds = sorted(set(langs))
                vec, _ = bundles(data, off, np.array([kinds.index(x) for x in langs]), d)
                full = np.zeros((len(kinds), d))
                full[: len(vec)] = vec
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(list(full), pa.list_(pa.float64()))], ["lang", "v"])

    summed = sample.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    proto = np.zeros((len(names), d))
    at = {x: i for i, x in enumerate(names)}
    proto[summed["lang"].map(at).to_numpy(int), summed["i"].to_numpy(int)] = summed["x"].to_numpy(float)
    norm = np.linalg.norm(proto, axis=1, keepdims=True)
    return {"names": names, "prototypes": (proto / np.where(norm > 0, norm, 1)).astype(np.float32)}


def identify(documents: DataFrame, model: dict, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``documents`` (clashing result names are replaced) with the language and its cosine."""
    documents = documents.drop(lang, score)
    schema = with_field(with_field(documents.schema, lang, "string"), score, "double")
    names, proto = np.array([*model["names"], "und"], object), model["prototypes"]

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                vec, count = bundles(data, off, d=proto.shape[1])
                norm = np.linalg.norm(vec, axis=1)
                cos = (vec @ proto.T) / np.where(norm > 0, norm, 1)[:, None] if len(proto) else np.zeros((len(vec), 0))
                some = (count > 0) & (len(proto) > 0)
                best = np.where(some, cos.argmax(1) if len(proto) else 0, len(names) - 1)
                value = np.where(some, np.clip(cos.max(1) if len(proto) else 0.0, 0, 1), 0.0).astype(float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(value)], [*part.schema.names, lang, score])

    return documents.mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = identify(documents.select("doc_id", "text"), fit(documents))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
