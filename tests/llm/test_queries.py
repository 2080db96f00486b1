"""The registered queries on a whole small table, each held against a plain version of what it returns."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tagloom.llm import langid, queries, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 200
    return {r["doc_id"]: (r["text"], r["lang"]) for r in rows}


def result(spark, name: str, sf: str = SF) -> dict:
    rows = queries.QUERIES[name](spark, sf).collect()
    out = {r["doc_id"]: r.asDict() for r in rows}
    assert len(out) == len(rows)
    return out


def remainder(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def digest(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def plain_features(text: str) -> list[float]:
    """The features of one text by the definitions of their names, over its bytes."""
    data = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in w]
    count = lambda chars: sum(data.count(bytes([c])) for c in chars)
    size, many = max(len(data), 1), max(len(w), 1)
    upper, lower = count(range(65, 91)), count(range(97, 123))
    rates = [count(b"#$%&*+<=>@\\^_`|~{}[]/"), count(b"!?"), count(range(48, 58)), count(b".,;:"), count(range(128, 256)), data.count(b"\n")]
    kinds, trigrams = Counter(low), {tuple(low[i : i + 3]) for i in range(len(low) - 2)}
    shouted = sum(65 <= x[0] <= 90 and x[-1] < 97 for x in w)
    repeats = sum(a == b for a, b in zip(low, low[1:]))
    return [
        math.log1p(len(data)) / 10, upper / max(upper + lower, 1), *[math.sqrt(r / size) for r in rates], min(len(data) / many, 40) / 10, math.sqrt(repeats / many),
        len(trigrams) / max(len(w) - 2, 1) if len(w) > 2 else 1.0, len(kinds) / many, max(kinds.values(), default=0) / many, shouted / many, float(not w),
    ]


def test_op1_scores_are_those_of_plain_features(spark, texts):
    got = result(spark, "op1_quality")
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert got.keys() == texts.keys() and not model["flat"]
    for i, r in got.items():
        z = np.clip((np.array(plain_features(texts[i][0] or "")) - model["mean"]) / model["sd"], -8, 8)
        want = 1 / (1 + math.exp(-(model["slope"] * (float(z @ model["w"]) - model["cut"]) + math.log(0.7 / 0.3))))
        assert abs(r["score"] - want) < 1e-6
        assert r["held_out"] == (remainder(i, 4) == 2) and r["predicted"] == int(r["score"] >= 0.7)


def plain_fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op2_fingerprints_and_components(spark, texts):
    got = result(spark, "op2_simhash")
    fp = {i: plain_fingerprint(t or "") for i, (t, _) in texts.items()}
    root = {i: i for i in fp}
    for a in sorted(fp):
        for b in sorted(fp):
            if b < a and (fp[a] ^ fp[b]).bit_count() <= 2 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert len(set(root.values())) < len(root)


def test_op3_base_digests(spark):
    sf = "/root/testdata/sf0.01"  # the smaller table holds no secret
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    kinds = {"assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    fits = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    got, found = result(spark, "op3_secrets", sf), 0
    for i, text in texts.items():
        base = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "") if fits[k](m)]
        base.sort(key=lambda s: (s[1], list(kinds).index(s[0])))
        assert got[i]["base_sha256"] == digest(base)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) | {""}
        found += len(base)
    assert found and got.keys() == texts.keys()


def luhn(digits: str) -> bool:
    twice = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def test_op4_base_digests(spark, texts):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    bare = lambda m: re.sub("[^0-9]", "", m[0])
    fits = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 13 <= len(bare(m)) <= 19 and luhn(bare(m)), "phone": lambda m: 9 <= len(bare(m)) <= 15}
    got, found = result(spark, "op4_pii"), 0
    for i, (text, _) in texts.items():
        base = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text or "") if fits[k](m)]
        assert got[i]["base_sha256"] == digest(base)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) | {""}
        found += len(base)
    assert found and got.keys() == texts.keys()


def test_op6_digests(spark, texts):
    got, seen = result(spark, "op6_suffixes"), set()
    for i in sorted(texts):
        data = (texts[i][0] or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            piece = data[at : at + 100]
            if piece in seen:
                gone[at : at + 100] = b"\1" * 100
            seen.add(piece)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert got.keys() == texts.keys() and any(r["n_removed"] for r in got.values())


def test_op7_columns(spark, texts):
    got = result(spark, "op7_toxicity")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (remainder(i, 5) == 0)


def plain_bundle(text: str, d: int) -> tuple[np.ndarray, int]:
    symbols = [0]
    for ch in text:
        s = ord(ch.lower()[0]) if unicodedata.category(ch)[0] == "L" else 0
        if s or symbols[-1]:
            symbols.append(s)
    symbols.append(0)
    kinds = Counter(t for t in zip(symbols, symbols[1:], symbols[2:]) if t[1])
    out = np.zeros(d)
    for (a, b, c), n in kinds.items():
        out += n * (np.roll(langid.letter(a, d), 2) * np.roll(langid.letter(b, d), 1) * langid.letter(c, d)).astype(float)
    return out, sum(kinds.values())


def test_op10_predictions_are_those_of_plain_bundles(spark, texts):
    got, d = result(spark, "op10_langid"), langid.DIMENSIONS
    bundle = {i: plain_bundle(t or "", d) for i, (t, _) in texts.items()}
    names = sorted({lang for i, (t, lang) in texts.items() if lang is not None and t is not None and remainder(i, 5)})
    prototypes = np.stack([sum(bundle[i][0] for i, (t, lang) in texts.items() if lang == name and remainder(i, 5)) for name in names])
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    for i, r in got.items():
        vector, letters = bundle[i]
        assert r["held_out"] == (remainder(i, 5) == 0)
        if not letters:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosines = prototypes @ vector / np.linalg.norm(vector)
        assert abs(r["score"] - max(cosines.max(), 0)) < 1e-4 and cosines[names.index(r["lang_pred"])] > cosines.max() - 1e-4
    held = [i for i in got if remainder(i, 5) == 0 and bundle[i][1] and texts[i][1] is not None]
    assert np.mean([got[i]["lang_pred"] == texts[i][1] for i in held]) > 0.95
