"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base kinds (email, ip, card, phone) are found by pattern and validity check.  The field's nodes are the tokens of a text that hold
a digit or an at sign; each has a label, one of the kinds or none.  Node potentials are linear in 63 bits of the shapes of the token
and its neighbours; chain edges join nodes of adjacent tokens.  Tokens with the same key (mail name; last seven digits; the token
itself where it has four to six digits) share an entity: a skip edge joins each of them with one variable for the entity's
label, so any two are two edges apart however far they lie.  What base patterns found is observed.  Loopy sum-product passes
messages over all documents of a chunk until they settle; a token drawn to a kind becomes a span where no base span lies.

All weights are fitted together by pseudo-likelihood: each token's label given its shape, its neighbours' labels and the entity's
label as its other occurrences show it.  Labels are those of the base patterns in all documents, as counts of equal cases, of
which the ``CASES`` most frequent reach the driver.  A token without a label that shares its entity with a labelled one is what the
field is to decide, so it teaches nothing.  How far an entity keeps its label is one weight for all kinds; tokens that repeat
count once more with their own shape and neighbours hidden, so that it is learnt apart from them.

Edge cases: null and empty texts have no spans and the hash of the empty string; repeated rows are reported each;
without a labelled token nothing is added; an empty table gives no rows; clashing columns are replaced.  Digits are ASCII digits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, per_row, table

KINDS = ("email", "ip", "card", "phone")
CASES = 20_000
OBSERVED = 12.0  # log-odds of a base label
SETTLED, ROUNDS = 1e-4, 500
SURE = 0.6

# matches of these begin at the start of a digit run, whatever went before, so the lookbehind only saves restarts
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at)):
                out.append((0, start, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")  # linear: words are entered at their start only
_EDGE = "\"'`,;:!?<>[]{}*#$%&.|"


def nodes_of(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, stripped token and key ('' if none) of each token with a digit or an at sign."""
    out = []
    for m in _TOKEN.finditer(text):
        raw = m[0]
        left = len(raw) - len(raw.lstrip(_EDGE))
        tok = raw.strip(_EDGE)
        if not tok:
            continue
        digits = _digits(tok)
        key = ""
        if "@" in tok:
            key = "@" + tok.lower().split("@")[0]
        elif len(digits) >= 7:
            key = digits[-7:]
        elif len(digits) >= 4:
            key = "=" + tok.lower()
        out.append((m.start() + left, m.start() + left + len(tok), tok, key))
    return out


_BUCKETS = (1, 4, 7, 8, 10, 13, 17, 20)
_BITS = 21


def _byte(part: str) -> bool:
    return 0 < len(part) < 4 and part.isascii() and part.isdigit() and int(part) <= 255


def shape(tok: str) -> int:
    """``_BITS`` bits: number of digits (9), at sign, dots (5), plus in front, bracket, hyphen, letters, card check, four bytes."""
    d = _digits(tok)
    return (
        1 << sum(len(d) >= b for b in _BUCKETS) | ("@" in tok) << 9 | 1 << 10 + min(4, tok.count(".")) | (tok[0] == "+") << 15 | ("(" in tok) << 16
        | ("-" in tok) << 17 | any(c.isalpha() for c in tok) << 18 | (13 <= len(d) <= 19 and luhn(d)) << 19
        | (tok.count(".") == 3 and all(map(_byte, tok.split(".")))) << 20
    )


def graph(text: str):
    """Nodes, shapes of each with its neighbours' (63 bits), whether each touches the next one, and the entity of each (-1: of its own)."""
    nodes = nodes_of(text)
    n = len(nodes)
    own = np.array([shape(t[2]) for t in nodes], np.uint64)
    touch = np.array([nodes[i + 1][0] - nodes[i][1] <= 2 for i in range(n - 1)], bool) if n > 1 else np.zeros(0, bool)
    bits = own.copy()
    if n > 1:
        bits[1:][touch] |= own[:-1][touch] << np.uint64(_BITS)
        bits[:-1][touch] |= own[1:][touch] << np.uint64(2 * _BITS)
    held: dict[str, list[int]] = {}
    for i, t in enumerate(nodes):
        if t[3]:
            held.setdefault(t[3], []).append(i)
    entity, k = np.full(n, -1, np.int64), 0
    for places in held.values():
        if len(places) > 1:
            entity[places] = k
            k += 1
    return nodes, bits, touch, entity


def _labels(nodes, base) -> np.ndarray:
    """1 + kind of the first base span over each node, else 0."""
    out = np.zeros(len(nodes), np.int64)
    starts, ends = [t[0] for t in nodes], [t[1] for t in nodes]
    for s, e, k in sorted((s, e, k) for k, s, e in base):
        own = out[bisect_right(ends, s) : bisect_left(starts, e)]
        own[own == 0] = k + 1
    return out


def _busy(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that can hold personal data at all: an at sign or four digits."""
    return (per_row(((data >= 48) & (data <= 57)).view(np.uint8), off) >= 4) | (per_row((data == 64).view(np.uint8), off) > 0)


def cases(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and codes ((before * 6 + after) * 6 + entity) * 5 + label of the tokens that teach; 5 stands for nothing known."""
    nodes, bits, touch, entity = graph(text)
    n = len(nodes)
    y = _labels(nodes, base_spans(text))
    before, after = np.full(n, 5), np.full(n, 5)
    before[1:][touch], after[:-1][touch] = y[:-1][touch], y[1:][touch]
    # the entity's label by its other occurrences: the kind of most of them, else none
    votes = np.zeros((int(entity.max(initial=-1)) + 1, 5), np.int64)
    np.add.at(votes, (entity[entity >= 0], y[entity >= 0]), 1)
    other = np.full(n, 5)
    tied = np.flatnonzero(entity >= 0)
    own = votes[entity[tied]].copy()
    own[np.arange(len(tied)), y[tied]] -= 1
    own[:, 0] = own[:, 1:].sum(1) == 0
    other[tied] = own.argmax(1)
    other[(y > 0) & (other == 0)] = 5
    teaches = (y > 0) | (other == 0) | (other == 5)
    hidden = other == y
    code = lambda b, a, o, k: ((b * 6 + a) * 6 + o) * 5 + k
    five = np.full(int(hidden.sum()), 5)
    return np.concatenate([bits[teaches], np.zeros(len(five), np.uint64)]), np.concatenate([code(before, after, other, y)[teaches], code(five, five, other[hidden], y[hidden])])


def fit(documents: DataFrame, most: int = CASES) -> dict:
    """Weights from the labelled tokens of all documents; at most ``most`` kinds of case (the most frequent) reach the driver."""

    def learn(batches):
        for batch in batches:
            for _, data, off in chunks(batch):
                got = [cases(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")) for r in np.flatnonzero(_busy(data, off))]
                if got:
                    both = np.rec.fromarrays([np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])], names="x,c")
                    kinds, n = np.unique(both, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds["x"].astype(np.int64)), pa.array(kinds["c"].astype(np.int64)), pa.array(n.astype(np.int64))], ["x", "c", "n"])

    counted = documents.select("text").mapInArrow(learn, "x bigint, c bigint, n bigint").groupBy("x", "c").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.col("n").desc(), "x", "c").limit(most).toPandas()
    x, c, n = (got[f].to_numpy(np.int64) for f in ("x", "c", "n"))
    return train(x.astype(np.uint64), c, n) if (c % 5 > 0).any() else {"flat": True}


def unpacked(bits: np.ndarray) -> np.ndarray:
    """One row of 63 bits and a constant for each shape."""
    out = np.ones((len(bits), 3 * _BITS + 1))
    for j in range(3 * _BITS):
        out[:, j] = (bits >> np.uint64(j)) & np.uint64(1)
    return out


def train(bits: np.ndarray, code: np.ndarray, count: np.ndarray, rounds: int = 400) -> dict:
    """Adam on the mean pseudo-likelihood of counted cases: node weights, chain weights (label, next label) and the entity weight."""
    y, other, after, before = code % 5, code // 5 % 6, code // 30 % 6, code // 180
    x, hot = unpacked(bits), np.eye(5)[y]
    known = np.eye(6)[:, :5]
    b, a, o = known[before], known[after], known[other]
    v = (count / count.sum())[:, None]
    size = (x.shape[1] * 5, 25, 1)
    theta = np.zeros(sum(size))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        w, chain, agree = theta[: size[0]].reshape(-1, 5), theta[size[0] : size[0] + 25].reshape(5, 5), theta[-1]
        z = x @ w + b @ chain + a @ chain.T + o * agree
        p = np.exp(z - z.max(1, keepdims=True))
        e = v * (p / p.sum(1, keepdims=True) - hot)
        g = np.concatenate([(x.T @ e).ravel(), (b.T @ e + e.T @ a).ravel(), [(o * e).sum()]]) + 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - 0.1 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
    return {"flat": False, "w": theta[: size[0]].reshape(-1, 5), "chain": theta[size[0] : size[0] + 25].reshape(5, 5), "agree": float(theta[-1])}


def propagate(node: np.ndarray, edges: np.ndarray, kind: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Marginals by damped loopy sum-product until no message moves by more than ``SETTLED``.

    node: (n, 5) log potentials; edges: (m, 2); kind: which of the (k, 5, 5) log ``potential`` tables each edge has.  Messages that
    go round for ever stop after ``ROUNDS`` rounds, 30 times what influence needs to die out with the damping of one half.
    """
    n, m = len(node), len(edges)
    if m == 0:
        p = np.exp(node - node.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table_, which = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)])), np.concatenate([kind, kind + len(potential)])
    message = np.zeros((2 * m, 5))
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])

    def gathered():
        out = node.copy()
        for k in range(5):
            out[:, k] += np.bincount(dst, weights=message[:, k], minlength=n)
        return out

    for _ in range(ROUNDS):
        belief = gathered()[src] - message[back]
        belief = np.exp(belief - belief.max(1, keepdims=True))
        new = np.empty_like(message)
        for k in range(len(table_)):
            own = which == k
            new[own] = np.log(belief[own] @ table_[k] + 1e-300)
        step = 0.5 * (new - new.mean(1, keepdims=True) - message)
        message += step
        if np.abs(step).max() < SETTLED:
            break
    belief = gathered()
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(model: dict, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text's base spans."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model["flat"]:
        return out
    graphs = [graph(t) for t in texts]
    start = np.concatenate([[0], np.cumsum([len(g[0]) for g in graphs])])
    n = int(start[-1])
    if not n:
        return out
    kinds, back = np.unique(np.concatenate([g[1] for g in graphs]), return_inverse=True)
    seen = [_labels(g[0], b) for g, b in zip(graphs, base, strict=True)]
    node = (unpacked(kinds) @ model["w"])[back]
    observed = np.concatenate(seen)
    node[np.flatnonzero(observed), observed[observed > 0]] += OBSERVED
    first = np.concatenate([np.flatnonzero(g[2]) + s for g, s in zip(graphs, start, strict=False)])
    many = np.cumsum([0, *[int(g[3].max(initial=-1)) + 1 for g in graphs]])
    entity = np.concatenate([np.where(g[3] >= 0, g[3] + m, -1) for g, m in zip(graphs, many, strict=False)])
    tied = np.flatnonzero(entity >= 0) if model.get("skip", True) else np.zeros(0, np.int64)
    edges = np.concatenate([np.stack([first, first + 1], 1), np.stack([tied, n + entity[tied]], 1)])
    kind = np.concatenate([np.zeros(len(first), np.int64), np.ones(len(tied), np.int64)])
    p = propagate(np.concatenate([node, np.zeros((int(many[-1]), 5))]), edges, kind, np.stack([model["chain"], np.eye(5) * model["agree"]]))[:n]
    label = np.where((p.argmax(1) > 0) & (p.max(1) >= SURE), p.argmax(1), 0)
    for r, g in enumerate(graphs):
        covered = seen[r] > 0
        now: tuple[int, int, int] | None = None
        for i, t in enumerate(g[0]):
            k = int(label[start[r] + i])
            if k and not covered[i]:
                if now and now[0] == k - 1 and t[0] - now[2] == 1:
                    now = (now[0], now[1], t[1])
                else:
                    if now:
                        out[r].append(now)
                    now = (k - 1, t[0], t[1])
            elif now:
                out[r].append(now)
                now = None
        if now:
            out[r].append(now)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def scan(documents: DataFrame, model: dict) -> DataFrame:
    """All columns but the text, base counts n_*, base_sha256, base and all spans."""
    new = [*[f"n_{k}" for k in KINDS], "base_sha256", "base", "spans"]
    documents = documents.drop(*new)
    names = [c for c in documents.columns if c != "text"]
    schema = T.StructType([documents.schema[c] for c in names] + [T.StructField(c, T.LongType() if c.startswith("n_") else T.StringType()) for c in new])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for part, data, off in chunks(batch):
                n = len(off) - 1
                at = np.flatnonzero(_busy(data, off)).tolist()
                texts = [data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in at]
                base = [base_spans(t) for t in texts]
                more = added_spans(model, texts, base)
                counts = np.zeros((4, n), np.int64)
                sha, own, all_ = [nothing] * n, [""] * n, [""] * n
                for r, b, m in zip(at, base, more, strict=True):
                    for k, _, _ in b:
                        counts[k, r] += 1
                    own[r], all_[r] = joined(b), joined(b + m)
                    sha[r] = hashlib.sha256(own[r].encode()).hexdigest()
                keep = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*keep, *[pa.array(c) for c in counts], pa.array(sha), pa.array(own), pa.array(all_)], [*names, *new])

    return documents.mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(documents, fit(documents)).drop("base")
