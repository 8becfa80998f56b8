"""Quality classifier from weak labels.

Ten heuristic labellers vote on each document (good, bad or no opinion). Expectation-maximisation over the counts of
vote patterns (at most 3 to the 10, whatever the number of documents; all of them count) estimates each labeller's accuracy and the share of good
documents, and gives each pattern a posterior. Posterior labels of a bounded sample train a hashed linear scorer over
word shapes and a few binned shares; the scorer then judges every document by its whole text.

A null text, or one without a word, is rejected with score 0 and has no weak label (null). Repeated rows get equal
scores; ids may be null or repeat. On an empty table, or one where the labellers see one class alone, the scorer falls
back to the posterior of the prior. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .batches import slices
from .lineage import stage
from .sampling import lowest

GOOD, BAD, NONE = 0, 1, 2
DIM = 1 << 13
SYMBOLS = b"#*&$%@^~=<>{}[]\\_+"
CAPITALS = bytes(range(65, 91))
ASCII_LETTERS = CAPITALS + bytes(range(97, 123))
HIGH = bytes(range(128, 256))
#: Each labeller's name, the share up to which it votes good, and the share from which it votes bad.
LABELLERS = (
    ("symbols", 0.03, 0.10),
    ("capitals", 0.20, 0.50),
    ("exclamations", 0.05, 0.30),
    ("bars", 0.05, 0.20),
    ("lone_marks", 0.05, 0.20),
    ("word_said_twice", 0.12, 0.40),
    ("repeated_words", 0.65, 0.80),
    ("doubled_ends", 0.05, 0.30),
    ("marks", 0.07, 0.11),
    ("redundancy", 0.65, 0.80),
)
DOUBLED = re.compile(r"[^\w\s]{2}(?!\S)")


def shares(text: str) -> tuple[float, ...]:
    """What the labellers look at, in the order of LABELLERS. Characters beyond ASCII count as letters; 20 more characters in
    the denominator keep very short texts from looking odd."""
    b, words = text.encode(), text.split()
    n, size = max(1, len(words)), max(1, len(text))
    solid = max(1, size - text.count(" ") - text.count("\n"))
    ascii_letters = len(b) - len(b.translate(None, ASCII_LETTERS))
    digits = len(b) - len(b.translate(None, b"0123456789"))
    beyond = len(text) - len(b.translate(None, HIGH))
    return (
        (len(b) - len(b.translate(None, SYMBOLS))) / size,
        (len(b) - len(b.translate(None, CAPITALS))) / (ascii_letters + 20),
        text.count("!") / n,
        text.count("|") / n,
        sum(map(text.count, (" | ", " - ", " * "))) / n,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        len(DOUBLED.findall(text)) / n,
        (solid - ascii_letters - beyond - digits) / (solid + 20),
        1 - len(zlib.compress(b, 1)) / max(1, len(b)),
    )


def vote(values: tuple[float, ...]) -> int:
    """The votes as one number in base 3."""
    out = 0
    for v, (_, good, bad) in zip(values, LABELLERS, strict=True):
        out = 3 * out + (GOOD if v <= good else BAD if v >= bad else NONE)
    return out


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS))][::-1]


def votes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pattern (null for texts without a word) and chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vote(shares(t)) if t.strip() else None for t in texts], pa.int32()), pa.array([len(t) for t in texts], pa.int64())], ["key", "pattern", "chars"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, pattern int, chars long")


def expectation_maximisation(counts: dict[int, int], steps: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """The probability of `good` for each pattern, P(vote | class) by labeller and class, and the share of good documents.
    It starts from the number of bad votes (two or more: likely bad), and each labeller's table is smoothed by one document."""
    patterns = sorted(counts)
    if not patterns:
        return {}, np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    v = np.array([votes_of(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    signs = (v == BAD).sum(1)
    good = np.where(signs == 0, 0.95, np.where(signs == 1, 0.6, 0.05))
    table, prior = np.zeros((len(LABELLERS), 2, 3)), 0.5
    for _ in range(steps):
        w = np.stack([good * n, (1 - good) * n])
        prior = (w[0].sum() + 1) / (n.sum() + 2)
        for k in range(3):
            table[:, :, k] = ((v == k).T[:, None, :] * w[None]).sum(2) + 1 / 3
        table /= table.sum(2, keepdims=True)
        ll = np.log([prior, 1 - prior]) + np.log(table[np.arange(len(LABELLERS))[None, :, None], np.arange(2)[None, None, :], v[:, :, None]]).sum(1)
        new = 1 / (1 + np.exp(np.clip(ll[:, 1] - ll[:, 0], -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True)), table, float(prior)


_SHAPE = bytes([48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in range(256)])
_RUN = re.compile(rb"(.)\1+", re.S)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, runs shortened to two."""
    return _RUN.sub(rb"\1\1", word.encode().translate(_SHAPE)).decode("latin-1")


def bins(values: tuple[float, ...]) -> list[int]:
    return [zlib.crc32(f"{name}:{max(0, min(9, int(v * 20)))}".encode()) % DIM for (name, _, _), v in zip(LABELLERS, values, strict=True)]


@dataclass
class Model:
    posterior: dict[int, float]
    accuracy: np.ndarray
    prior: float
    weights: np.ndarray
    bias: float
    limit: int = 400_000
    _seen: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def _ids(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        found = [t.split() for t in texts]
        if len(self._seen) > self.limit:
            self._seen = {}
        for w in set().union(*found).difference(self._seen):
            self._seen[w] = zlib.crc32(shape(w).encode()) % DIM
        return found, np.fromiter(map(self._seen.__getitem__, chain.from_iterable(found)), np.int64)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, list[float | None]]:
        """The scorer's probability of good quality, and the labellers' posterior."""
        found, ids = self._ids(texts)
        counts = np.array([len(f) for f in found], np.int64)
        out, weak = np.zeros(len(texts)), [None] * len(texts)
        has = np.flatnonzero(counts)
        if len(has):
            z = np.add.reduceat(self.weights[ids], (np.cumsum(counts) - counts)[has]) / counts[has] + self.bias
            for k, i in enumerate(has.tolist()):
                v = shares(texts[i])
                z[k] += self.weights[bins(v)].sum()
                weak[i] = self.posterior.get(vote(v), self.prior)
            out[has] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        return out, weak

    def rows(self, texts: list[str]) -> np.ndarray:
        """Dense features of training texts: shares of hashed shapes, and bins."""
        out = np.zeros((len(texts), DIM), np.float32)
        for i, t in enumerate(texts):
            found, ids = self._ids([t])
            np.add.at(out[i], ids, np.float32(1 / max(1, len(ids))))
            np.add.at(out[i], bins(shares(t)), np.float32(1))
        return out


def train(model: Model, texts: list[str], target: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> None:
    """Logistic regression on posterior labels, by Adam steps over all rows; the classes weigh alike."""
    x = model.rows(texts)
    used = np.flatnonzero(x.any(0))
    x = x[:, used].astype(np.float64)
    wt = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    w, b, m, v = np.zeros(len(used)), 0.0, np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for s in range(1, steps + 1):
        d = wt * (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) - target)
        g = np.r_[x.T @ d + ridge * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.99**s)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    model.weights, model.bias = np.zeros(DIM), float(b)
    model.weights[used] = w


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = 1000, max_chars: int = 20_000) -> Model:
    """The labellers' votes are counted over all documents; the scorer learns from `per_class` documents that look good
    and as many that look bad, those whose ids hash lowest among texts of at most `max_chars` characters."""
    held = stage(votes(docs.where(F.col(text).isNotNull()), key, text), "votes").where(F.col("pattern").isNotNull())
    counts = {r["pattern"]: r["count"] for r in held.groupBy("pattern").count().collect()}  # at most 3 to the 10
    posterior, table, prior = expectation_maximisation(counts)
    model = Model(posterior, table, prior, np.zeros(DIM), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    bad = [p for p, g in posterior.items() if g < 0.5]
    if not bad or len(bad) == len(posterior):
        return model
    marked = held.where(F.col("key").isNotNull() & (F.col("chars") <= max_chars)).select(F.col("key").alias("_k"), F.col("pattern").alias("_p"), F.col("pattern").isin(bad).alias("_b"))
    ids = lowest(marked, "_b", "_k", per_class).select("_k", "_p").dropDuplicates(["_k"])
    own = docs.where(F.length(text) <= max_chars).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = own.join(F.broadcast(ids), "_k").groupBy("_k").agg(F.min("_t").alias("_t"), F.min("_p").alias("_p"))  # an id's rows count once
    got = rows.select("_t", "_p").toArrow().sort_by([("_t", "ascending"), ("_p", "ascending")])
    if len(got):
        train(model, got["_t"].to_pylist(), np.array([posterior[p] for p in got["_p"].to_pylist()]))
    return model


def judge(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column struct<score, weak>: the scorer's probability of good quality, and the labellers' posterior."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, weak: double>")
    def run(texts: pa.Array) -> pa.Array:
        caches.claim("quality")
        score, weak = [], []
        for _, part in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0, 1 << 20):
            a, b = held.value.judge(part)
            score += a.tolist()
            weak += b
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(weak, pa.float64())], ["score", "weak"])

    return run(F.col(text))
