"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nystroem landmarks.

Units are the words of a text in lower case (split at white space; words over WIDTH characters in overlapping windows),
and runs of single characters joined. The kernel counts common subsequences of three letters whose span in either
string is at most SPAN, each weighted by DECAY to the power of its span, normalised to 1 for equal units. Characters
that are no letters only widen gaps, so `i-d.i*ot` is close to `idiot`, and stems are close to their inflections.

Learning: labels mark documents, so a toxic document is a bag whose best unit is toxic, and all units of a clean one are
clean. Every labelled document of the sample takes part. At first units are ranked by how strongly their letter
sequences (3 to 8 letters, however rare) stand for the label; each toxic document sends its best ones. Landmarks are
chosen among these and clean units, units are mapped to the landmarks' span (Nystroem), a squared-hinge machine is
fitted there, and its margins choose the documents' best units anew, with clean units that it gets wrong added, in
four rounds. Labels that no unit shows are left to the soft margin. Units of fewer than three letters have no
subsequence, and an insult made of several ordinary words is no unit: both teach nothing. Since the kernel is an inner
product over three-letter subsequences, the machine collapses into one weight for each, which scores units without
visiting landmarks. A document's margin is the largest of its units; a logistic curve placed by the training documents
turns it into the score.

A gap costs little (DECAY near 1), and frequent toxic units are also learned with one and two inserted letters; clean
units that resemble them are learned as such. Inserted characters that are no letters cost nothing, as such units are
also read without them.

Null and empty texts have no unit and get the lowest margin's score. Extra columns are ignored; an empty table gives an
empty result; ties among ids are ranked by their hash. Without training rows of both labels the score is
0 everywhere. Rows with a null label or id teach nothing; an id with several labels counts as toxic if any says so.
Repeated rows get equal scores. Texts are read whole.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .batches import slices
from .sampling import lowest

WIDTH, SPAN, DECAY, BASE, GRAM_BITS = 24, 8, 0.95, 64, 24
PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
INSERTED = string.ascii_lowercase
SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def _classes() -> np.ndarray:
    """A class of 1 to 63 for each letter of the basic plane, 0 for what is no letter."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        s = chr(c)
        if "a" <= s <= "z":
            out[c] = c - 96
        elif s.isalpha():
            out[c] = 27 + c % 37
    return out


CLASS = _classes()


def units(text: str) -> list[str]:
    low = text.lower()
    return low.split() + ["".join(m.split()) for m in SPELLED.findall(low)]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of windows of WIDTH characters, and the index of the word that each row belongs to. A word that
    holds other characters also has the rows of its letters alone."""
    parts, own = [], []
    for i, w in enumerate(words):
        forms = (w,) if w.isalpha() else (w, "".join(filter(str.isalpha, w)))
        for f in forms:
            for a in range(0, max(1, len(f) - WIDTH // 2), WIDTH // 2) if len(f) > WIDTH else (0,):
                parts.append(f[a : a + WIDTH])
                own.append(i)
    n = np.array([len(p) for p in parts])
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(parts), WIDTH), np.int32)
    out[np.arange(WIDTH) < n[:, None]] = CLASS[np.minimum(codes, 0xFFFF)]
    return out, np.array(own, np.int64)


def _windows(words: list[str]) -> np.ndarray:
    """The first window of each word."""
    rows, own = _matrix([w[:WIDTH] for w in words])
    return rows[np.r_[True, own[1:] != own[:-1]]] if len(rows) else rows


def _features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all subsequences of each row (0: none) and their weights."""
    codes, weights = [], []
    for a, b in PAIRS:
        x, y, z = rows[:, : WIDTH - b], rows[:, a : WIDTH - b + a], rows[:, b:]
        codes.append(np.where((x > 0) & (y > 0) & (z > 0), (x * BASE + y) * BASE + z, 0))
        weights.append(np.full(WIDTH - b, DECAY ** (b + 1), np.float32))
    return np.concatenate(codes, 1), np.concatenate(weights)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The square root of the kernel of each row with itself."""
    order = np.argsort(codes, 1, kind="stable")
    s = np.take_along_axis(codes, order, 1)
    w = weights[order].astype(np.float64)
    first = np.ones(s.shape, bool)
    first[:, 1:] = s[:, 1:] != s[:, :-1]
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(w.ravel(), starts) * (s.ravel()[starts] > 0)
    return np.sqrt(np.bincount(starts // s.shape[1], sums * sums, len(s)))


@dataclass
class Model:
    weights: np.ndarray  # by subsequence code
    bias: float
    slope: float
    shift: float
    limit: int = 700_000
    _seen: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def unit_margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for g in range(0, len(words), 4096):
            rows, own = _matrix(words[g : g + 4096])
            top, low = np.zeros(len(rows)), np.full(len(rows), 1e-12)
            for a, b in PAIRS:
                x, y, z = rows[:, : WIDTH - b], rows[:, a : WIDTH - b + a], rows[:, b:]
                w = DECAY ** (b + 1)
                top += w * self.weights[(x * BASE + y) * BASE + z].sum(1)
                low += w * w * ((x > 0) & (y > 0) & (z > 0)).sum(1)
            near = np.flatnonzero(top > 0)
            near = near[top[near] / np.sqrt(low[near]) + self.bias > -0.9]  # the norm is at least sqrt(low)
            if len(near):
                c, w = _features(rows[near])
                np.maximum.at(out, g + own[near], top[near] / np.maximum(_norms(c, w), 1e-9) + self.bias)
        return out

    def margins(self, texts: list[str]) -> np.ndarray:
        found = [units(t) for t in texts]
        new = [u for u in set().union(*found) if u not in self._seen] if found else []
        if len(self._seen) + len(new) > self.limit:
            self._seen = {}
            new = list(set().union(*found))
        if new:
            self._seen.update(zip(new, self.unit_margins(new).tolist(), strict=True))
        get = self._seen.__getitem__
        return np.array([max(map(get, f)) if f else self.bias for f in found])

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -50, 50)))


def _grams(words: list[str], sizes: range = range(3, 9)) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter sequences of the words' windows, and the word that each belongs to."""
    codes, own = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for g in range(0, len(words), 4096):
        rows, of = _matrix(words[g : g + 4096])
        h, letters = np.zeros(rows.shape, np.uint64), np.ones(rows.shape, bool)
        for n in range(1, sizes.stop):
            width = WIDTH - n + 1
            h = h[:, :width] * np.uint64(0x9E3779B97F4A7C15) + rows[:, n - 1 :].astype(np.uint64)
            letters = letters[:, :width] & (rows[:, n - 1 :] > 0)
            if n in sizes:
                r, c = np.nonzero(letters)
                codes.append((((h[r, c] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
                own.append(g + of[r])
    return np.concatenate(codes), np.concatenate(own)


def _places(bags: list[set[str]]) -> np.ndarray:
    """How many bags hold each letter sequence."""
    out = np.zeros(1 << GRAM_BITS, np.int32)
    for bag in bags:
        out[np.unique(_grams(list(bag))[0])] += 1
    return out


def strengths(words: list[str], bad: list[set[str]], good: list[set[str]]) -> np.ndarray:
    """For each word that of its strongest letter sequence: the root of the likelihood ratio of its share among toxic texts
    against its share among clean ones, 0 if the latter is larger. No sequence is too rare to count."""
    codes, own = _grams(words)
    t, c = _places(bad)[codes].astype(np.float64), _places(good)[codes].astype(np.float64)
    m, n = len(bad), len(good)
    r = (t + c) / (m + n)
    part = lambda k, of: np.where(k > 0, k * np.log(np.maximum(k, 1) / of / r), 0)
    rest = lambda k, of: np.where(k < of, (of - k) * np.log(np.maximum(of - k, 1) / of / np.maximum(1 - r, 1e-12)), 0)
    g = 2 * (part(t, m) + rest(t, m) + part(c, n) + rest(c, n))
    out = np.zeros(len(words))
    np.maximum.at(out, own, np.where(t / m > c / n, np.sqrt(np.maximum(g, 0)), 0))
    return out


class _Kernel:
    """Normalised kernels of units with a set of landmarks."""

    def __init__(self, marks: list[str]) -> None:
        codes, self.w = _features(_windows(marks))
        self.norm = np.maximum(_norms(codes, self.w), 1e-9)
        self.codes = np.unique(codes[codes > 0])
        self.column = np.full(BASE**3, -1, np.int64)
        self.column[self.codes] = np.arange(len(self.codes))
        self.dense = self._dense(codes) / self.norm[:, None]

    def _dense(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.codes)), np.float32)
        at = self.column[codes]
        r, c = np.nonzero((at >= 0) & (codes > 0))
        np.add.at(out, (r, at[r, c]), self.w[c])
        return out

    def __call__(self, words: list[str]) -> np.ndarray:
        out = []
        for g in range(0, len(words), 512):
            codes, _ = _features(_windows(words[g : g + 512]))
            out.append(self._dense(codes) @ self.dense.T / np.maximum(_norms(codes, self.w), 1e-9)[:, None])
        return np.concatenate(out) if out else np.zeros((0, len(self.dense)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    y, weight = y.astype(x.dtype), weight.astype(x.dtype)
    w = np.zeros(x1.shape[1])
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-6
    active = None
    for _ in range(25):
        on = y * (x1 @ w.astype(x.dtype)) < 1
        if active is not None and (on == active).all():
            break
        active = on
        held = x1[on]
        a = held * weight[on, None]
        w = np.linalg.solve(reg + cost * (a.T @ held).astype(np.float64), cost * (a.T @ y[on]).astype(np.float64))
    return w[:-1], float(w[-1])


def _spread(words: list[str], n: int) -> list[str]:
    """Farthest-first choice of n units."""
    if len(words) <= n:
        return words
    k = _Kernel(words)(words)
    chosen, near = [0], k[0].copy()
    while len(chosen) < n:
        i = int(near.argmin())
        chosen.append(i)
        near = np.maximum(near, k[i])
    return [words[i] for i in chosen]


def _witnesses(bags: list[np.ndarray], value: np.ndarray, share: float, most: int) -> dict[int, float]:
    """The best units of each bag (those near its best one) and for how many bags each stands."""
    out: dict[int, float] = {}
    for bag in bags:
        v = value[bag]
        best = bag[v >= v.max() - (1 - share) * abs(v.max())]
        for i in best[np.argsort(-value[best], kind="stable")][:most].tolist():
            out[i] = out.get(i, 0.0) + 1 / min(len(best), most)
    return out


@dataclass(frozen=True)
class Bounds:
    """What bounds the work of fitting, all of it on the driver. Documents are never dropped by these."""

    landmarks: int = 480
    rounds: int = 4
    candidates: int = 1500  # units among which landmarks of a side are chosen, those of the most documents first
    clean_units: int = 6000  # clean units at the start, evenly over the sorted vocabulary
    hard_units: int = 6000  # clean units added in a round, those that are most wrong first
    witnesses: int = 20_000  # toxic units in a round, over all documents; 4 of each at least
    near: float = 0.4  # a document's units count as its best ones down to this share of the best one's value
    gapped_units: int = 60  # toxic units of which variants with inserted letters are learned, those of the most documents first
    gapped_each: int = 24  # variants of each, half of them with one and half with two inserted letters


def build(toxic: list[str], clean: list[str], bounds: Bounds = Bounds()) -> Model:
    """Learns from toxic and clean texts: each toxic text as a bag whose best unit is toxic, each clean one as a bag of clean units."""
    bad, good = ([set(units(t)) for t in dict.fromkeys(x)] for x in (toxic, clean))
    clean_df = Counter(chain.from_iterable(good))
    toxic_df = Counter(chain.from_iterable(bad))
    candidates = sorted(w for w in toxic_df if _letters(w) >= 3)
    vocabulary = sorted(w for w in clean_df if _letters(w) >= 3)
    if not candidates or not good:
        return Model(np.zeros(BASE**3, np.float32), -1.0, 1.0, -50.0)
    index = {w: i for i, w in enumerate(candidates)}
    bags = [np.array(b) for x in bad if (b := sorted(index[w] for w in x if w in index))]
    value = strengths(candidates, bad, good)
    prior = value / max(1.0, value.max())
    neg = vocabulary[:: max(1, len(vocabulary) // bounds.clean_units)]
    known = set(neg)
    rng = np.random.default_rng(11)
    model = Model(np.zeros(BASE**3, np.float32), -1.0, 1.0, -50.0)
    for _ in range(bounds.rounds):
        carried = {candidates[i]: n for i, n in _witnesses(bags, value, bounds.near, max(4, bounds.witnesses // len(bags))).items()}
        pos = sorted(carried, key=lambda w: (-carried[w], zlib.crc32(w.encode("utf-8", "surrogatepass"))))
        gapped: dict[str, float] = {}  # frequent units with one and two inserted letters, so that the machine learns to bear them
        for w in [p for p in pos if len(p) >= 4 and p.isalpha() and carried[p] >= 2][: bounds.gapped_units]:
            for each in range(bounds.gapped_each):
                v = w
                for _ in range(1 + each % 2):
                    k = int(rng.integers(1, len(v)))
                    v = v[:k] + INSERTED[int(rng.integers(len(INSERTED)))] + v[k:]
                gapped.setdefault(v, carried[w] / 5)
        carried |= {w: n for w, n in gapped.items() if w not in clean_df and w not in carried}
        pos = list(carried)
        marks = _spread(pos[: bounds.candidates], bounds.landmarks * 2 // 3)
        marks += _spread(neg[::-1][: bounds.candidates], bounds.landmarks - len(marks))
        kernel = _Kernel(marks)
        kmm = kernel(marks).astype(np.float64)
        val, vec = np.linalg.eigh((kmm + kmm.T) / 2)
        ok = val > 1e-6 * val.max()
        root = vec[:, ok] / np.sqrt(val[ok])
        x = np.concatenate([kernel(pos), kernel(neg)]) @ root.astype(np.float32)
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        often, seen = np.array([carried[p] for p in pos]) ** 0.5, np.sqrt([clean_df[w] * len(bad) / len(good) for w in neg])
        w, bias = _machine(x, y, np.r_[often / often.sum(), seen / seen.sum()] * 1000)
        table = np.zeros(BASE**3, np.float32)
        table[kernel.codes] = kernel.dense.T @ (root @ w)
        model = Model(table, bias, 1.0, 0.0)
        value = model.unit_margins(candidates) + prior
        got = model.unit_margins(vocabulary)
        hard = [vocabulary[i] for i in np.argsort(-got, kind="stable").tolist() if got[i] > -0.5]
        hard = [h for h in hard if h not in known][: bounds.hard_units]
        known.update(hard)
        neg += hard
    model.slope, model.shift = curve(model.margins(toxic), model.margins(clean))
    return model


def _letters(word: str) -> int:
    return sum(map(str.isalpha, word))


def curve(toxic: np.ndarray, clean: np.ndarray, slope: float = 5.0) -> tuple[float, float]:
    """A logistic curve with a fixed slope that crosses 1/2 where the classes part best: in the middle of the longest
    stretch of margins with the greatest difference of true and false positive rates. Documents whose label their words
    do not show (far beyond the stretch) don't move it, as they would a fitted slope."""
    at = np.unique(np.concatenate([toxic, clean, [-1.0, 1.0]]))
    edge = (at[1:] + at[:-1]) / 2
    gain = np.array([(toxic > e).mean() - (clean > e).mean() for e in edge])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    widest = max(best.tolist(), key=lambda i: at[i + 1] - at[i])
    return slope, -slope * float(edge[widest])


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, max_chars: int) -> DataFrame:
    """A bounded sample: of each class the `per_class` labelled ids that hash lowest among texts of at most `max_chars` characters."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg((F.max(label) > 0).cast("int").alias("_y"))
    known = docs.where(F.col(text).isNotNull() & (F.length(text) <= max_chars)).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    ranked = lowest(marked.join(known, "_k", "left_semi"), "_y", "_k", per_class)
    rows = known.join(F.broadcast(ranked), "_k").groupBy("_k").agg(F.first("_y").alias("label"), F.min("_t").alias("text"))  # an id's rows count once
    return rows.select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 2500, max_chars: int = 8_000) -> Model:
    got = training_rows(docs, labels, key, text, label, per_class, max_chars).toArrow().sort_by([("label", "ascending"), ("text", "ascending")])
    y = got["label"].to_pylist()
    t = got["text"].to_pylist()
    return build([x for x, v in zip(t, y, strict=True) if v], [x for x, v in zip(t, y, strict=True) if not v])


def score(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column of scores from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        caches.claim("toxicity")
        parts = [held.value.scores(t) for _, t in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return run(F.col(text))
