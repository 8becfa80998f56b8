"""Language ID: known words by per-language log frequency, unseen words by progressively shorter character n-grams.

A null text, or one without a letter, is `und` with score 0. Texts of letters that no language has seen get the most
frequent learned language with a low score. Ties go to the language that sorts first. With no training rows everything
is `und`. Words are maximal runs of letters in lower case; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .batches import slices
from .sampling import lowest

WORD = re.compile(r"[^\W\d_]+")
LETTER = regex.compile(r"\p{L}")
ORDERS = (5, 4, 3, 2, 1)
UND = "und"


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        counts: Counter = Counter()
        for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
            counts.update((lang, w) for w in WORD.findall(text.lower()))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def training_rows(docs: DataFrame, lang: str, text: str, key: str, per_lang: int, max_chars: int) -> DataFrame:
    """A bounded sample: of each language the `per_lang` texts of at most `max_chars` characters whose ids hash lowest."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= max_chars))
    ids = lowest(known.select(F.col(key).alias("_k"), F.col(lang).alias("_l")), "_l", "_k", per_lang).select("_k").distinct()
    rows = known.join(F.broadcast(ids), F.col(key) == F.col("_k"), "left_semi").groupBy(F.col(key), F.col(lang).alias("lang"))
    return rows.agg(F.min(text).alias("text")).select("lang", "text")  # an id's rows count once


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    prior: np.ndarray
    limit: int = 300_000
    _index: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": {}, "_table": None}

    def _unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean of its known n-grams of the longest order that has one."""
        out = np.tile(self.prior, (len(words), 1)).astype(np.float32)
        left = list(range(len(words)))
        for n in ORDERS:
            if not left:
                break
            flat: list[int] = []
            counts = []
            for i in left:
                w = f"^{words[i]}$"
                k = max(1, len(w) - n + 1)
                flat += [self.grams.get(w[j : j + n], -1) for j in range(k)]
                counts.append(k)
            ids = np.array(flat, np.int64)
            ok = ids >= 0
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            known = np.add.reduceat(ok.astype(np.int64), starts)
            sums = np.add.reduceat(np.where(ok[:, None], self.gram_scores[ids], 0), starts, axis=0)
            hit = known > 0
            where = np.array(left)[hit]
            out[where] = sums[hit] / known[hit, None]
            left = [i for i, h in zip(left, hit, strict=True) if not h]
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log scores by text and language, and the number of words."""
        found = [WORD.findall(t.lower()) for t in texts]
        new = [w for w in set().union(*found) if w not in self._index]
        if self._table is None or len(self._index) + len(new) > len(self._table):  # start anew from the learned words
            self._index = dict(self.words)
            new = [w for w in set().union(*found) if w not in self._index]
            self._table = np.empty((len(self.words) + max(self.limit, len(new)), len(self.langs)), np.float32)
            self._table[: len(self.words)] = self.word_scores
        if new:
            at = len(self._index)
            self._table[at : at + len(new)] = self._unseen(new)
            self._index.update(zip(new, range(at, at + len(new)), strict=True))
        counts = np.array([len(f) for f in found])
        ids = np.fromiter(map(self._index.__getitem__, chain.from_iterable(found)), np.int64, counts.sum())
        out = np.zeros((len(texts), len(self.langs)))
        if len(ids):
            has = counts > 0
            out[has] = np.add.reduceat(self._table[ids].astype(np.float64), (np.cumsum(counts) - counts)[has], axis=0)
        return out, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        sums, counts = self.totals([t or "" for t in texts])
        mean = sums / np.maximum(counts, 1)[:, None] * np.minimum(counts, 10)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang = [self.langs[b] if c and LETTER.search(t) else UND for b, c, t in zip(best, counts, texts, strict=True)]
        return lang, [float(p[i, b]) if x != UND else 0.0 for i, (b, x) in enumerate(zip(best, lang, strict=True))]


def build(rows: list[tuple[str, str, int]], least: int = 2, smooth: float = 0.5) -> Model:
    """The model of (language, word, count) rows. Words seen fewer than `least` times only teach n-grams."""
    langs = sorted({r[0] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    total: Counter = Counter()
    for _, w, n in rows:
        total[w] += n
    words = {w: i for i, w in enumerate(w for w, n in total.items() if n >= least)}
    counts = np.zeros((len(words), len(langs)))
    grams: dict[str, int] = {}
    cells: Counter = Counter()
    by = np.zeros((len(ORDERS), len(langs)))
    size = np.zeros(len(langs))
    for lang, w, n in rows:
        j = at[lang]
        size[j] += n
        if w in words:
            counts[words[w], j] += n
        w = f"^{w}$"
        for k, o in enumerate(ORDERS):
            for i in range(max(1, len(w) - o + 1)):
                cells[grams.setdefault(w[i : i + o], len(grams)), j] += 1
            by[k, j] += max(1, len(w) - o + 1)
    g = np.zeros((len(grams), len(langs)))
    for (i, j), n in cells.items():
        g[i, j] = n
    keep = [(s, i) for s, i in grams.items() if len(s) == 1 or g[i].sum() >= least]
    order = np.array([ORDERS.index(len(s)) if len(s) in ORDERS else 0 for s, _ in keep], int)
    g = np.log((g[[i for _, i in keep]] + smooth) / (by[order] + smooth * max(1, len(keep)))) if keep else g
    prior = np.log((size + 1) / (size.sum() + len(langs))) if langs else size
    return Model(langs, words, np.log((counts + smooth) / (size + smooth * max(1, len(words)))).astype(np.float32), {s: i for i, (s, _) in enumerate(keep)}, g.astype(np.float32), prior.astype(np.float32))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_lang: int = 600, max_chars: int = 50_000) -> Model:
    """Learns from a bounded sample (see training_rows); only (language, word, count) rows of it reach the driver."""
    rows = training_rows(docs, lang, text, key, per_lang, max_chars).mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    return build(sorted(zip(got["lang"].to_pylist(), got["word"].to_pylist(), got["n"].to_pylist(), strict=True)))


def predict(model: Model, docs: DataFrame, text: str = "text") -> Column:
    """A column struct<lang, score> of `text`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        caches.claim("langid")
        langs, scores = [], []
        for _, part in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), 0, 1 << 20):
            a, b = held.value.predict(part)
            langs += a
            scores += b
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(F.col(text))
