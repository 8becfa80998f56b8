"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Words are maximal runs of word characters in lower case; a document is its set of five-word shingles (one of fewer
words: all of them as a single shingle; a null text or one without a word has no shingle and links with nothing).

1. Documents with equal shingle sets form a class, known by a 128-bit fingerprint; its representative is the smallest id.
2. A signature has TREES * DEPTH minhashes of 16 bits, DEPTH for each tree. Representatives with a common prefix in a tree
   stand below one node of its trie. Prefixes start at full depth; the similarities of the pairs found there (estimated
   from whole signatures) say how far prefixes must be shortened until pairs like them, down to the least similar ones
   seen, share one in some tree with the target probability. The trees are then searched again at that depth, where nodes
   whose representatives are connected already are passed over. The depth at which a pair at the threshold itself meets
   the target is the last.
3. Below a node signatures are sorted, neighbours are compared first, and what they leave apart is compared by ever
   shorter prefixes. Pairs whose estimate lies within five and a half deviations of the threshold connect. A large node is
   dealt to blocks by hash; representatives outside its largest component then meet all of its blocks.
4. Connected representatives form groups, and groups blocks of bounded text, dealt by hash. Each pair of blocks is one
   task's work: it compares the shingle sets exactly, by counting for groups of shingles that stand in the same
   documents, and returns each representative's links (weighted by class sizes) and a spanning forest of them.
5. Components of the forest give class ids.

Pairs are never emitted. A group of n different texts that all resemble each other still has n * n / 2 comparisons,
spread over blocks; exact copies cost nothing. Rows with a null id are left out. Repeated rows (equal id and text) each
get a row and count as copies. An id should stand for one text; of several its least text is compared, and all its rows
share that one's class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches, search
from .batches import slices
from .components import components, hub_join
from .lineage import drop, stage

WORD = re.compile(r"\w+")
TREES, DEPTH, GRAM = 16, 8, 5
BLOCK_CHARS, BLOCK_DOCS, ALL_PAIRS = 3_000_000, 1000, 24
BANDS = 50
_MERSENNE = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, trees: int, depth: int, target: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with the target probability."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASH = _Words()
caches.register("jaccard", _HASH.clear)


def shingles(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and how many each text has."""
    found = [WORD.findall(t.lower()) for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    h = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(found)), np.uint64, int(n.sum()))
    short = np.flatnonzero((n > 0) & (n < gram))
    count = np.maximum(n - gram + 1, 0)
    count[short] = 1
    starts = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    hp = np.concatenate([h, np.zeros(gram, np.uint64)])
    s = np.zeros(len(doc), np.uint64)
    for k in range(gram):
        s = (s ^ (s >> np.uint64(29))) * _MERSENNE + hp[at + k]
    if len(short):
        pos = np.cumsum(count) - count
        for i in short.tolist():
            s[pos[i]] = xxhash.xxh3_64_intdigest(" ".join(found[i]), seed=1)
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[first], np.bincount(doc[first], minlength=len(texts))


def shortened(seen: dict[int, int], depth: int, threshold: float, target: float) -> int:
    """The depth that the similarities seen at `depth` ask for: `seen` counts pairs by band (BANDS to 1). The least similar
    pairs seen must share a prefix with the target probability. Pairs near the threshold, on either side of it, stand for
    pairs at the threshold; so do fewer pairs than it takes to show the target."""
    least = min(seen, default=0) / BANDS
    if least < threshold + 0.04 or sum(seen.values()) * (1 - target) < 1:
        least = threshold
    return min(depth, depth_for(least, TREES, DEPTH, target))


def minhashes(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(documents, TREES * DEPTH) minhashes of 16 bits; documents without shingles must not be here."""
    starts = np.cumsum(counts) - counts
    odd = np.random.default_rng(20240229).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(counts), len(odd)), ">u2")
    for k, a in enumerate(odd):
        m = np.minimum.reduceat(s * a, starts)
        m ^= m >> np.uint64(31)
        out[:, k] = m * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    return out


def signatures(docs: DataFrame, key: str, text: str, gram: int) -> DataFrame:
    """key, fp (binary; null without shingles), chars, grams (number of shingles) and sig (all trees' minhashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.claim("jaccard")
        for part, texts in slices(batches, limit=2 << 20):
            s, n = shingles(texts, gram)
            has = np.flatnonzero(n)
            sig: list = [None] * len(texts)
            fp: list = [None] * len(texts)
            if len(has):
                rows = minhashes(s, n[has])
                ends = np.cumsum(n)
                for i, r in zip(has.tolist(), rows, strict=True):
                    sig[i] = r.tobytes()
                    fp[i] = xxhash.xxh3_128_digest(s[ends[i] - n[i] : ends[i]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(fp, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["key", "fp", "chars", "grams", "sig"]
            )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, fp binary, chars long, grams long, sig binary")


class _Node:
    """Signatures of representatives that may share prefixes, and which of them resemble each other."""

    def __init__(self, pdf: pd.DataFrame, threshold: float) -> None:
        self.sig = np.frombuffer(b"".join(pdf["sig"]), ">u2").reshape(len(pdf), -1).astype(np.uint16)
        self.grams, self.rep = pdf["grams"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
        self.label = np.unique(pdf["group"].to_numpy(np.int64), return_inverse=True)[1]
        self.threshold = threshold
        self.cut = threshold - 5.5 * (threshold * (1 - threshold) / self.sig.shape[1]) ** 0.5
        self.seen = np.zeros(BANDS + 1, np.int64)
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (i, j) that resemble each other; they are noted."""
        ok = np.flatnonzero(np.minimum(self.grams[i], self.grams[j]) >= self.threshold * np.maximum(self.grams[i], self.grams[j]) - 1e-9)
        i, j = i[ok], j[ok]
        same = np.concatenate([(self.sig[i[g : g + 65536]] == self.sig[j[g : g + 65536]]).mean(1) for g in range(0, len(i), 65536)] or [np.zeros(0)])
        on = same >= self.cut
        self.seen += np.bincount((same[on] * BANDS).astype(np.int64), minlength=BANDS + 1)
        self.a.append(i[on])
        self.b.append(j[on])
        return i[on], j[on]

    def all_pairs(self, groups: np.ndarray) -> None:
        """Compares all pairs in each row of (groups, members)."""
        x, y = np.triu_indices(groups.shape[1], 1)
        i, j = groups[:, x].ravel(), groups[:, y].ravel()
        apart = self.label[i] != self.label[j]
        self.near(i[apart], j[apart])

    def trie(self, rows: np.ndarray, tree: int, floor: int) -> None:
        """Sorts the signatures of one tree and connects what resembles each other, by prefixes of DEPTH to `floor`."""
        own = self.sig[rows, tree * DEPTH : (tree + 1) * DEPTH]
        order = np.lexsort(own.T[::-1])
        rows, own = rows[order], own[order]
        label = np.unique(self.label[rows], return_inverse=True)[1]

        def unite(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal label
            label = search.labels(len(rows) + 1, label[i], label[j])[label]

        at = np.empty(int(rows.max()) + 1, np.int64)
        at[rows] = np.arange(len(rows))
        common = np.cumprod(own[1:] == own[:-1], 1).sum(1)  # with the predecessor
        k = np.flatnonzero((common >= floor) & (label[1:] != label[:-1]))
        i, j = self.near(rows[k], rows[k + 1])
        unite(at[i], at[j])
        known: set[tuple[int, int]] = set()
        for depth in range(DEPTH, floor - 1, -1):
            ends = np.r_[np.flatnonzero(common < depth) + 1, len(rows)]
            for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if hi - lo < 2 or (lo, hi) in known:
                    continue
                known.add((lo, hi))
                done: set[int] = set()
                while True:
                    values, counts = np.unique(label[lo:hi], return_counts=True)
                    todo = [v for v in values[np.argsort(counts, kind="stable")[:-1]].tolist() if v not in done]
                    if not todo:
                        break
                    mine = lo + np.flatnonzero(label[lo:hi] == todo[0])
                    rest = lo + np.flatnonzero((label[lo:hi] != todo[0]) & ~np.isin(label[lo:hi], list(done)))
                    hit = False
                    step = max(1, 200_000 // max(1, len(rest)))
                    for g in range(0, len(mine), step):
                        m = mine[g : g + step]
                        i, j = self.near(rows[np.repeat(m, len(rest))], rows[np.tile(rest, len(m))])
                        if len(i):
                            unite(at[i], at[j])
                            hit = True
                            break
                    if not hit:
                        done.add(todo[0])

    def edges(self) -> pd.DataFrame:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.a, self.b))
        return search.spanning(self.rep, a, b, self.seen)


def below(pdf: pd.DataFrame, threshold: float, floor: int) -> pd.DataFrame:
    """Edges between representatives of the same node and block."""
    node = _Node(pdf, threshold)
    order = np.lexsort((pdf["block"], pdf["node"], pdf["tree"]))
    key = pdf[["tree", "node", "block"]].to_numpy(np.int64)[order]
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    size = np.diff(np.r_[start, len(order)])
    for n in np.unique(size[(size > 1) & (size <= ALL_PAIRS)]).tolist():
        first = start[size == n]
        step = max(1, 1_000_000 // (n * n))
        for g in range(0, len(first), step):
            node.all_pairs(order[first[g : g + step, None] + np.arange(n)])
    for k in np.flatnonzero(size > ALL_PAIRS).tolist():
        node.trie(order[start[k] : start[k] + size[k]], int(key[start[k], 0]), floor)
    return node.edges()


def across(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Edges between representatives outside the largest component of a node (side 0) and a block of all of them (side 1)."""
    node = _Node(pdf, threshold)
    side = pdf["side"].to_numpy(np.int64)
    for _, own in pdf.groupby(["tree", "node", "i", "j"], sort=False).indices.items():
        mine, rest = own[side[own] == 0], own[side[own] == 1]
        step = max(1, 200_000 // max(1, len(rest)))
        for g in range(0, len(mine), step):
            i, j = np.repeat(mine[g : g + step], len(rest)), np.tile(rest, len(mine[g : g + step]))
            apart = node.label[i] != node.label[j]
            i, j = node.near(i[apart], j[apart])
            if len(i):  # what is connected now need not meet again
                node.label = search.labels(len(side) + 1, node.label[i], node.label[j])[node.label]
    return node.edges()


def _leaves(reps: DataFrame, depth: int) -> DataFrame:
    """A row for each tree: the node of that depth below which the representative stands."""
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(F.expr("sig").substr(t * (2 * DEPTH) + 1, F.lit(2 * depth))))
    return reps.select("rep", "group", F.posexplode(nodes).alias("tree", "node"))


def _below(depth: int, threshold: float) -> search.Search:
    return search.Search(lambda r: _leaves(r, depth), TREES, ("grams", "sig"), lambda p: below(p, threshold, depth), lambda p: across(p, threshold))


def forest(reps: DataFrame, threshold: float, target: float) -> DataFrame:
    """(vertex, component) of representatives (rep, grams, sig) that prefixes bring together, staged; see the module's text."""
    total, depth, groups, seen = reps.count(), DEPTH, None, {}
    while True:
        groups, bands = search.connected(reps, groups, _below(depth, threshold), total)
        for band, n in bands.items():
            seen[band] = seen.get(band, 0) + n
        again = shortened(seen, depth, threshold, target)
        if again == depth:
            return groups
        depth = again


def overlaps(s: np.ndarray, counts: np.ndarray, left: int, chunk: int = 8192) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all sets. Shingles that stand in the same sets count together."""
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    order = np.argsort(s, kind="stable")
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    starts = np.flatnonzero(first)
    size = np.diff(np.r_[starts, len(s)])
    mark = np.random.default_rng(7).integers(0, 2**64, (2, n), dtype=np.uint64)
    out = np.zeros((left, n), np.float64)
    if not len(starts):
        return out
    sets = np.stack([np.add.reduceat(m[doc], starts) for m in mark], 1)[size > 1]  # sums of random marks know the set
    begin, size = starts[size > 1], size[size > 1]
    if not len(begin):
        return out
    _, at, weight = np.unique(sets, axis=0, return_index=True, return_counts=True)
    begin, size = begin[at], size[at]
    for g in range(0, len(begin), chunk):
        b, z, w = begin[g : g + chunk], size[g : g + chunk], weight[g : g + chunk]
        row = np.repeat(np.arange(len(b)), z)
        col = doc[np.repeat(b, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)]
        m = np.zeros((len(b), n), np.float32)
        m[row, col] = 1
        out += (m[:, :left] * w[:, None].astype(np.float32)).T @ m
    return out


def verify(pdf: pd.DataFrame, threshold: float, gram: int) -> pd.DataFrame:
    """Links of one pair of blocks (side 0 against side 1; side 0 alone: all pairs in it): for each representative the
    classes' sizes it links with, and its root in a spanning forest."""
    caches.claim("jaccard")
    pdf = pdf.sort_values(["side", "key"], ignore_index=True)
    s, n = shingles(pdf["text"].tolist(), gram)
    left, same = int((pdf["side"] == 0).sum()), not (pdf["side"] == 1).any()
    inter = overlaps(s, n, left)
    if not same:
        inter = inter[:, left:]
    total = n[:left, None] + (n[None, :] if same else n[None, left:]) - inter
    link = inter >= threshold * total - 1e-9
    if same:
        np.fill_diagonal(link, False)
    size, keys = pdf["size"].to_numpy(np.int64), pdf["key"].to_numpy(np.int64)
    out = np.zeros(len(pdf), np.int64)
    right = size if same else size[left:]
    out[:left] += (link * right).sum(1)
    if not same:
        out[left:] += (link * size[:left, None]).sum(0)
    root = np.arange(len(pdf))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    shift = 0 if same else left
    for i in range(left):
        seen = set()
        for j in np.flatnonzero(link[i]).tolist():
            a, b = find(i), find(j + shift)
            if a != b and b not in seen:
                root[max(a, b)] = min(a, b)
            seen.add(b)
    top = np.array([find(i) for i in range(len(pdf))])
    used = np.flatnonzero(out)
    return pd.DataFrame({"key": keys[used], "links": out[used], "root": keys[top[used]]})


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, gram: int = GRAM, target: float = 0.9995) -> DataFrame:
    """One row for each document: key, class_id (the smallest id of its component), n_links (other documents it links
    with, copies included), kept (it is that smallest id)."""
    docs = docs.where(F.col(key).isNotNull())
    rows = stage(signatures(docs, key, text, gram), "signatures", tidy=False)
    has = rows.where(F.col("fp").isNotNull())
    classes = has.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("size"), F.max("chars").alias("chars"), F.first("grams").alias("grams"), F.first("sig").alias("sig"))
    reps = stage(classes, "representatives", tidy=False)
    points = reps.groupBy("rep").agg(F.min_by(F.struct("size", "chars", "grams", "sig"), "fp").alias("x")).select("rep", "x.*")
    points = stage(points, "points", tidy=False)
    groups = forest(points.select("rep", "grams", "sig"), threshold, target)
    light = groups.join(points.select("rep", "size", "chars"), groups["vertex"] == F.col("rep")).select("component", "rep", "size", "chars")
    light = stage(light, "groups", tidy=False)
    tasks = search.block_pairs(light, F.greatest(F.sum("chars") / BLOCK_CHARS, F.count("*") / BLOCK_DOCS))
    own = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(light.select("rep"), "rep", "left_semi")
    work = tasks.join(own.groupBy("rep").agg(F.min("text").alias("text")), "rep").select("component", "i", "j", "side", F.col("rep").alias("key"), "size", "text")
    found = stage(work.groupBy("component", "i", "j").applyInPandas(lambda p: verify(p, threshold, gram), "key long, links long, root long"), "links")
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = reps.select("fp", "rep", "size").join(links, F.col("rep") == F.col("key"), "left").drop("key").join(joined, F.col("rep") == F.col("vertex"), "left")
    known = known.select("fp", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    known = stage(known, "classes", tidy=False)
    drop(reps, points, groups, light, found, joined)
    out = hub_join(rows.select("key", "fp").where("fp is not null"), known, ["fp"], "size", has.count()).select("key", "class_id", "n_links")
    out = out.unionByName(rows.where("fp is null").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return out.withColumn("kept", F.col("key") == F.col("class_id"))
