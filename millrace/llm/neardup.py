"""Near-duplicates of vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label form a class; its representative is the smallest id.
2. For each length of vectors rotations are learned from a bounded sample (lengths other than the commonest with at most
   BLOCK vectors have one table with one bucket, so all their pairs are compared): principal directions, then alternating
   between the nearest corners of the cube and the orthogonal map that fits them best (iterative quantisation), each from
   another start. A vector's code has CODE_BITS bits, one for each rotated coordinate, which the rotation keeps balanced.
3. Codes are cut into substrings, the keys of as many tables; their width grows with the logarithm of the number of vectors
   of the length's largest label, so that buckets stay small, and the number of tables with it, until pairs at the threshold
   share a key somewhere with the target probability (bits taken as independent, each differing by angle / pi).
4. Below a key, codes are compared by Hamming distance: pairs within the radius (six deviations above the distance expected
   at the threshold) connect. Only codes travel to the tables.
5. Connected vectors are reranked: all pairs of a component are compared by the cosine of their original components in
   double precision, in pairs of blocks; vectors travel once for each block of their component. Each task returns link
   counts, weighted by class sizes, and a spanning forest; components of the forests give the ids.

Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link with
nothing. Vectors of different lengths don't link. Rows with a null id are left out. Repeated rows (equal id, vector and
label) each get a row and count as copies; an id should stand for one vector: of several, one with the least digest is
compared, and all rows of that id share its class. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search
from .components import components, hub_join
from .lineage import drop, stage

BLOCK, CODE_BITS = 1500, 256


def width_for(vectors: int) -> int:
    """Bits of a table's key for so many vectors of one label: buckets then hold some tens of rows."""
    return min(24, max(8, math.ceil(math.log2(max(2, vectors) / 64))))


def tables_for(threshold: float, width: int, target: float) -> int:
    """Tables with which a pair at the threshold shares a key with the target probability."""
    same = (1 - math.acos(threshold) / math.pi) ** width
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - same)))


def quantise(x: np.ndarray, seed: int, steps: int = 40) -> np.ndarray:
    """A rotation (dimensions, bits) learned on the rows of x by iterative quantisation."""
    d = x.shape[1]
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    basis = vt.T if vt.shape[0] == d else np.eye(d)
    v = x @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(steps):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(v.T @ b)
        r = u @ wt
    return basis @ r


def learn(vectors: np.ndarray, tables: int, width: int) -> list[np.ndarray]:
    """For each table the `width` directions whose signs are its key, taken from as many rotations as needed."""
    d = vectors.shape[1]
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out: list[np.ndarray] = []
    seed = 0
    while len(out) < tables:
        r = quantise(x, seed)
        if d < width:  # short vectors: one key from several rotations
            r = np.concatenate([r, *(quantise(x, seed + 1000 * k) for k in range(1, -(-width // d)))], 1)
        order = np.random.default_rng(seed).permutation(r.shape[1])
        out += [r[:, order[a : a + width]] for a in range(0, r.shape[1] - width + 1, width)]
        seed += 1
    return out[:tables]


def _numbers(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(vector.isNotNull() & label.isNotNull() & finite & some, F.lit(False))


def radius(threshold: float) -> float:
    """The Hamming distance within which codes count as near."""
    p = math.acos(threshold) / math.pi
    return CODE_BITS * (p + 6 * math.sqrt(p * (1 - p) / CODE_BITS))


def _near(codes: np.ndarray, i: np.ndarray, j: np.ndarray, most: float) -> np.ndarray:
    return np.bitwise_count(codes[i] ^ codes[j]).sum(1) <= most


def _codes(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(len(pdf), -1)


def below(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """Edges between near codes of the same table, bucket and block."""
    codes, a, b = _codes(pdf), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in pdf.groupby(["tree", "node", "block"], sort=False).indices.values():
        step = max(1, 1_000_000 // len(own))
        for g in range(0, len(own), step):
            x, y = np.triu_indices(len(own), 1) if step >= len(own) else (np.repeat(np.arange(g, min(g + step, len(own))), len(own)), np.tile(np.arange(len(own)), min(step, len(own) - g)))
            i, j = own[x], own[y]
            on = _near(codes, i, j, most)
            a.append(i[on])
            b.append(j[on])
    return search.spanning(pdf["rep"].to_numpy(np.int64), np.concatenate(a), np.concatenate(b))


def across(pdf: pd.DataFrame, most: float) -> pd.DataFrame:
    """Edges between near codes of side 0 and side 1."""
    codes, side = _codes(pdf), pdf["side"].to_numpy(np.int64)
    mine, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 1_000_000 // max(1, len(rest)))
    for g in range(0, len(mine), step):
        i, j = np.repeat(mine[g : g + step], len(rest)), np.tile(rest, len(mine[g : g + step]))
        on = _near(codes, i, j, most)
        a.append(i[on])
        b.append(j[on])
    return search.spanning(pdf["rep"].to_numpy(np.int64), np.concatenate(a), np.concatenate(b))


def rerank(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks of one component; see jaccard.verify for the sides."""
    pdf = pdf.sort_values(["side", "rep"], ignore_index=True)
    left = int((pdf["side"] == 0).sum())
    same = left == len(pdf)
    x = np.array(pdf["vector"].tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    link = x[:left] @ (x if same else x[left:]).T >= threshold
    if same:
        link = np.triu(link, 1)
    size, ids = pdf["size"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
    shift = 0 if same else left
    n = np.zeros(len(pdf), np.int64)
    n[:left] += link @ size[shift:]
    n[shift:] += link.T @ size[:left]
    i, j = np.nonzero(link)
    top = search.labels(len(pdf), i, j + shift)
    used = np.flatnonzero(n)
    return pd.DataFrame({"rep": ids[used], "links": n[used], "root": ids[top[used]]})


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, target: float = 0.995, sample: int = 4000) -> DataFrame:
    """One row for each vector: key, n_links, component_id, kept."""
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), _numbers(F.col(vector)).alias("vector"))
    rows = rows.withColumn("class", F.when(usable(F.col("vector"), F.col("label")), F.sha2(F.concat_ws(",", F.transform("vector", lambda x: (x + 0.0).cast("string"))), 256)))
    rows = rows.withColumn("d", F.when(F.col("class").isNotNull(), F.size("vector")))
    usable_rows = rows.where(F.col("class").isNotNull())
    groups = usable_rows.groupBy("d", "label").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()  # one row a length
    if not groups:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    commonest = max(groups, key=lambda g: (g["n"], g["d"]))["d"]
    learned, most_tables = {}, 1
    for g in groups:  # the vectors of a length that fit in one block need no tables; they are all compared
        if g["n"] > BLOCK or g["d"] == commonest:
            x = usable_rows.where(F.col("d") == g["d"]).orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()  # bounded
            width = width_for(g["most"])
            tables = tables_for(threshold, width, target)
            learned[g["d"]] = (tables, learn(np.array([r[0] for r in x]), max(tables, -(-CODE_BITS // width)), width))
            most_tables = max(most_tables, tables)
    cuts = spark.sparkContext.broadcast(learned)

    @F.pandas_udf("struct<keys: array<long>, code: binary>")
    def coded(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"keys": pd.Series([[0]] * len(v), dtype=object), "code": pd.Series([bytes(CODE_BITS // 8)] * len(v), dtype=object)})
        for d, at in v.reset_index(drop=True).groupby(v.reset_index(drop=True).map(len)).groups.items():
            if d in cuts.value:
                m = np.array(v.iloc[at].tolist(), np.float64)
                tables, directions = cuts.value[d]
                bits = np.stack([m @ c >= 0 for c in directions], 1)
                keys = bits[:, :tables] @ (1 << np.arange(bits.shape[2], dtype=np.int64))
                code = np.packbits(bits.reshape(len(m), -1)[:, :CODE_BITS], axis=1)
                out.loc[at, "keys"] = pd.Series(list(keys), index=at, dtype=object)
                out.loc[at, "code"] = pd.Series([c.tobytes() for c in code], index=at, dtype=object)
        return out

    classes = usable_rows.groupBy("label", "class").agg(F.min("key").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"), F.first("d").alias("d"))
    classes = stage(classes, "classes", tidy=False)
    reps = classes.groupBy("rep").agg(F.min_by(F.struct("label", "size", "vector", "d"), F.struct("class", "label")).alias("x")).select("rep", "x.*")
    reps = stage(reps.withColumn("c", coded("vector")).select("rep", "label", "size", "vector", "d", "c.keys", "c.code"), "vectors", tidy=False)

    def leaves(r: DataFrame) -> DataFrame:
        return r.select("rep", "group", "label", "d", F.posexplode("keys").alias("tree", "key")).select("rep", "group", "tree", F.xxhash64("label", "d", "key").alias("node"))

    most = radius(threshold)
    near = search.Search(leaves, most_tables, ("code",), lambda p: below(p, most), lambda p: across(p, most))
    light = reps.select("rep", "label", "d", "keys", "code")
    found, _ = search.connected(light, None, near, reps.count())
    members = stage(found.join(reps.select("rep", "size"), found["vertex"] == F.col("rep")).select("component", "rep", "size"), "groups", tidy=False)
    tasks = search.block_pairs(members, F.count("*") / BLOCK)
    work = tasks.join(reps.select("rep", "vector"), "rep")
    links = stage(work.groupBy("component", "i", "j").applyInPandas(lambda p: rerank(p, threshold), "rep long, links long, root long"), "links")
    joined = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select(F.col("label").alias("l"), F.col("class").alias("c"), "rep", "size").join(linked, "rep", "left").join(joined, F.col("rep") == F.col("vertex"), "left")
    known = known.select("l", "c", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = stage(known.select(F.col("l").alias("label"), F.col("c").alias("class"), "size", "n_links", "component_id"), "known", tidy=False)
    drop(reps, classes, found, members, links, joined)
    total = sum(g["n"] for g in groups)
    rows = rows.select("key", "label", "class")
    out = hub_join(rows.where("class is not null"), known, ["label", "class"], "size", total).select("key", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(rows.where("class is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")))
    return out.withColumn("kept", F.col("key") == F.col("component_id"))
