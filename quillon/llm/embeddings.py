"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector o is rotated at random and coded by the signs of its components, as a point c of the unit cube's corners.
With the stored factor <c, o>, the product <c, q> / <c, o> is an unbiased estimate of <o, q> for any unit vector q, and
its error is at most epsilon * sqrt(1 - <c, o>^2) / (<c, o> * sqrt(D - 1)) with a probability that falls off with
exp(-epsilon^2 / 2).  Pairs whose upper bound, from either side, lies below the threshold are settled by their codes;
the others are computed anew in double precision.

Vectors of a label of more than CELL vectors are divided into cells around the label's centroids.  Each vector is at home in
its nearest cell, and a guest in every cell of a lower number whose half-space its ball of the search angle reaches: no
linked pair is missed, and each is met once, in the lower of its two homes.  A cell too large for one task is cut into
blocks of members and of guests, and each pair of blocks with a member block is one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillon.llm.common import ceil_div, join_spread, materialize, table
from quillon.llm.components import Labels, components

SEED = 42
THRESHOLD = 0.93
EPSILON = 6.0
#: Vectors of a label that are compared without cells, and vectors in a block.
CELL, BLOCK = 16_384, 4_096
#: Vectors that centroids are fitted on, at most, and never more than half; the most centroids; all vectors are dealt to cells and compared.
SAMPLE, CENTROIDS = 20_000, 4_096


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated vectors and the factors <c, o>."""
    turned = unit @ rotation(unit.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(unit.shape[1])


def fit_centroids(unit: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of a few rounds of spherical k-means."""
    rng = np.random.default_rng(SEED)
    c = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(6):
        near = (unit @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


def units(raw, kind: str, d: int) -> np.ndarray:
    """Vectors, stored as bytes of a number type, as unit vectors in double precision."""
    v = np.frombuffer(b"".join(raw), kind).reshape(-1, d).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def compare_blocks(a: pd.DataFrame, b: pd.DataFrame, same: bool, threshold: float, kind: str, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weights of a's and of b's rows, and stars (i, j) over a's rows followed by b's."""
    va, vb = (units(x["vec"], kind, d) for x in (a, b))
    wa, wb = a["n"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
    fa, fb = a["factor"].to_numpy(), b["factor"].to_numpy()
    turn = rotation(d).T
    signs = [np.unpackbits(np.array([np.frombuffer(c, np.uint8) for c in x["code"]]), axis=1)[:, :d].astype(np.float32) * 2 - 1 for x in (a, b)]
    turned = [(v @ turn / np.sqrt(d)).astype(np.float32) for v in (va, vb)]
    slack = [EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / max(1, d - 1)) * np.sqrt(1 - threshold**2) / f + 1e-4 for f in (fa, fb)]
    la, lb, labels = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), Labels(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    for at in range(0, len(a), 512):
        rows = slice(at, at + 512)
        near = (signs[0][rows] @ turned[1].T) / fa[rows, None] + slack[0][rows, None] >= threshold
        near &= (turned[0][rows] @ signs[1].T) / fb[None, :] + slack[1][None, :] >= threshold
        if same:
            near &= np.arange(len(b))[None, :] > np.arange(at, at + near.shape[0])[:, None]
        if near.mean() > 0.02:  # dense: one product is cheaper than gathering pairs
            near &= va[rows] @ vb.T >= threshold
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            ok = np.einsum("ij,ij->i", va[at + i], vb[j]) >= threshold
            i, j = i[ok], j[ok]
        la[rows] += np.bincount(i, wb[j], near.shape[0]).astype(np.int64)
        lb += np.bincount(j, wa[at + i], len(b)).astype(np.int64)
        labels.join(at + i, shift + j)
    if same:
        la, lb = la + lb, lb[:0]
    return la, lb, *labels.stars()


def read_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, label, key, vec) of each row, stored, and the number type of vec's bytes.

    Vectors that can link have their bytes, without negative zeros, and a digest of these as key; others have nulls.
    """
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType)
    kind = "<f4" if single else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["vector"]
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            odd, some = (np.append(0, np.cumsum(x)) for x in (~np.isfinite(flat), flat != 0))
            known = ~lists.is_null().to_numpy(zero_copy_only=False) & ~b["label"].is_null().to_numpy(zero_copy_only=False)
            good = known & (odd[at[1:]] == odd[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            plain = (flat + 0.0).astype(kind)
            raw = [plain[x:y].tobytes() if ok else None for x, y, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_pydict({"id": b["id"], "label": b["label"], "key": pa.array(keys, pa.binary()), "vec": pa.array(raw, pa.binary())})

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    return materialize(rows.mapInArrow(run, f"id {id_type}, label {label_type}, key binary, vec binary"), "vectors"), kind


def link_vectors(rows: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (id, label, key, vec): classes (cls, label, key, least, n), their linked weights (cls, linked), and links (a, b)."""
    size = np.dtype(kind).itemsize
    d_of = (F.octet_length("vec") / size).cast("int").alias("d")
    counts = {(r["label"], r["d"]): r["count"] for r in rows.groupBy("label", d_of).count().where(F.col("count") > CELL).collect()}
    centers: dict[tuple, np.ndarray] = {}
    if counts:
        large = rows.sparkSession.createDataFrame(list(counts), rows.select("label", d_of).schema)
        of = rows.select("label", d_of, "vec").join(F.broadcast(large), ["label", "d"])
        sample: dict[tuple, list] = {}
        for r in of.sample(min(0.5, SAMPLE / sum(counts.values())), SEED).collect():
            sample.setdefault((r["label"], r["d"]), []).append(r["vec"])
        for at, part in sample.items():  # a label that the sample leaves out stays one cell
            centers[at] = fit_centroids(units(part, kind, at[1]), min(CENTROIDS, ceil_div(counts[at], CELL // 2), len(part)))
    # How far beyond the plane between two cells a vector may lie and still be linked across it.
    beyond = np.sqrt(max(0.0, 1 - threshold**2)) if threshold > 0 else 2.0

    def reached(unit: np.ndarray, c: np.ndarray) -> list[list[int]]:
        """Each vector's home, then the lower cells that may hold a linked vector."""
        if len(c) == 1:
            return [[0]] * len(unit)
        apart = np.linalg.norm(c[:, None] - c[None], axis=2) if len(c) <= 512 else None
        out = []
        for x in unit @ c.T:
            h = int(x.argmax())
            far = apart[h, :h] if apart is not None else np.linalg.norm(c[:h] - c[h], axis=1)
            out.append([h, *np.flatnonzero(x[h] - x[:h] <= beyond * far + 1e-9).tolist()])
        return out

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, groups = b["vec"].to_pylist(), {}
            for i, (label, raw) in enumerate(zip(b["label"].to_pylist(), vec)):
                groups.setdefault((label, len(raw) // size), []).append(i)
            ds, bits, factors, cells = np.zeros(len(vec), np.int32), [b""] * len(vec), np.zeros(len(vec)), [[]] * len(vec)
            for (label, d), some in groups.items():
                unit = units([vec[i] for i in some], kind, d)
                codes, factors[some] = coded(unit)
                ds[some] = d
                for i, x, y in zip(some, codes, reached(unit, centers.get((label, d), np.zeros((1, d))))):
                    bits[i], cells[i] = x.tobytes(), y
            columns = {c: b[c] for c in ("cls", "label", "key", "vec", "least", "n")}
            yield pa.RecordBatch.from_pydict(columns | {"d": ds, "code": pa.array(bits, pa.binary()), "factor": factors, "cells": pa.array(cells, pa.list_(pa.int64()))})

    grouped = rows.groupBy("label", "key", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("cls"), "*")
    kinds = {c: grouped.schema[c].dataType.simpleString() for c in ("label", "least")}
    schema = f"cls long, label {kinds['label']}, key binary, vec binary, least {kinds['least']}, n long, d int, code binary, factor double, cells array<long>"
    codes = materialize(grouped.select("cls", "label", "key", "vec", "least", "n").mapInArrow(code, schema), "codes")
    dealt = codes.select("cls", "label", "vec", "n", "d", "code", "factor", F.posexplode("cells").alias("rank", "cell")).withColumn("guest", F.col("rank") > 0)
    number = lambda guest: F.ceil(F.count_if(F.col("guest") == guest) / BLOCK).cast("int")
    blocks = dealt.groupBy("label", "d", "cell").agg(number(False).alias("homes"), number(True).alias("guests"))
    name = F.xxhash64("cls")
    mine = F.when(F.col("guest"), F.col("homes") + F.pmod(name, F.greatest("guests", F.lit(1)))).otherwise(F.pmod(name, F.greatest("homes", F.lit(1)))).cast("int")
    placed = dealt.join(blocks, ["label", "d", "cell"]).where("homes > 0").withColumn("block", mine)
    partners = F.when(F.col("guest"), F.col("homes")).otherwise(F.col("homes") + F.col("guests"))  # guests meet members only
    other = F.explode(F.sequence(F.lit(0), partners - 1)).alias("other")
    meant = placed.select("*", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        same = key[3] == key[4]
        a, b = (g, g) if same else (g[g["block"] == key[3]], g[g["block"] == key[4]])
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "linked": []}).astype("int64")
        la, lb, i, j = compare_blocks(a, b, same, threshold, kind, int(key[1]))
        names = a["cls"].to_numpy() if same else np.concatenate([a["cls"].to_numpy(), b["cls"].to_numpy()])
        linked = np.concatenate([la, lb])
        some = np.flatnonzero(linked)
        return pd.DataFrame({"a": np.concatenate([names[some], names[i]]), "b": np.concatenate([np.full(len(some), -1), names[j]]), "linked": np.concatenate([linked[some], np.zeros(len(i), np.int64)])})

    found = materialize(meant.groupBy("label", "d", "cell", "low", "high").applyInPandas(compare, "a long, b long, linked long"), "vector-links")
    weights = found.where("b = -1").groupBy(F.col("a").alias("cls")).agg(F.sum("linked").alias("linked"))
    return codes.select("cls", "label", "key", "least", "n"), weights, found.where("b >= 0").select("a", "b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """For each row: its id, the number of other rows that it links to, the smallest id that links lead to, and whether that is its own.

    Rows link when their labels are equal and not null, their vectors equally long, and the cosine in double precision
    is at least the threshold.  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are their own component, as do rows without a label.  Equal vectors, known by a digest of 128 bits, are one
    class, whatever its size.
    Rows with equal ids are rows of their own; null ids are never the smallest of a component with other ids.  Other
    columns are ignored.  An empty table gives no rows.
    """
    rows, kind = read_vectors(vectors, id_col, vector_col, label_col)
    good = rows.where("key is not null")
    classes, weights, links = link_vectors(good, kind, threshold)
    of = classes.join(weights, "cls", "left").join(components(links), F.col("cls") == F.col("node"), "left")
    of = of.select("label", "key", "least", F.col("n").alias("copies"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    of = materialize(of, "vector-components")
    heads = of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_spread(of, heads, ["component"], of.count()).select("label", "key", "n_links", "component_id", F.col("copies").alias("n"))
    linked = join_spread(good.select("id", "label", "key"), materialize(named, "named-vectors"), ["label", "key"], good.count()).select("id", "n_links", "component_id")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: near-duplicates among all vectors of equal labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON m.n = v.vec_id
"""
