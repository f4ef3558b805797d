"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so cosine >= C is Euclidean distance <= eps = sqrt(2 - 2C). They are turned to
principal directions and sorted by label and by their grid cells of width eps on the leading ones (the epsilon grid order). Intervals of
this sequence carry a bounding box on the leading directions. Two intervals whose boxes are further than eps apart can't hold
a link and are skipped; others are halved and joined recursively, down to LEAF vectors, where
all cosines are computed in double precision. The directions come from a bounded sample; they change what can be skipped, never
a link.

Distribution: intervals of the sequence are the units, and a tree stands over them: an interval's parent is its partition, then FAN
neighbours have one parent. The recursion begins there: pairs of nodes that aren't provably distant are replaced by the pairs of their
children, level by level, so that intervals of a label never all meet each other where their boxes can tell them apart. A task gets one
pair of intervals, and of each only the vectors that aren't distant from the other's box; a label with any share of the rows is many tasks of
bounded size. Tasks pass on a degree for each vector and a spanning forest of the links, never all pairs. Equal vectors of a label meet
once, with their number as weight.

Vectors link with nothing that have a null label or id, are null, empty or zero, or hold null or non-finite
components; vectors of different lengths don't link. Such rows get n_links 0 and their own id as component. Rows of one id and
one vector count as different vectors that link; rows of one id and different vectors are one node whose links
add up. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, twin
from .components import components
from .op4_simhash import Forest

COSINE = 0.93
#: Leading directions with grid cells and boxes.
LEADING = 6
#: Vectors of the sample for principal directions.
SAMPLE = 4096
#: Vectors of an interval (a task holds two): more where there are many, so that each meets fewer others, but no more than so many bytes.
INTERVALS = (4096, 16384)
INTERVAL_BYTES = 16 << 20
#: Intervals in proportion to which intervals grow.
MANY = 256
#: Neighbours under one node of the tree over partitions.
FAN_BITS = 4
LEAF = 512


def directions(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The principal directions (columns) of a sample, for the length that most of it has."""
    rows = classes.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()
    sizes = [len(r["vector"]) for r in rows]
    if not sizes:
        return 0, np.empty((0, 0))
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = np.array([r["vector"] for r in rows if len(r["vector"]) == size], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return size, np.linalg.eigh(np.cov(x.T).reshape(size, size))[1][:, ::-1] if len(x) > 1 else np.eye(size)


def unit(vectors: pa.Array) -> np.ndarray:
    x = np.array(vectors.to_pylist(), float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Join:
    """All links of at least `cosine` between two intervals (or within one)."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, lead: np.ndarray, cosine: float):
        self.x, self.weight, self.lead, self.cosine = x, weight, lead, cosine
        self.reach = 2 - 2 * cosine + 1e-9
        self.degree, self.forest, self.edges = np.zeros(len(x), np.int64), Forest(len(x)), []
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.lead[a:b].min(axis=0), self.lead[a:b].max(axis=0)
        return self.boxes[a, b]

    def distant(self, a: int, b: int, c: int, d: int) -> bool:
        (low, high), (low2, high2) = self.box(a, b), self.box(c, d)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        return float((gap * gap).sum()) > self.reach

    def between(self, a: int, b: int, c: int, d: int) -> None:
        if a == b or c == d or ((a, b) != (c, d) and self.distant(a, b, c, d)):
            return
        if b - a <= LEAF and d - c <= LEAF:
            near = self.x[a:b] @ self.x[c:d].T >= self.cosine
            if (a, b) == (c, d):
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                np.add.at(self.degree, i + a, self.weight[j + c])
                np.add.at(self.degree, j + c, self.weight[i + a])
                self.edges += self.forest.add(i + a, j + c)
        elif (a, b) == (c, d):
            m = (a + b) // 2
            self.between(a, m, a, m)
            self.between(a, m, m, b)
            self.between(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.between(a, m, c, d)
            self.between(m, b, c, d)
        else:
            m = (c + d) // 2
            self.between(a, b, c, m)
            self.between(a, b, m, d)


def cell_width(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


def ordered(classes: DataFrame, cosine: float, most: int | None = None) -> DataFrame:
    """classes in epsilon grid order with their interval (name: partition, then number in it) and leading coordinates."""
    size, turn = directions(classes)
    width = cell_width(cosine)
    count = classes.count()
    interval = most or min(INTERVALS[1], max(INTERVALS[0], count // MANY), max(256, INTERVAL_BYTES // (8 * max(1, size))))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("vector").to_pylist()])
            lead = np.zeros((batch.num_rows, LEADING))
            for n in set(lengths.tolist()):
                rows = np.flatnonzero(lengths == n)
                x = unit(batch.column("vector").take(pa.array(rows)))
                y = (x @ turn if n == size else x)[:, :LEADING]
                lead[rows, : y.shape[1]] = y
            cells = np.floor(lead / width).astype(np.int64)
            new = [pa.array(lead.tolist(), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lead", "cells"])

    placed = classes.mapInArrow(project, "label int, vector array<double>, id long, weight long, lead array<double>, cells array<long>")
    placed = placed.withColumn("n", F.size("vector"))
    order = ["label", "n", "cells", "id"]
    number = max(1, -(-count // (4 * interval)))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, part = None, 0, 0
        for batch in batches:
            names = []
            for own in zip(batch.column("place").to_pylist(), batch.column("label").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if own != key or at == interval:
                    key, at, part = own, 0, part + 1
                at += 1
                names.append(own[0] << 32 | part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, "interval"])

    spread = placed.repartitionByRange(number, *order).sortWithinPartitions(*order).select("label", "n", "id", "weight", "vector", "lead", F.spark_partition_id().alias("place"))
    return spread.mapInArrow(name, "label int, n int, id long, weight long, vector array<double>, lead array<double>, place int, interval long")


AXES = range(LEADING)


def box_of(low: list[Column], high: list[Column]) -> list[Column]:
    return [F.struct(*[x.alias(f"x{k}") for k, x in enumerate(side)]).alias(name) for name, side in (("low", low), ("high", high))]


def apart(low: str, high: str, low2: str, high2: str) -> Column:
    """The squared distance of two boxes (a point is a box)."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{low}.x{k}") - F.col(f"{high2}.x{k}"), F.col(f"{low2}.x{k}") - F.col(f"{high}.x{k}"))
    return sum((gap(k) * gap(k) for k in AXES), F.lit(0.0))


def interval_pairs(rows: DataFrame, reach: float, scratch: Scratch) -> DataFrame:
    """(label, n, a, b, low, high, low2, high2): pairs a <= b of intervals that aren't provably distant, with their boxes. No vector moves for it."""
    lead = [F.get("lead", k) for k in AXES]
    boxes = rows.groupBy("label", "n", F.col("interval").alias("node")).agg(*box_of([F.min(x) for x in lead], [F.max(x) for x in lead]))
    boxes, _ = scratch.write(boxes)
    top = boxes.agg(F.max("node")).first()[0]
    # The tree, from the intervals up to where all partitions have one node.
    levels = [boxes.withColumn("parent", F.shiftright("node", 32))]
    above = 0 if top is None else top >> 32
    while True:
        ends = [[f(F.col(f"{side}.x{k}")) for k in AXES] for f, side in ((F.min, "low"), (F.max, "high"))]
        over = levels[-1].groupBy("label", "n", F.col("parent").alias("node")).agg(*box_of(*ends))
        levels.append(over.withColumn("parent", F.shiftright("node", FAN_BITS)))
        if not above:
            break
        above >>= FAN_BITS
    pairs = levels[-1].select("label", "n", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        left = level.select("label", "n", F.col("parent").alias("a"), F.col("node").alias("a2"), "low", "high")
        right = level.select("label", "n", F.col("parent").alias("b"), F.col("node").alias("b2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        both = pairs.select("label", "n", "a", "b").join(left, ["label", "n", "a"]).join(right, ["label", "n", "b"])
        near = both.where((F.col("a2") <= F.col("b2")) & (apart("low", "high", "low2", "high2") <= reach))
        pairs = near.select("label", "n", F.col("a2").alias("a"), F.col("b2").alias("b"), "low", "high", "low2", "high2")
    written, _ = scratch.write(pairs)
    return written


def linked(classes: DataFrame, cosine: float, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(id, other, degree): rows with other are links of spanning forests, rows without add to a vector's degree."""
    rows, _ = scratch.write(ordered(classes, cosine, most))
    reach, width = 2 - 2 * cosine + 1e-9, cell_width(cosine)
    pairs = interval_pairs(rows, reach, scratch).withColumn("pair", F.concat_ws(":", "a", "b"))
    # Sides: 0 and 1, or 2 for an interval with itself.
    itself = F.col("a") == F.col("b")
    sides = pairs.select(F.col("a").alias("interval"), "pair", F.when(itself, 2).otherwise(0).alias("side"), "low2", "high2")
    sides = sides.union(pairs.where(~itself).select("b", "pair", F.lit(1), "low", "high"))

    def join(part: pa.Table) -> pa.Table:
        side, lead = np.array(part.column("side")), np.array(part.column("lead").to_pylist(), float)
        # Back in epsilon grid order, in which halves of an interval have small boxes.
        part_order = np.lexsort((np.array(part.column("id")), *np.floor(lead / width).T[::-1], side))
        part, side, lead = part.take(pa.array(part_order)), side[part_order], lead[part_order]
        ids = np.array(part.column("id"))
        work = Join(unit(part.column("vector")), np.array(part.column("weight")), lead, cosine)
        if side[0] == 2:
            work.between(0, len(ids), 0, len(ids))
        else:
            first = int((side == 0).sum())
            work.between(0, first, first, len(ids))
        edges = np.array(work.edges, np.int64).reshape(-1, 2)
        has = np.flatnonzero(work.degree)
        return pa.table(
            {
                "id": pa.array(np.concatenate((ids[edges[:, 0]], ids[has])), pa.int64()),
                "other": pa.concat_arrays([pa.array(ids[edges[:, 1]], pa.int64()), pa.nulls(len(has), pa.int64())]),
                "degree": pa.array(np.concatenate((np.zeros(len(edges), np.int64), work.degree[has])), pa.int64()),
            }
        )

    work = rows.select("interval", "id", "weight", "vector", "lead").join(sides, "interval")
    point = F.struct(*[F.get("lead", k).alias(f"x{k}") for k in AXES])
    work = work.withColumn("point", point).where((F.col("side") == 2) | (apart("point", "point", "low2", "high2") <= reach))
    work = work.select("pair", "side", "id", "weight", "vector", "lead")
    return work.groupBy("pair").applyInArrow(join, "id long, other long, degree long")


def near_vectors(df: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of df."""
    scratch = Scratch(df.sparkSession)
    raw = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    classes, _ = scratch.write(raw.where(good).groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    found, _ = scratch.write(linked(classes, cosine, scratch))
    degrees = found.where("other IS NULL").groupBy("id").agg(F.sum("degree").alias("degree"))
    roots = components(found.where("other IS NOT NULL").select("id", "other"))
    of = classes.join(degrees, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    of = of.groupBy("id").agg(F.sum(F.col("weight") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.min("root").alias("root"))
    # Rows find their class by label and vector; of the vector two hashes are shuffled, the second of another seed (128 bits).
    keys = [F.xxhash64("vector").alias("key"), twin("vector").alias("key2"), F.col("label")]
    named = raw.select("id", *[F.when(good, k).alias(n) for k, n in zip(keys, ("key", "key2", "label"), strict=True)])
    heads = classes.groupBy(*keys).agg(F.min("id").alias("head"))
    out = named.join(heads, ["key", "key2", "label"], "left").join(of.withColumnRenamed("id", "head"), "head", "left")
    component = F.coalesce("root", "head", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with recursive v as (select vec_id, label, len(embedding) n, cast(embedding as double[]) e from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.n = b.n and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, coalesce((select count(*) from links where a = e.vec_id), 0) n_links, coalesce((select min(b) from reach where a = e.vec_id), e.vec_id) component_id,
  coalesce((select min(b) from reach where a = e.vec_id), e.vec_id) = e.vec_id kept
from embeddings e
"""
