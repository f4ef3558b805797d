"""Document fingerprints by locally consistent parsing.

The bytes of a text are parsed into phrases, the phrases into phrases of phrases, level by level. A level
first names runs of one symbol by symbol and length; then neighbours differ, and deterministic coin tossing relabels each symbol by
the lowest bit in which it differs from its left neighbour, until six labels are left. A phrase begins at
each local maximum of the labels. Its name is a hash of its symbols. Labels depend on a few neighbours
only, so equal substrings get equal phrases inside, wherever they stand; an edit changes a bounded number of phrases per level.

The fingerprint sketches the set of phrase names of LEVELS by one hash (SLOTS slots with the least hash
of each, 16 bits kept); empty slots take the value of the next filled one. Likeness is the share of equal slots and estimates the
Jaccard similarity of the sets. Equal texts have equal fingerprints.

Null texts count as empty; the empty text's fingerprint is all zeros, like itself and nothing else. Order of
documents: descending id, null ids last, equal ids by a hash of the text, descending, so that an id of very many rows spreads over stretches; after the last comes the first (a single document is its own next).
Repeated rows each have their place. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, slices, table

#: Levels whose phrases are sketched; a phrase of level k has about 3**k bytes.
LEVELS = (2, 3, 4)
SLOTS = 64
#: Documents in a stretch of the order, which is one task's unit; most stretches (then they get longer).
STRETCH = 2048
MOST_STRETCHES = 20_000
#: Bytes of text parsed at once.
BLOCK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of multiply and shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def toss(values: np.ndarray) -> np.ndarray:
    """A table: the label of each pair (left, own) of small values that differ."""
    left, own = values[:, None], values[None, :]
    low = np.bitwise_count(((left ^ own) & -(left ^ own)) - 1)
    return (2 * low + ((own >> low) & 1)).astype(np.uint8)


#: Labels after the first tossing of 64-bit names are below 128, then below 14, then below 8, then below 6.
TABLES = [toss(np.arange(128)), toss(np.arange(16)), toss(np.arange(8))]


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six labels; first: where texts begin. Before a text stands a name that differs in the lowest bit."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = names[first] ^ np.uint64(1)
    differ = left ^ names
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    got = (2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for step in TABLES:
        left = np.empty_like(got)
        left[1:] = got[:-1]
        left[first] = got[first] ^ 1
        got = step.ravel().take(left.astype(np.uint16) * len(step) + got)
    return got


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def level(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level and their number in each text."""
    filled = sizes > 0
    first = starts_of(sizes)[filled]
    # Runs of one symbol.
    begins = np.empty(len(names), bool)
    begins[0] = True
    np.not_equal(names[1:], names[:-1], out=begins[1:])
    begins[first] = True
    at = np.flatnonzero(begins)
    length = np.diff(at, append=len(names)).astype(np.uint64)
    runs = names[at]
    many = length > 1
    runs[many] = mix(runs[many] + mix(length[many]))
    first = np.searchsorted(at, first)
    # Phrases: from each local maximum to before the next.
    got = labels(runs, first)
    cut = np.zeros(len(runs), bool)
    cut[1:-1] = (got[1:-1] > got[:-2]) & (got[1:-1] > got[2:])
    last = np.append(first[1:], len(runs)) - 1
    cut[last] = False
    cut[first] = True
    begin = np.flatnonzero(cut)
    rank = np.arange(len(runs)) - np.repeat(begin, np.diff(begin, append=len(runs)))
    phrases = mix(np.add.reduceat(mix(runs + mix(rank.astype(np.uint64) + np.uint64(1))), begin))
    out = np.zeros(len(sizes), np.int64)
    out[filled] = np.diff(np.searchsorted(begin, first), append=len(begin))
    return phrases, out


def sketch(raw: list[bytes]) -> np.ndarray:
    """The fingerprints of texts: SLOTS 16-bit values each."""
    sizes = np.array([len(r) for r in raw], np.int64)
    least = np.full((len(raw), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    if sizes.sum():
        names = mix(np.arange(1, 257, dtype=np.uint64))[np.frombuffer(b"".join(raw), np.uint8)]
        for k in range(1, max(LEVELS) + 1):
            names, sizes = level(names, sizes)
            if k in LEVELS:
                h = mix(names ^ np.uint64(k))
                slot = np.repeat(np.arange(len(raw)) * SLOTS, sizes) + (h >> np.uint64(58)).astype(np.int64) % SLOTS
                np.minimum.at(least.ravel(), slot, h & np.uint64((1 << 58) - 1))
    empty = least == np.iinfo(np.uint64).max
    out = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    for i in np.flatnonzero(empty.any(axis=1)).tolist():
        own = np.flatnonzero(~empty[i])
        if len(own):
            # The next filled slot's value, changed by the way to it.
            to = own[np.searchsorted(own, np.arange(SLOTS)) % len(own)]
            way = ((to - np.arange(SLOTS)) % SLOTS).astype(np.uint64)
            out[i] = np.where(empty[i], (mix(least[i][to] + way) & np.uint64(0xFFFF)).astype(np.uint16), out[i])
        else:
            out[i] = 0
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    raw, out, start, held = [t.encode("utf-8", "replace") for t in texts], [], 0, 0
    for i, r in enumerate(raw):
        if i > start and held + len(r) > BLOCK_BYTES:
            out.append(sketch(raw[start:i]))
            start, held = i, 0
        held += len(r)
    return np.concatenate([*out, sketch(raw[start:])]) if raw else np.empty((0, SLOTS), np.uint16)


def shown(prints: np.ndarray) -> list[str]:
    return [p.astype(">u2").tobytes().hex() for p in prints]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fingerprint (string of 4 hex digits for each slot)."""

    def step(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(shown(fingerprints([t or "" for t in texts.to_pylist()])), pa.string())]

    return map_texts(df, text, [T.StructField("fingerprint", T.StringType())], step)


#: What documents are ordered by, all descending: whether there is an id, the id, a hash of the text.
KEY = ("named", "number", "h")


def in_order(df: DataFrame) -> DataFrame:
    """df (id, text) in stretches of the order, each a sorted run of rows of one partition: (stretch, id, text, role).

    Role 0 is a row's own place; a row of role 1 is the first row of the next stretch (or of all), which the last
    row here needs. Whole texts are shuffled once. The driver gets a sample of 64 keys for each stretch and one key of each.
    """
    n = df.count()
    stretches = max(1, min(MOST_STRETCHES, -(-n // STRETCH)))
    keyed = df.withColumn("named", F.col("id").isNotNull().cast("long")).withColumn("number", F.coalesce("id", F.lit(0).cast("long"))).withColumn("h", F.xxhash64("text"))
    drawn = keyed.select(*KEY).where(F.rand(7) < min(1.0, 64 * stretches / max(1, n))).limit(128 * stretches).collect() if stretches > 1 else []
    sample = sorted((tuple(r) for r in drawn), reverse=True)
    bounds = sorted({sample[i * len(sample) // stretches] for i in range(1, stretches)}, reverse=True) if sample else []
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    def at_or_after(i: Column) -> Column:
        """Whether a row stands at the bound or after it."""
        named, number, h = (F.get(literal([b[k] for b in bounds]), i) for k in range(3))
        same = (named == F.col("named")) & ((number > F.col("number")) | ((number == F.col("number")) & (h >= F.col("h"))))
        return (named > F.col("named")) | same

    if bounds:
        # Bisection: how many bounds a row stands at or after.
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
        own = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & at_or_after(at + s - 1), at + s).otherwise(at))
    else:
        own = F.lit(0)
    placed = keyed.withColumn("stretch", own.cast("int"))
    heads = sorted((r["stretch"], tuple(r["top"])) for r in placed.groupBy("stretch").agg(F.max(F.struct(*KEY)).alias("top")).collect())
    count = len(bounds) + 1
    tops, to = [(-1, 0, 0)] * count, [0] * count
    for i, (s, top) in enumerate(heads):
        tops[s], to[s] = top, heads[i - 1][0]
    is_head = F.lit(True)
    for k, name in enumerate(KEY):
        is_head = is_head & (F.get(literal([t[k] for t in tops]), F.col("stretch")) == F.col(name))
    before = F.get(literal(to), F.col("stretch")).cast("int")
    here = F.struct(F.col("stretch").alias("stretch"), F.lit(0).alias("role"))
    places = F.when(is_head, F.array(here, F.struct(before.alias("stretch"), F.lit(1).alias("role")))).otherwise(F.array(here))
    dealt = placed.select("id", "text", "h", F.explode(places).alias("place")).select("id", "text", "h", "place.stretch", "place.role")
    return dealt.repartitionById(count, "stretch").sortWithinPartitions("stretch", "role", F.col("id").desc_nulls_last(), F.col("h").desc(), "text").drop("h")


def edited_fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last third replaced by the start of the next document), and likenesses."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of what came so far, whose next one is still to come: stretch, role, id, text, fingerprint.
        last: list | None = None
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                own = fingerprints(texts)
                come = list(zip(part.column("stretch").to_pylist(), part.column("role").to_pylist(), part.column("id").to_pylist(), texts, own, strict=True))
                rows = [last, *come] if last else come
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == 0 and a[0] == b[0]]
                last = come[-1]
                if pairs:
                    yield made(pairs)

    def made(pairs: list) -> pa.RecordBatch:
        mine = [a[3] for a, _ in pairs]
        edited = [t[: len(t) - len(t) // 3] + b[3][: len(t) // 3] for t, (_, b) in zip(mine, pairs, strict=True)]
        own, after, new = np.array([a[4] for a, _ in pairs]), np.array([b[4] for _, b in pairs]), fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(t) for t in mine], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
                pa.array(shown(own), pa.string()),
                pa.array(shown(new), pa.string()),
                pa.array(likeness(own, new), pa.float64()),
                pa.array(likeness(own, after), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(rows).mapInArrow(run, schema).withColumnRenamed("id", id)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
