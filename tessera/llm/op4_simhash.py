"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits fall into 32 segments of two. The embedding counts the ones of each segment;
the Manhattan distance of two embeddings never exceeds the Hamming distance of their fingerprints.
In unary code (0 -> 00, 1 -> 01, 2 -> 11) the embedding is again 64 bits, and Manhattan distance is
the number of differing bits of two codes.

Grid range join: the segments are dealt into G groups. Within distance d at least G - d groups have
distance 0, so two fingerprints in range share a grid cell for some choice of G - d groups: the
cell is the embedding on these groups. The fingerprints of a cell are compared by Manhattan
distance, then exactly. G grows with the number of different fingerprints so that cells stay small; every
G is exact. Cells of more than BLOCK fingerprints are cut into chunks, and each pair of
chunks is a cell of its own, so no task holds a whole hot cell. Of the pairs found in a cell only a
spanning forest is passed on.

Texts of null count as empty. A text without words has fingerprint 0 and links like any other.
Equal fingerprints meet once, whatever the number of their rows. Ids may repeat or be null: links are between
fingerprints, so a row with a null id links like any other; component_id is null if only such rows are in a component.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_texts, table, twin
from .components import components

WORDS = 4
DISTANCE = 4
SEED = 42
SEGMENTS = 32
#: Fingerprints that one task compares with each other at most (twice as many where chunks meet).
BLOCK = 2048
#: Cells hold this many unrelated fingerprints at most, on average; below that no further group is added.
CELL = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = 0x5555555555555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as a signed 64-bit integer: each bit is the majority over its word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def simhash(df: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """df with simhash (long, the fingerprint's 64 bits)."""

    def step(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t, words) for t in texts.to_pylist()], pa.int64())]

    return map_texts(df, text, [T.StructField("simhash", T.LongType())], step)


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def unary(bits: Column) -> Column:
    """The embedding: the ones in each segment of two bits, in unary code."""
    low, high = bits.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def cells(groups: int, distance: int) -> list[int]:
    """Bit masks of every choice of groups - distance groups of segments."""
    own = [sum(3 << (2 * s) for s in range(SEGMENTS) if s % groups == g) for g in range(groups)]
    return [signed(sum(c)) for c in combinations(own, groups - distance)]


def groups_for(count: int, distance: int) -> int:
    """The least G whose cells hold CELL unrelated fingerprints or fewer; two random segments have equal counts with 3/8."""
    for g in range(distance + 2, SEGMENTS):
        if count * (3 / 8) ** (SEGMENTS * (g - distance) / g) <= CELL or comb(g + 1, distance) > 500:
            return g
    return SEGMENTS


class Forest:
    """Merges rows of one block; rows already merged are told apart by whole arrays."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def add(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """The pairs among these that join two trees."""
        new = self.up[left] != self.up[right]
        out = []
        for i, j in zip(left[new].tolist(), right[new].tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((i, j))
        if out:
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]
        return out


def links_in(key: np.ndarray, bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Rows of equal key are neighbours in the arrays. Pairs of them in range, a spanning forest of each key's."""
    low, high = bits & np.uint64(ODD), (bits >> np.uint64(1)) & np.uint64(ODD)
    code = low | high | ((low & high) << np.uint64(1))
    forest, out = Forest(len(key)), []
    left = np.arange(len(key))
    for step in range(1, len(key)):
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        near = left[np.bitwise_count(code[left] ^ code[left + step]) <= distance]
        near = near[np.bitwise_count(bits[near] ^ bits[near + step]) <= distance]
        if len(near):
            out += forest.add(near, near + step)
    return out


def near_links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes of prints (node long, bits long; each bits once) that keep all components.

    One row for each fingerprint and cell is shuffled; rows of hot cells once for each other chunk.
    """
    masks = cells(groups_for(prints.count(), distance), distance)
    dealt = prints.withColumn("code", unary(F.col("bits"))).select(
        "node", "bits", F.posexplode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("code").bitwiseAND(m))).alias("choice", "cell")
    )
    hot = dealt.groupBy("choice", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block).select("choice", "cell", F.ceil(F.col("n") / block).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != chunk), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
    )
    blocks = dealt.join(hot, ["choice", "cell"], "left").select("node", "bits", "choice", "cell", F.explode(meets).alias("meet"))
    blocks = blocks.select("node", "bits", F.xxhash64("choice", "cell", "meet").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.array(links_in(rows[2], rows[1].view(np.uint64), distance), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[0][pairs[:, 0]]), pa.array(rows[0][pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, batch.columns, strict=True)]
            cut = int(np.searchsorted(rows[2], rows[2][-1])) if len(rows[2]) else 0
            rest = [r[cut:] for r in rows]
            if cut:
                yield found([r[:cut] for r in rows])
        if len(rest[2]):
            yield found(rest)

    return blocks.where("node IS NOT NULL").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def groups_of(prints: DataFrame, best: str, distance: int, scratch: Scratch) -> DataFrame:
    """prints (bits, best) with the least best of all fingerprints that links reach from each: (bits, best, least). Written, so that joins with it can be split."""
    roots = components(near_links(prints.select(F.col("bits").alias("node"), "bits"), distance))
    linked, _ = scratch.write(prints.join(roots, F.col("bits") == F.col("node")).select("bits", "root", best))
    least = linked.groupBy("root").agg(F.min(best).alias("least"))
    of = linked.join(least, "root").select(F.col("bits").alias("own"), "least")
    joined = prints.join(of, F.col("bits") == F.col("own"), "left")
    written, _ = scratch.write(joined.select("bits", best, F.when(F.col("own").isNull(), F.col(best)).otherwise(F.col("least")).alias("least")))
    return written


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """(id, simhash, component_id) for each row of df; component_id is the smallest id reachable over links of `distance` bits or fewer."""
    scratch = Scratch(df.sparkSession)
    rows, _ = scratch.write(simhash(df.select(F.col(id).alias("doc"), F.col(text).alias("text")), "text", words).drop("text"))
    prints, _ = scratch.write(rows.groupBy(F.col("simhash").alias("bits")).agg(F.min("doc").alias("first")))
    of = groups_of(prints, "first", distance, scratch)
    return rows.join(of, F.col("simhash") == F.col("bits")).select(F.col("doc").alias(id), "simhash", F.col("least").alias("component_id"))


def drop_near_copies(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns as they are: that of the smallest id, null ids last, among equal ids by a hash of the text.

    Rows of equal id and text are one, of which one stays. Rows are known by 128 bits of hash of both, so null and repeated ids lose nothing.
    """
    scratch = Scratch(df.sparkSession)
    key, key2 = fresh(df, "key", "key2")
    whole = [F.col(f"`{id}`").isNull(), F.col(f"`{id}`"), F.col(f"`{text}`").isNull(), F.col(f"`{text}`")]
    keyed = df.withColumn(key, F.xxhash64(*whole)).withColumn(key2, twin(*whole))
    rows = simhash(keyed.select(F.col(f"`{id}`").alias("doc"), F.col(f"`{text}`").alias("text"), F.col(key).alias("key"), F.col(key2).alias("key2")), "text")
    best = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "key", "key2")
    prints, _ = scratch.write(rows.groupBy(F.col("simhash").alias("bits")).agg(F.min(best).alias("best")))
    stay = groups_of(prints, "best", DISTANCE, scratch).where(F.col("best") == F.col("least")).select(F.col("best.key").alias(key), F.col("best.key2").alias(key2))
    return keyed.dropDuplicates([key, key2]).join(stay, [key, key2], "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
