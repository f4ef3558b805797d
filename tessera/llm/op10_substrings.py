"""Exact substring dedup by suffix sorting: bytes of strings of LENGTH bytes that also start earlier go.

A window is a string of LENGTH bytes. Its anchor is the K-gram in it with the least hash (the last of equal ones), so equal
windows have equal anchors at equal places. Windows next to each other mostly share one anchor occurrence, and such a run of
windows is one row: anchor hash, hash of the bytes that the run covers, place. Two windows can be equal only
if their runs have one anchor hash. Hashes only say what to compare with what; bytes decide.

1. Runs of all documents are sorted by anchor, hash of covered bytes and place, over ranges of that order, so that a hot anchor spreads over many
   tasks. The ranges come from a small sample of runs. Runs whose covered bytes have one hash all claim to equal the first of them.
   Claims of a document that go on in one source are one claim.
2. Where an anchor has runs of several kinds, the first of each kind is open: its bytes come from the documents and go to
   a chunk of CHUNK runs. A chunk is suffix-sorted in two stages (suffixes.py), adjacent common prefixes give its groups of equal windows, and
   all but the first of a group are repeats.
3. Where an anchor's runs fill more than a chunk, or cross an edge of a range, windows that are first in
   their chunk meet those of other chunks by their LENGTH bytes. Nothing is capped.
4. Sources' bytes come from the documents in the same step as those of open runs, and each document checks its claims against them,
   byte by byte, before anything of it is removed. A claim that fails, which takes two equal 64-bit hashes of both anchor and bytes, stops the job; another SEED
   then settles it.

Place is document id, then start; null ids come first. Rows of a null or repeated id are known by 127 bits of hash of their
text as well, by which they are also ordered; rows of one id and one text are one document (none is a repeat of the other). Null texts
count as empty; texts under LENGTH bytes are never touched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bit_longs, fresh, in_bit_map, slices, table, twin, without
from .suffixes import keys, same_prefix, suffix_order

LENGTH = 100
K = 32
#: Windows that are worked on at once.
BLOCK = 1 << 19
#: Runs that are suffix-sorted together.
CHUNK = 4096
#: Runs that one range of the order holds, about; most ranges; runs of the sample for each range.
RANGE, MOST_RANGES, SAMPLE = 600_000, 20_000, 64
#: Bytes of text for each run, about.
RUN_BYTES = 30
SEED = 0xD1342543DE82EF95
#: What a place is made of.
PLACE = ("doc", "t1", "t2", "at")


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes; powers of an odd base and of its inverse modulo 2**64."""
    base = SEED | 1
    up, down = np.full(BLOCK + 2 * LENGTH, base, np.uint64), np.full(BLOCK + 2 * LENGTH, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64)
    return values, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    values, up, _ = powers()
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)))


def hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * powers()[2][begin]


def runs_of(data: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: bytes of texts one after another, text: the number of the text of each byte.
    For each run: the first window, the last window, anchor hash, hash of the covered bytes."""
    n, w = len(data) - LENGTH + 1, LENGTH - K + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    sums = prefix_sums(data)
    grams = mix((sums[K:] - sums[:-K]) * powers()[2][: len(data) - K + 1])
    # Low bits hold the place from behind: of equal hashes the last is least.
    low = np.uint64((1 << 20) - 1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[w - size : w - size + n])
    anchor = (low - (least & low)).astype(np.int64)
    whole = np.flatnonzero(text[:n] == text[LENGTH - 1 :])
    if not len(whole):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    own = anchor[whole]
    cut = np.concatenate(([True], (np.diff(whole) != 1) | (np.diff(own) != 0)))
    at = np.flatnonzero(cut)
    first, last = whole[at], whole[np.append(at[1:], len(whole)) - 1]
    body = mix(hashes(sums, first, last + LENGTH) ^ mix((anchor[first] - first).astype(np.uint64)))
    return first, last, grams[anchor[first]], body


def blocks(lengths: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Texts, or parts of long ones that overlap by LENGTH - 1 bytes, in groups of up to BLOCK bytes: (text, begin, end)."""
    group, held = [], 0
    for i, n in enumerate(lengths.tolist()):
        if n < LENGTH:
            continue
        for begin in range(0, n - LENGTH + 1, BLOCK // 2):
            end = min(n, begin + BLOCK // 2 + LENGTH - 1)
            if group and held + end - begin > BLOCK:
                yield group
                group, held = [], 0
            group.append((i, begin, end))
            held += end - begin
    if group:
        yield group


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of documents (doc, t1, t2, text): anchor and body hashes, the place of the first window and the number of windows more."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw = [t or b"" for t in part.column("text").to_pylist()]
            own = {k: part.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "t1", "t2")}
            for group in blocks(np.array([len(r) for r in raw], np.int64)):
                data = np.frombuffer(b"".join(raw[i][a:b] for i, a, b in group), np.uint8)
                sizes = np.array([b - a for _, a, b in group])
                text = np.repeat(np.arange(len(group)), sizes)
                first, last, h, c = runs_of(data, text)
                of = text[first]
                whose = np.array([i for i, _, _ in group])[of]
                start = first - (np.cumsum(sizes) - sizes)[of] + np.array([a for _, a, _ in group])[of]
                yield {"h": h.view(np.int64), "c": c.view(np.int64)} | {k: v[whose] for k, v in own.items()} | {"at": start.astype(np.int32), "n": (last - first).astype(np.int32)}


ORDER = ("h", "c", *PLACE)
RUN = "h long, c long, doc long, t1 long, t2 long, at int, n int"


def range_bounds(docs: DataFrame) -> list[np.ndarray]:
    """The first row of every range but the first, a column each: quantiles of a sample, which steers the size of tasks and nothing else."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    runs = size / RUN_BYTES
    ranges = int(min(MOST_RANGES, -(-runs // RANGE)))
    if ranges < 2:
        return [np.empty(0, np.int64)] * len(ORDER)
    # Runs of a share of the documents, and one of 16 of these.
    wanted = SAMPLE * ranges
    dice = F.pmod(F.xxhash64("doc", "t1", "t2"), F.lit(1 << 20))
    sample = docs.where(dice < int(min(1.0, 16 * wanted / runs) * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            take = (mix(rows["c"].view(np.uint64) + rows["at"].astype(np.uint64)) & np.uint64(15)) == 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[k][take]) for k in ORDER], names=list(ORDER))

    found = sorted(tuple(r) for r in sample.mapInArrow(run, RUN.removesuffix(", n int")).limit(4 * wanted).collect())
    picked = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    return [np.array([b[k] for b in picked], np.int64) for k in range(len(ORDER))]


def range_of(bounds: list[np.ndarray], rows: dict[str, np.ndarray]) -> np.ndarray:
    """How many bounds are at or before each row."""
    low, high = (np.searchsorted(bounds[0], rows["h"], side) for side in ("left", "right"))
    # Rows of an anchor that has bounds inside it: bisection by the other columns.
    open_ = np.flatnonzero(low < high)
    a, b = low[open_], high[open_]
    while (live := np.flatnonzero(a < b)).size:
        mid, at = (a[live] + b[live]) // 2, open_[live]
        before, same = np.zeros(len(live), bool), np.ones(len(live), bool)
        for bound, k in zip(bounds[1:], ORDER[1:], strict=True):
            before |= same & (bound[mid] < rows[k][at])
            same &= bound[mid] == rows[k][at]
        before |= same
        a[live], b[live] = np.where(before, mid + 1, a[live]), np.where(before, b[live], mid)
    low[open_] = a
    return low


def anchor_runs(docs: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """(h, c, doc, t1, t2, at, n, part): all runs, and the range of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in rows.values()), pa.array(range_of(bounds, rows).astype(np.int32))], names=[*rows, "part"])

    return docs.mapInArrow(run, f"{RUN}, part int")


SOURCE = ("sdoc", "st1", "st2", "sat")


def settle(runs: DataFrame, ranges: int, most: int = CHUNK) -> DataFrame:
    """(doc, t1, t2, at, n, chunk, split, source): claims have a source and no chunk (-1); open runs have a chunk, and split if their anchor has runs elsewhere."""
    spread = runs.repartitionById(ranges, "part").sortWithinPartitions(*ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        chunk, held, part = 0, 0, 0
        # The anchor that already had to be split, and the last kind of it that was seen, with its first run; the first anchor of a range may have runs in the one before.
        open_anchor: int | None = None
        open_body: int | None = None
        open_first: tuple[int, ...] = (0,) * len(PLACE)
        begun = False

        def out(rows: dict[str, np.ndarray], cut_off: bool) -> pa.RecordBatch:
            """cut_off: the last anchor may have more runs."""
            nonlocal chunk, held, open_anchor, open_body, open_first, begun
            h, c = rows["h"], rows["c"]
            new_h = np.concatenate(([True], h[1:] != h[:-1]))
            new_c = new_h | np.concatenate(([True], c[1:] != c[:-1]))
            if h[0] == open_anchor and c[0] == open_body:
                new_c[0] = False
            starts = np.flatnonzero(new_h)
            sizes = np.diff(starts, append=len(h))
            kinds = np.add.reduceat(new_c.astype(np.int64), starts)
            split = kinds > most
            split[0] |= not begun or h[0] == open_anchor
            split[-1] |= cut_off
            of_row = np.repeat(split, sizes)
            unsettled = np.repeat(kinds > 1, sizes) | of_row
            unsettled &= new_c
            # The first run of each row's kind; -1 where it came before these rows.
            first = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
            source = [np.where(first >= 0, rows[k][first], own) for k, own in zip(PLACE, open_first, strict=True)]
            begun, open_anchor, open_body, open_first = True, int(h[-1]), int(c[-1]), tuple(int(x[-1]) for x in source)
            numbers = np.full(len(h), -1, np.int64)
            many = np.add.reduceat(unsettled.astype(np.int64), starts)
            for i in np.flatnonzero(many).tolist():
                k = int(many[i])
                if held and held + k > most:
                    chunk, held = chunk + 1, 0
                numbers[np.flatnonzero(unsettled[starts[i] : starts[i] + sizes[i]]) + starts[i]] = chunk + np.arange(k) // most
                chunk, held = chunk + (k - 1) // most, held + k if k <= most else (k - 1) % most + 1
            take = np.flatnonzero(~new_c | unsettled)
            number = numbers[take]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(rows[k][take]) for k in (*PLACE, "n")), pa.array(np.where(number >= 0, (part << 32) + number, -1)), pa.array(of_row[take]), *(pa.array(x[take].astype(rows[k].dtype)) for k, x in zip(PLACE, source, strict=True))],
                names=[*PLACE, "n", "chunk", "split", *SOURCE],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*ORDER, "n")}
            if kept is not None:
                rows = {k: np.concatenate((kept[k], rows[k])) for k in rows}
            # Repeated rows of a document are one.
            same = np.logical_and.reduce([np.diff(rows[k]) == 0 for k in ("at", "doc", "c", "h", "t1", "t2")])
            if same.any():
                rows = {k: v[np.concatenate(([True], ~same))] for k, v in rows.items()}
            # The last anchor waits for more of its runs, unless it alone fills more than two chunks: then all but its last row go.
            cut = int(np.searchsorted(rows["h"], rows["h"][-1]))
            hot = len(rows["h"]) - cut > 2 * most
            cut = len(rows["h"]) - 1 if hot else cut
            kept = {k: v[cut:] for k, v in rows.items()}
            if cut:
                yield out({k: v[:cut] for k, v in rows.items()}, hot)
        if kept is not None:
            yield out(kept, True)

    return spread.mapInArrow(run, "doc long, t1 long, t2 long, at int, n int, chunk long, split boolean, sdoc long, st1 long, st2 long, sat int")


def joined_claims(settled: DataFrame) -> DataFrame:
    """(doc, t1, t2, at, size, source): bytes that claim to equal as many bytes from the source on."""
    runs = settled.where("chunk < 0").groupBy("doc", "t1", "t2").agg(F.collect_list(F.struct("at", "n", *SOURCE)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            col = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n", *SOURCE)}
            shift = col["at"].astype(np.int64) - col["sat"]
            order = np.lexsort((col["at"], shift, col["st2"], col["st1"], col["sdoc"], row))
            col, row, shift = {k: v[order] for k, v in col.items()}, row[order], shift[order]
            end = col["at"].astype(np.int64) + col["n"]
            goes_on = np.logical_and.reduce([np.diff(x) == 0 for x in (row, col["sdoc"], col["st1"], col["st2"], shift)]) & (col["at"][1:] <= end[:-1] + 1)
            at = np.flatnonzero(np.concatenate(([True], ~goes_on)))
            last = np.append(at[1:], len(row)) - 1
            size = (end[last] + LENGTH - col["at"][at]).astype(np.int32)
            ids = [batch.column(k).take(pa.array(row[at])) for k in ("doc", "t1", "t2")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(col["at"][at]), pa.array(size), *(pa.array(col[k][at]) for k in SOURCE)], names=["doc", "t1", "t2", "at", "size", *SOURCE])

    return runs.mapInArrow(run, "doc long, t1 long, t2 long, at int, size int, sdoc long, st1 long, st2 long, sat int")


def sort_chunk(chunk: pa.Table) -> pa.Table:
    """Repeated windows of a chunk as runs (place, n), and windows of split anchors that are first in it (place, n -1, their bytes)."""
    doc, t1, t2, at, size = (np.array(chunk.column(k)) for k in (*PLACE, "size"))
    split = np.array(chunk.column("split"))
    bodies = chunk.column("body").to_pylist()
    order = np.lexsort((at, t2, t1, doc))
    # Repeated rows of a document are one.
    order = order[np.concatenate(([True], np.logical_or.reduce([np.diff(x[order]) != 0 for x in (doc, t1, t2, at)])))]
    doc, t1, t2, at, split, bodies = doc[order], t1[order], t2[order], at[order], split[order], [bodies[i] for i in order.tolist()]
    n = size[order].astype(np.int64) - LENGTH
    sizes = n + LENGTH
    # Bytes become 1 to 256, a 0 stands after each run.
    raw = np.frombuffer(b"\0".join([*bodies, b""]), np.uint8)
    symbols = raw.astype(np.uint16) + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols[begin + sizes] = 0
    packed = keys(symbols)
    suffixes = suffix_order(symbols, packed, LENGTH)
    run = np.repeat(np.arange(len(n)), sizes + 1)
    offset = np.arange(len(symbols)) - begin[run]
    suffixes = suffixes[offset[suffixes] <= n[run[suffixes]]]
    linked = same_prefix(packed, suffixes[:-1], suffixes[1:], LENGTH)
    group = np.concatenate(([0], np.cumsum(~linked)))
    # Places rise with the position, as runs are in order.
    first = np.full(group[-1] + 1, len(symbols), np.int64)
    np.minimum.at(first, group, suffixes)
    again = np.sort(suffixes[suffixes != first[group]])
    cut = np.flatnonzero(np.concatenate(([True], (np.diff(again) != 1) | (np.diff(run[again]) != 0)))) if len(again) else np.empty(0, np.int64)
    head, last = again[cut], again[np.append(cut[1:], len(again)) - 1] if len(again) else again
    once = first[split[run[first]]]
    tokens = [raw[i : i + LENGTH].tobytes() for i in once.tolist()]
    every = np.concatenate((head, once))
    return pa.table(
        {k: pa.array(x[run[every]]) for k, x in (("doc", doc), ("t1", t1), ("t2", t2))}
        | {
            "at": pa.array((at[run[every]] + offset[every]).astype(np.int32)),
            "n": pa.array(np.concatenate((last - head, np.full(len(once), -1))).astype(np.int32)),
            "window": pa.array([None] * len(head) + tokens, pa.binary()),
        }
    )


def pieces(docs: DataFrame, settled: DataFrame, claims: DataFrame) -> DataFrame:
    """(place, size, chunk, split, body): the bytes of open runs, and of sources (chunk -1) of which each is asked for once."""
    asked = claims.select(*[F.col(s).alias(k) for s, k in zip(SOURCE, PLACE, strict=True)], "size").distinct()
    asked = asked.withColumn("chunk", F.lit(-1).cast("long")).withColumn("split", F.lit(False))
    wanted = settled.where("chunk >= 0").select(*PLACE, (F.col("n") + LENGTH).alias("size"), "chunk", "split").union(asked)
    wanted = wanted.groupBy("doc", "t1", "t2").agg(F.collect_list(F.struct("at", "size", "chunk", "split")).alias("runs"))
    cut = docs.join(wanted, ["doc", "t1", "t2"]).select("doc", "t1", "t2", "text", F.explode("runs").alias("run")).select("doc", "t1", "t2", "run.*", "text")
    return cut.select(*PLACE, "size", "chunk", "split", F.substring("text", F.col("at") + 1, F.col("size")).alias("body"))


def repeats(docs: DataFrame, scratch: Scratch, most: int = CHUNK) -> DataFrame:
    """(doc, t1, t2, runs): for each document with repeated windows, arrays of (at, size, body): bytes that go, and what they must equal where that isn't settled."""
    bounds = range_bounds(docs)
    settled, _ = scratch.write(settle(anchor_runs(docs, bounds), len(bounds[0]) + 1, most))
    claims, _ = scratch.write(joined_claims(settled))
    cut, _ = scratch.write(pieces(docs, settled, claims))
    kinds = "doc long, t1 long, t2 long, at int, n int, window binary"
    sorted_, _ = scratch.write(cut.where("chunk >= 0").groupBy("chunk").applyInArrow(sort_chunk, kinds))
    # A window meets as many others here as there are chunks with it.
    firsts = sorted_.where("n < 0").select("window", F.struct(*PLACE).alias("place"))
    least = firsts.groupBy("window").agg(F.min("place").alias("least"), F.count("*").alias("chunks")).where("chunks > 1").drop("chunks")
    again = firsts.join(least, "window").where(F.col("place") != F.col("least")).select("place.*", F.lit(LENGTH).alias("size"))
    none = F.lit(None).cast("binary").alias("body")
    sources = cut.where("chunk < 0").select(*[F.col(k).alias(s) for k, s in zip(PLACE, SOURCE, strict=True)], "size", "body")
    found = claims.join(sources, [*SOURCE, "size"]).select(*PLACE, "size", "body")
    found = found.union(sorted_.where("n >= 0").select(*PLACE, (F.col("n") + LENGTH).alias("size"), none)).union(again.select("*", none))
    return found.groupBy("doc", "t1", "t2").agg(F.collect_list(F.struct("at", "size", "body")).alias("runs"))


def keep(text: bytes, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes and the runs of bytes that went."""
    if not runs:
        return text, 0, 0
    out, done, removed, spans = [], 0, 0, 0
    end = -1
    for at, size, body in sorted(((r["at"], r["size"], r["body"]) for r in runs), key=lambda r: r[:2]):
        if body is not None and text[at : at + size] != body:
            raise RuntimeError("different bytes have equal hashes: set another SEED of op10_substrings and run again")
        if at > end:
            out.append(text[done:at])
            spans += 1
        removed += max(0, at + size - max(end, at))
        end = done = max(end, at + size)
    out.append(text[done:])
    return b"".join(out), removed, spans


def drop_substrings(df: DataFrame, id: str = "doc_id", text: str = "text", most: int = CHUNK) -> DataFrame:
    """df with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans (long)."""
    base = without(df, "kept", "n_bytes", "n_removed", "n_spans")
    doc, t1, t2, body, runs = fresh(base, "doc", "t1", "t2", "body", "runs")
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"").cast("binary"))
    unnamed = F.col(f"`{id}`").isNull()
    number: Column = F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(-(1 << 63)))
    # Only where an id is null or may repeat does the text's hash tell documents apart.
    repeated = df.select(number.alias("doc")).groupBy("doc").count().where("count > 1").select(F.xxhash64("doc").alias("h"))
    shared = unnamed | in_bit_map(bit_longs(repeated), F.xxhash64(number))
    zero, half = F.lit(0).cast("long"), F.shiftrightunsigned(F.xxhash64(unnamed, raw), 1)
    # Below zero without an id, so that these come before the least id.
    first = F.when(unnamed, -half - 1).when(shared, half).otherwise(zero)
    placed = base.select("*", number.alias(doc), first.alias(t1), F.when(shared, twin(unnamed, raw)).otherwise(zero).alias(t2), raw.alias(body))
    key = {doc: "doc", t1: "t1", t2: "t2"}
    docs = placed.select(*[F.col(k).alias(v) for k, v in key.items()], F.col(body).alias("text"))
    found = repeats(docs, Scratch(df.sparkSession), most).select(*[F.col(v).alias(k) for k, v in key.items()], F.col("runs").alias(runs))
    joined = placed.join(found, list(key), "left").select(*[F.col(f"`{c}`") for c in base.columns], body, runs)

    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, body):
                texts = part.column(body).to_pylist()
                done = [keep(t, r) for t, r in zip(texts, part.column(runs).to_pylist(), strict=True)]
                new = [pa.array([d[0] for d in done], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], names=[*names, "kept", "n_bytes", "n_removed", "n_spans"])

    fields = [*base.schema.fields, T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))]
    return joined.mapInArrow(run, T.StructType(fields))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_substrings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB, over all windows of the documents (ids are unique there).
ORACLE_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
e as (select doc_id, encode(text) e from documents where text is not null),
w as (select doc_id, i s, md5(e[i + 1:i + 100]) k from e, unnest(range(0, greatest(octet_length(e) - 99, 0))) u(i)),
again as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) nth from w) where nth > 1),
runs as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) g from (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end fresh from again)),
spans as (select doc_id, min(s) a, max(s) + 100 b from runs group by doc_id, g),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) p from spans),
cut as (select doc_id, sum(b - a) n_removed, count(*) n_spans, max(b) rest, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) head from gaps join d using (doc_id) group by doc_id)
select doc_id, cast(length(h) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(rest, 0) + 1))) kept_sha256
from d left join cut using (doc_id)
"""
