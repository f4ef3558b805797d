"""Scalar text functions: the tokenizer's pattern for Spark and for the driver, white space, presentation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The scripts whose characters are tokens of their own.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
ALPHA = r"\p{IsAlphabetic}"
PLAIN = rf"[{ALPHA}\p{{N}}&&[^{CJK}]]"
#: A token: one character of CJK, or letters and digits joined by apostrophes between letters and by points and commas between digits.
#: Possessive throughout, so that tokens of any length match without recursion.
WORD = rf"[{CJK}&&[{ALPHA}\p{{N}}]]|{PLAIN}++(?:(?:(?<={ALPHA})['\u2019](?={ALPHA})|(?<=[0-9])[.,](?=[0-9])){PLAIN}++)*+"
SPACE_ENDS = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"
#: Distance between the last position of a title and the first of a body, less one.
FIELD_GAP = 100


@lru_cache(maxsize=1)
def driver_word() -> regex.Pattern:
    def java_to_python(pattern: str) -> str:
        return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern)

    cjk = java_to_python(CJK)
    alpha = r"\p{Alphabetic}"
    plain = rf"[[{alpha}\p{{N}}]--[{cjk}]]"
    return regex.compile(rf"[[{cjk}]&&[{alpha}\p{{N}}]]|{plain}++(?:(?:(?<={alpha})['\u2019](?={alpha})|(?<=[0-9])[.,](?=[0-9])){plain}++)*+", regex.V1)


@dataclass(frozen=True)
class Token:
    """A piece of a text: its own spelling, byte offset and ordinal."""

    text: str
    offset: int
    position: int

    @property
    def end(self) -> int:
        return self.offset + len(self.text.encode())

    @property
    def normalized(self) -> str:
        return self.text.lower()


def tokenize(text: str):  # noqa: ANN201
    """The tokens of a text, one by one, as the corpus is split."""
    seen = at = 0
    for position, m in enumerate(driver_word().finditer(text)):
        at += len(text[seen : m.start()].encode())
        seen = m.start()
        yield Token(m[0], at, position)


def words(text: Column) -> Column:
    """The tokens of a column, as they are spelled."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def running_sums(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the running sums of a column of integer arrays, one pass over each array (Arrow; nothing is shuffled)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            sums = np.concatenate(([0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))))
            own = sums[1:] - np.repeat(sums[ends[:-1]], sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int64()))], names=schema.names)

    return df.mapInArrow(run, schema)


def token_table(df: DataFrame, text: str = "text") -> DataFrame:
    """df with term, raw, position and byte offset of each token of a column. Linear in the text, nothing is shuffled."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = df.withColumn("__raw", words(body)).withColumn("__gap", F.split(body, WORD, -1))
    # A token ends after the bytes of all gaps and tokens up to its own.
    steps = F.zip_with("__raw", F.slice("__gap", F.lit(1), F.size("__raw")), lambda raw, gap: F.octet_length(gap) + F.octet_length(raw))
    ended = running_sums(tokens.select(*df.columns, "__raw", steps.alias("__step")), "__step", "__end")
    exploded = ended.select(*df.columns, F.posexplode(F.arrays_zip("__raw", "__end")).alias("position", "__token"))
    raw = F.col("__token.__raw")
    return exploded.select(*df.columns, F.lower(raw).alias("term"), raw.alias("raw"), "position", (F.col("__token.__end") - F.octet_length(raw)).cast("int").alias("offset"))


def trim_space(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, SPACE_ENDS, "")


def normalize_whitespace(text: Column) -> Column:
    """Ends trimmed of Unicode white space; inside, runs of ASCII white space (without vertical tab) become one space."""
    return F.regexp_replace(trim_space(text), "[ \t\n\f\r]+", " ")


def truncate(text: Column, most: int) -> Column:
    """At most so many characters; an ellipsis is the last where something is cut off."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("\u2026")))


def truncate_text(text: str, most: int) -> str:
    return text if len(text) <= most else text[: most - 1] + "\u2026"


def format_bytes(n: float) -> str:
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    k = 0
    while n >= 1024 and k + 1 < len(units):
        n, k = n / 1024, k + 1
    return f"{n:.0f} B" if k == 0 else f"{n:.1f} {units[k]}"


def format_count(x: float) -> str:
    return f"{round(x):,}"


def format_duration(seconds: float) -> str:
    if seconds >= 1:
        return f"{seconds:.2f} s"
    if seconds >= 0.01:
        return f"{seconds * 1e3:.0f} ms"
    if seconds >= 0.001:
        return f"{seconds * 1e3:.2f} ms"
    return f"{seconds * 1e6:.0f} µs" if seconds >= 1e-6 else f"{seconds * 1e9:.0f} ns"


def rate(amount: float, seconds: float) -> float:
    return amount / seconds if seconds else 0.0


def percentage(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(whole, F.lit(1)), 4)
