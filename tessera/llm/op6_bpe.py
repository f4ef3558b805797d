"""Byte-level BPE encoding and decoding with a local rank file.

The rank file is read once per Python worker. Long texts are cut before encoding, only
where the pre-splitting pattern has a boundary whatever stands around: between a letter or
digit and a following space or line feed. No alternative of the pattern goes from a letter
or digit to white space, and its only look-ahead stands in runs of white space, which
are never cut. Decoding works on raw bytes, so any id sequence decodes, also one cut inside a
character.

Null texts count as empty, an empty text has no ids; repeated rows give repeated results;
an empty table gives an empty table with the same columns; columns of the input
that are named like added ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_texts, table

#: Texts of more characters than this are cut at safe boundaries.
PIECE_CHARS = 1 << 16
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")
#: Runs of white space that the library's backtracking may not be trusted with (it overflows its stack somewhere above 100,000).
LONG_SPACE = regex.compile(r"\p{White_Space}{4096,}+")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """text in parts that encode as they do together."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if not cut:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode(text: str | None, path: str, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    enc = encoding(path, pattern)
    parts, start = [], 0
    for run in LONG_SPACE.finditer(text or ""):
        # The pattern takes a run at the end whole, any other but for its last character, which stands with what follows.
        end = run.end() - (run.end() < len(text))
        parts += [enc.encode_ordinary(p) for p in pieces(text[start : run.start()])]
        parts.append(enc._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        start = end
    parts += [enc.encode_ordinary(p) for p in pieces((text or "")[start:])]
    return np.concatenate([np.array(p, dtype="<u4") for p in parts])


def decode(ids: np.ndarray, path: str, pattern: str = public_tokenizers.PATTERN) -> bytes:
    return encoding(path, pattern).decode_bytes(ids.tolist())


def bpe_encode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """df with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers)."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    return bpe_round_trip(df, path, fields, lambda ids, _: (len(ids), ids.tobytes()), pattern, text, decoded=False)


def bpe_decode(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """df with decoded (binary): the bytes of the ids column; null ids count as none."""

    def step(packed: pa.Array) -> list[pa.Array]:
        return [pa.array([decode(np.frombuffer(x or b"", dtype="<u4"), path, pattern) for x in packed.to_pylist()], pa.binary())]

    return map_texts(df, ids, [T.StructField("decoded", T.BinaryType())], step)


def bpe_round_trip(df: DataFrame, path: str, fields: list[T.StructField], made: Callable[[np.ndarray, bytes], tuple], pattern: str = public_tokenizers.PATTERN, text: str = "text", decoded: bool = True) -> DataFrame:
    """df with `fields`, which `made` derives from each text's ids and the bytes that these decode to.

    Both ways in one step: a core runs one Python worker with one rank table, and neither ids nor bytes leave it unless they are asked for.
    """

    def step(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for t in texts:
            ids = encode(t.as_py(), path, pattern)
            rows.append(made(ids, decode(ids, path, pattern) if decoded else b""))
        return [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds]

    kinds = [to_arrow_type(f.dataType) for f in fields]
    return map_texts(df, text, fields, step)


def digests(ids: np.ndarray, decoded: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def op6_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return bpe_round_trip(docs, path, fields, digests).drop("text")
