"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, drop  # noqa: F401

#: The wide whitespace class of the contracts: space and U+0009 to U+000D.
SPACES = r"[ \t\n\x0b\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only what an operator needs; other columns, whatever their names, never reach it. Null texts are empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def row_key(docs: DataFrame) -> DataFrame:
    """id_and_text with a key of two longs, k_id and k_text. Rows with equal keys are repeated rows: same id, same text."""
    return id_and_text(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k_id"), F.xxhash64("text").alias("k_text"))


def id_crc_mod(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(c: Column, between: str, lower: bool) -> Column:
    """The words of c: what stands between characters of `between`, A-Z in lower case if asked for. translate() and a split at
    one character cost a fraction of a pattern."""
    c = F.translate(c, between + UPPER * lower, " " * len(between) + LOWER * lower)
    return F.array_remove(F.split(c, " "), "")


def batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for each Arrow batch, cut to pieces of bounded size first, so that a batch of long texts stays small."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for b in small(whole):
                if b.num_rows and (out := fn(b)) is not None:
                    yield out

    return run


def small(b: pa.RecordBatch, at_most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """b as slices of about at_most bytes; a row is never split."""
    if b.num_rows < 2 or b.nbytes <= at_most:
        yield b
        return
    half = b.num_rows // 2
    yield from small(b.slice(0, half), at_most)
    yield from small(b.slice(half), at_most)


ASCII_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
