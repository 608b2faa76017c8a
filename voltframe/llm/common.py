"""What the operators of this subpackage share: tables, words, checkpoints and components."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.functions.sessions import checkpoint_dir, cut  # noqa: F401  (for the other modules)
from voltframe.operators.components import star_components

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Size of one Arrow batch that is sent to Python, unless a single row is larger.
ARROW_BYTES = "4m"


def ascii_words(text: str | None) -> list[bytes]:
    """Words (see WORD) in UTF-8, A-Z as a-z: bytes are split at just these six characters."""
    return text.encode().lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The given columns of a table; only they are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def for_python(spark: SparkSession) -> None:
    """Arrow batches bounded by size, as whole documents are large."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at its end the worker gives back the memory that it no longer needs: workers are used again by later stages."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return both


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b), both long: (node, component), component the smallest node.

    Self loops, repeated and reversed edges are fine; nulls are dropped; no edges, no rows. See star_components().
    """
    return star_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
