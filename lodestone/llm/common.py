"""Helpers shared by the training-data operators: scratch tables, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.session import shared_folder

#: Bytes of text that one Python step holds in decoded form at a time.
SLICE_BYTES = 4 << 20

#: Words of the text operators: runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z only.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


scratch = shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs the reader nothing, and
    values such as row numbers that were assigned before the write can't change.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes on disk of a table that :func:`stored` wrote (the files' own sizes, no job)."""
    total = 0
    for name in df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
        total += fs.getFileStatus(path).getLen()
    return total


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` wrote and nothing reads any more (an iteration's former state)."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A table up to this size on disk is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its files are small."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if size_of(df) <= limit else df


def fresh(columns: list[str], name: str) -> str:
    """A name for an inner column that none of ``columns`` has, however it is written."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_text(docs: DataFrame, text_col: str, keep: list[str] | None, results: tuple[str, ...]) -> tuple[DataFrame, str]:
    """Rows for a Python step and the name of their text column: the columns to keep, and the text once only.

    Columns named like a result give way.  Where the text itself isn't kept it is called __text."""
    from pyspark.sql import functions as F

    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    own = [F.col(f"`{c}`") for c in names]
    if text_col in names and docs.schema[text_col].dataType.simpleString() == "string":
        return docs.select(*own), text_col
    return docs.select(*own, F.col(f"`{text_col}`").cast("string").alias("__text")), "__text"


def release() -> None:
    """Give memory that a step no longer uses back to the system; workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each slice (one longer row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = binary_lengths(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def binary_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def tokens(texts: pa.Array, gap: str = WORD_GAP) -> tuple[pa.Array, np.ndarray]:
    """Words of each text after lower-casing A-Z, flattened, and the number of words of each text (null: none)."""
    import pyarrow.compute as pc

    # copied first: ascii_lower() misreads an array whose values start inside a shared buffer, as a cast slice's do
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    return split_runs(pc.ascii_lower(pc.fill_null(own, "")), gap)


def split_runs(texts: pa.Array, gap: str) -> tuple[pa.Array, np.ndarray]:
    """What stands between the matches of ``gap``, empty strings left out."""
    import pyarrow.compute as pc

    parts = pc.split_pattern_regex(texts, gap)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "")
    keep = full.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    return flat.filter(full), np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)


def row_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, of a partition that is sorted by them, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def letters_digest(array: np.ndarray) -> bytes:
    """16 bytes that stand for the content of an array."""
    import xxhash

    return xxhash.xxh3_128_digest(np.ascontiguousarray(array).tobytes())
