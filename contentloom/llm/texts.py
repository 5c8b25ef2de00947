"""Columns of Arrow batches as the operators of this subpackage read them."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def narrow(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the whole text only; a null text is the empty one. Other columns, whatever
    their names, are left behind."""
    return rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lengths(column: pa.Array) -> np.ndarray:
    """Code points of each text."""
    return pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def in_batches(batch: pa.RecordBatch, text_at: int, limit: int = 4_000_000):
    """Slices of a batch of about ``limit`` bytes of text; a longer text is a slice of its own.
    This bounds what a task holds beside the batch, whatever the lengths of the texts."""
    sizes = pc.binary_length(batch.column(text_at)).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def bits_of(value: Column) -> Column:
    """A long's 64 bits, most significant first."""
    return F.lpad(F.bin(value), 64, "0")
