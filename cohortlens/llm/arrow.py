"""Columns computed by a Python function over Arrow batches, next to the columns that are there already."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.shared import ship_package


# An Arrow batch is taken in pieces of about this many bytes: it has as many rows as the session's setting says, however long.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, about ``PIECE_BYTES`` at a time."""
    rows = max(1, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
    for row in range(0, batch.num_rows, rows):
        yield batch.slice(row, rows)


def release_memory() -> None:
    """Give memory that the last batch or fit no longer needs back to the system: workers stay alive between stages, next to
    the executor's heap, and so does the driver."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def with_arrow_columns(
    df: DataFrame, text_col: str, added: str, compute: Callable[[pa.Array], list[pa.Array]], cast: str | None = "string",
    forget: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with the columns of the schema ``added`` computed from the text column, piece by piece; a column that is
    there under such a name is replaced. Nothing is shuffled. ``forget`` is called in the worker at the end of a task."""
    ship_package(df.sparkSession)
    fields = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name not in fields.names]
    columns = [F.col(f"`{f.name}`") for f in kept]
    source = F.col(f"`{text_col}`")
    if text_col in [f.name for f in kept] and (cast is None or df.schema[text_col].dataType == T.StringType()):
        place = [f.name for f in kept].index(text_col)
    else:
        place = len(kept)
        columns.append((source.cast(cast) if cast else source).alias("_text_in"))
    frame, names, width = df.select(*columns), [f.name for f in kept] + fields.names, len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns[:width], *compute(piece.column(place))], names)
                del piece
            del batch
            release_memory()
        if forget:
            forget()
            release_memory()

    return frame.mapInArrow(run, T.StructType(kept + fields.fields))
