"""Python functions over Arrow columns, a slice of bounded bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Bytes and rows of a column that are Python objects at one time, whatever the batch holds; one row may have more.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """``column`` cut where rows fill a slice."""
    at, step = 0, SLICE_ROWS
    while at < len(column):
        piece = column.slice(at, step)
        if piece.nbytes > SLICE_BYTES and len(piece) > 1:
            step = max(1, len(piece) // 2)
            continue
        yield piece
        at, step = at + len(piece), min(SLICE_ROWS, step * 2)


def rowwise(kind: DataType, one: Callable[[Any], Any], nulls: bool = False) -> Callable[[Column | str], Column]:
    """``one`` of each value as a function of a Column; null stays null, or is given to ``one`` too.

    Of a batch there are the Arrow columns that come in and go out, and the Python objects of one slice:
    not, as with pandas, all its values as objects before and after.
    """

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        kept = to_arrow_type(kind)
        out = [pa.array([None if v is None and not nulls else one(v) for v in piece.to_pylist()], kept) for piece in pieces(column)]
        whole = pa.concat_arrays(out) if len(out) != 1 else out[0]
        del out
        pa.default_memory_pool().release_unused()
        return whole

    return run
