"""Arrow batches of texts inside tasks: bounded slices and whole texts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

import landprice

#: A slice holds about so many bytes of text, or one longer text.
SLICE_BYTES = 4 << 20


def sliced(
    batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that what a task holds for one slice does not follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            used = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, used + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Each whole text; null is empty, bytes that are not UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw_texts(batch, column)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if ``df`` has such a column."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(df: DataFrame) -> None:
    """Send this package's code to the executors, once in a session."""
    context = df.sparkSession.sparkContext
    if getattr(context, "_landprice_shipped", False):
        return
    root = Path(landprice.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="landprice-code-")) / "landprice.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._landprice_shipped = True


def map_batches(df: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship(df)
    return df.mapInArrow(function, schema)
