"""Text columns through Python in small Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and characters that one call sees at most (a single longer text is a slice of its own).
SLICE_ROWS, SLICE_CHARS = 256, 4_000_000


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or chars + n > SLICE_CHARS):
            yield start, i - start
            start, chars = i, 0
        chars += n
    if start < len(sizes):
        yield start, len(sizes) - start


def map_slices(df: DataFrame, keep: list[str], inputs: list[str], out: str, make: Callable[[], Callable]) -> DataFrame:
    """``keep`` columns unchanged, then the columns ``out`` (DDL) computed from ``inputs``.

    ``make()`` runs once in each task and returns a function from one list for each input to
    one list for each output column.
    """
    added = T._parse_datatype_string(out)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    columns = list(dict.fromkeys([*keep, *inputs]))

    def run(batches):
        arrow = to_arrow_schema(schema)
        call = make()
        for batch in batches:
            sizes = batch.column(columns.index(inputs[0])).to_pylist()
            for start, n in _slices([len(x) if x else 0 for x in sizes]):
                part = batch.slice(start, n)
                made = call(*[part.column(columns.index(c)).to_pylist() for c in inputs])
                arrays = [part.column(columns.index(c)) for c in keep]
                arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, arrow)]
                arrays += [pa.array(x, type=f.type) for x, f in zip(made, list(arrow)[len(keep):], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
