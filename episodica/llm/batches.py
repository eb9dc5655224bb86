"""Arrow batches through Spark: results next to the columns they came from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one step of a scan; texts of a batch are held twice at most.
STEP_ROWS = 2_000


def struct(fields: T.StructType, columns: list[pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(columns, names=fields.names)


def with_struct(rows: DataFrame, text: str, output: str, fields: T.DataType,
                scan: Callable[[pa.Array], pa.Array], step: int = STEP_ROWS) -> DataFrame:
    """``rows`` with a column (a struct, or of another type) of what ``scan`` finds in each text; one of that name is replaced."""
    kept = [c for c in rows.columns if c != output]
    plain = [f"c{k}" for k in range(len(kept) + 1)]   # names with dots do not reach mapInArrow
    packed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, plain)])
    position = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([*part.columns, scan(part.column(position))], names=plain)

    found = packed.mapInArrow(run, T.StructType([*packed.schema.fields, T.StructField(plain[-1], fields)]))
    return found.toDF(*kept, output)
