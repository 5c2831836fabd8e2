"""Arrow kernels over whole groups: many small groups in one call, each group's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: From (group bounds, fields of all rows as lists) to (places of the rows that are returned, a new column or None).
Kernel = Callable[[list[int], dict[str, list]], tuple[list[int], list | None]]


def over_groups(frame: DataFrame, group: str, order: dict[str, Column], rest: list[str], kernel: Kernel, reads: list[str], returns: list[str], schema: str | StructType) -> DataFrame:
    """Rows of each group, sorted by `order` (name to value), through a kernel that reads the fields `reads`. Returned are
    the group, the fields `returns` and the kernel's column, as in `schema`. The group is one array in the JVM, so the
    rows need no shuffle beyond the group's, and a call of Python serves a whole batch of groups."""
    rows = F.sort_array(F.collect_list(F.struct(*(c.alias(n) for n, c in order.items()), *rest)))
    listed = frame.groupBy(group).agg(rows.alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            bounds = [b - lists.offsets[0].as_py() for b in lists.offsets.to_pylist()]
            values = lists.flatten()
            field = lambda name: values.field(values.type.get_field_index(name))  # noqa: B023, E731
            places, made = kernel(bounds, {name: field(name).to_pylist() for name in reads})
            owner = lists.value_parent_indices()
            at = pa.array(places, pa.int64())
            columns = [keys.take(owner.take(at)), *(field(name).take(at) for name in returns), *([] if made is None else [pa.array(made, pa.int64())])]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = schema.names if isinstance(schema, StructType) else [part.split()[0] for part in schema.split(", ")]
    return listed.mapInArrow(run, schema)
