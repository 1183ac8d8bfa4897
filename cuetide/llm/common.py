"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cuetide.session import keep_folder, let_go, shared_dir, ship, stored

__all__ = ["add_columns", "arrow_map", "keep_folder", "let_go", "read_table", "shared_dir", "ship", "slices", "spare", "stored"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spare(taken: list[str], name: str) -> str:
    """A column name that is not taken, whatever the case of its letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def prepare_arrow(spark: SparkSession) -> None:
    """Ship the package, and where the session has Spark's own default of 10,000 rows a batch, make it 1,000: texts are
    long, and a batch is held on both sides of the pipe."""
    ship(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds much more than max_bytes of a text or binary column (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for at, size in enumerate(sizes):
        if at > first and total + size > max_bytes:
            yield batch.slice(first, at - first)
            first, total = at, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType, sized_by: str, max_bytes: int = 2 << 20) -> DataFrame:
    """mapInArrow with one function per task (make is called in the task) over batches cut by the bytes of a column. A
    function with an attribute close has it called when the task ends; Python workers outlive tasks, so that what Arrow
    holds in reserve goes back then, too."""
    prepare_arrow(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                for piece in slices(batch, sized_by, max_bytes):
                    yield step(piece)
        finally:
            getattr(step, "close", lambda: None)()
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, make: Callable[[], Callable[[list], tuple]], source: str, added: list[tuple[str, T.DataType, pa.DataType]], drop: tuple[str, ...] = (), max_bytes: int = 2 << 20) -> DataFrame:
    """Add columns computed from one text or binary column. The task's function takes the list of its values, nulls
    included, and returns one list per added column. Other columns pass unchanged; a column whose name is to be
    added is replaced."""
    names = [name for name, _, _ in added]
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    schema = T.StructType([*kept, *(T.StructField(name, kind, True) for name, kind, _ in added)])
    arrow = [kind for _, _, kind in added]
    kept_names = [f.name for f in kept]

    def build() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        step = make()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = step(batch.column(source).to_pylist())
            arrays = [batch.column(name) for name in kept_names]
            arrays += [pa.array(values, kind) for values, kind in zip(found, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=[*kept_names, *names])

        one.close = getattr(step, "close", lambda: None)
        return one

    return arrow_map(df, build, schema, source, max_bytes)
