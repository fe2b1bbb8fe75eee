"""Helpers shared by the operators of this subpackage: tables, shared folders, lineage cuts, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow slice handed to a kernel at once, in bytes; a longer text forms a slice of its own.
SLICE_BYTES = 3 << 20
#: Rows of an Arrow batch between Spark and Python, unless the session sets another number than Spark's own.
BATCH_ROWS = 2000

#: The one model, with its caches, that a worker process keeps between tasks.
_held: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The model of ``key``, made when a worker first needs it. A worker keeps one, whatever operators it has served."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops the model that this worker keeps and gives memory back that nothing uses."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a platform without it
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow`` in batches of a size that holds texts of some kilobytes."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a
    temporary folder; a cluster's executors would not see one, so that RuntimeError asks for the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut: written to the shared folder, so that a lost executor costs a read and no recomputation."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, with the writer's ``options``, and read again: its statistics are known
    and its columns prunable."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that name with underscores behind it: none of the columns of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``column`` (a string or binary column), whole rows each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def with_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, pa.Array]], added: str, source: str = "text", keep: list[str] | None = None, reads: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of DDL ``added`` that ``kernel`` computes from each slice of ``source``, kept columns and ``reads``.

    ``keep`` names the input columns of the result (all by default). A kept column whose name equals an added one (case
    aside) gives way to it.
    """
    spark = df.sparkSession
    extra = spark.createDataFrame([], added).schema
    new = {f.name.lower() for f in extra}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    inputs = list(dict.fromkeys([*kept, source, *(reads or [])]))
    frame = df.select(*[F.col(f"`{c}`") for c in inputs])
    schema = frame.select(*[F.col(f"`{c}`") for c in kept]).schema
    for f in extra:
        schema = schema.add(f)
    names = [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, source):
                got = kernel(part)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[got[n] for n in names]], names=[*kept, *names])
        pa.default_memory_pool().release_unused()  # the worker serves other tasks after this one

    return map_arrow(frame, run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Whole groups of equal ``keys`` (integer columns) from batches that are sorted by them, as tables with the bounds of
    each group. What is held is one batch and the group that its end leaves open."""
    held: list[pa.RecordBatch] = []

    def changes(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        differ = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            differ |= np.diff(table.column(k).to_numpy()) != 0
        return np.flatnonzero(differ) + 1

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        table = pa.Table.from_batches(parts)
        at = changes(table).tolist()
        return table, [*zip([0, *at], [*at, table.num_rows], strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield whole(held)
            held = []
        at = changes(batch)
        if len(at):
            yield whole([*held, batch.slice(0, int(at[-1]))])
            held = []
        held.append(batch.slice(int(at[-1]) if len(at) else 0))
    if held:
        yield whole(held)
