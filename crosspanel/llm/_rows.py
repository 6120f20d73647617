"""Small helpers shared by the operators: Arrow row mapping, words, shared folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "float": pa.float32(),
}

#: Arrow bytes that are Python objects at a time.
BATCH = 4_000_000
#: A word is a run of characters other than the six ASCII white spaces.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = bytes(range(9, 14)) + b" "


def words(text: str | None) -> list[str]:
    """The words of a text; none for null."""
    return WORD.findall(text) if text else []


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8.  bytes.split() knows exactly the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[list[list]]], Iterator[list]]) -> DataFrame:
    """Applies fn to the partitions of ``columns``.

    fn gets an iterator over batches (a list of Python lists, one per column) and yields batches in the order of ``schema``, which
    is written "name type, name type".  Several yields per batch are fine, so memory stays within one batch.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    arrow = pa.schema([(n, _ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = ([c.to_pylist() for c in part.columns] for b in batches for part in parts(b))
        for out in fn(source):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH bytes, since Python objects take several times the room of Arrow's."""
    rows = max(1, batch.num_rows * BATCH // max(1, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.  Where that is unset a new local folder serves a local master (tests);
    on a cluster executors could not read it, so that raises an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, with its lineage cut."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: While this is set, Spark drops a query's shuffle files at its end; nothing reads them after a table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables that the current call has written, inside ``released``; each thread has a list of its own.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query that runs inside takes its shuffle files with it."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    if (own := _written.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``table`` writes inside, at the end.  Tables of other calls and threads stay."""
    token = _written.set([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written.get() or []:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        _written.reset(token)


class Scratch:
    """The tables of one call: written in the shared folder under a folder of their own, removed one by one or at the end of the call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schemas = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again; the shuffles behind it go at once, so that the disk holds those of one step, not of all."""
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.schemas[name] = df.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A written table, with columns of its own each time."""
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read any more; collecting the driver's garbage lets Spark remove what is left of broadcasts."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


def in_blocks(df: DataFrame, id_column: Column, text_column: Column, size: int, extra: Column | None = None) -> DataFrame:
    """(block, id, text, extra): the rows with null texts as empty ones, in blocks of about ``size`` characters.

    A block's rows are neighbours of one partition, so nothing is shuffled.  Block numbers are those of a task and its count; write the
    result before two things read it.
    """
    rows = df.select(id_column.cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), (F.lit("") if extra is None else extra).alias("extra"))

    def run(batches: Iterator[list[list]]) -> Iterator[list]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for ids, texts, extras in batches:
            own = []
            for t in texts:
                own.append(block)
                held += len(t) + 16
                if held >= size:
                    block, held = block + 1, 0
            yield [own, ids, texts, extras]

    return map_rows(rows, ["id", "text", "extra"], "block long, id long, text string, extra string", run)


def by_block(left: DataFrame, right: DataFrame, schema: str, fn: Callable[[pa.Table, pa.Table], dict]) -> DataFrame:
    """What fn makes of the rows that two tables have for a block: a dict of columns."""
    arrow = pa.schema([(n, _ARROW[t]) for n, t in (f.strip().split(" ", 1) for f in schema.split(", "))])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = fn(one, two)
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((out[f.name] for f in arrow), arrow, strict=True)], schema=arrow)

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has in no case: ``name``, with as many underscores before it as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
