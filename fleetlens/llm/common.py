"""Shared pieces: the cluster's shared folder, written intermediates, word rules and Arrow helpers."""

from __future__ import annotations

import contextvars
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII blanks, which bytes.split() also cuts at.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, on a local master, one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        return f"file://{folder}"
    return own.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: The lists of the recorded() blocks that this call stands in; another thread's run has its own.
_recording: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recording", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that written() makes meanwhile, so that their maker can remove them once nothing reads them."""
    made: list[str] = []
    token = _recording.set((*_recording.get(), made))
    try:
        yield made
    finally:
        _recording.reset(token)


def release() -> None:
    """Give freed memory back to the system at the end of a Python task, as idle workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let_go(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffles and broadcasts of rounds that are over: it goes by what the driver's garbage
    collection finds unreachable, which in a short driver may come late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    for made in _recording.get():
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_task(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as written() does, bucketed by `key`, which is constant within each task: each task writes one file, nothing is
    shuffled, and a join by `key` with a table hashed into as many partitions leaves df where it is.

    The catalogue entry goes at once; files and the plan that reads them stay.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    for made in _recording.get():
        made.append(path)
    entry = "fleetlens_" + uuid.uuid4().hex
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    out = out.select(*[F.col(f"`{c}`") for c in out.columns])
    spark.sql(f"DROP TABLE {entry}")
    return out


def rows_of_tasks(rows: DataFrame, part: str, unit: str, units: DataFrame) -> DataFrame:
    """The rows whose unit (as of monotonically_increasing_id, so part = unit >> 33) is in units (unit, distinct).

    rows come from written_by_task() by part and stay where they are: each task that wrote rows gets one string of a byte
    for each of its rows, in order, and looks up its own. Only row numbers are shuffled.
    """
    number = F.expr(f"cast(unit & {(1 << 33) - 1} as int)")
    lists = units.groupBy(F.shiftright("unit", 33).alias("u_part")).agg(F.array_sort(F.collect_list(number)).alias("ns"))
    gaps = F.transform("ns", lambda n, i: F.concat(F.repeat(F.lit("0"), n - F.coalesce(F.get("ns", i - 1), F.lit(-1)) - 1), F.lit("1")))
    marks = lists.select("u_part", F.encode(F.array_join(gaps, ""), "UTF-8").alias("marks"))
    found = rows.join(marks.hint("shuffle_hash"), F.col(part) == F.col("u_part"))
    return found.where(F.expr(f"substring(marks, cast(`{unit}` & {(1 << 33) - 1} as int) + 1, 1) = X'31'")).drop("u_part", "marks")


def by_task(rows: DataFrame, part: str, unit: str, decided: DataFrame, name: str) -> DataFrame:
    """rows with the column `name`: what decided (unit, d: a row for each row of rows) says of each.

    rows come from written_by_task() by part and stay where they are: decisions are shuffled, one array for each task that
    wrote rows, in their order, and looked up by row number. An array is as long as the rows of one input split.
    """
    own, list_ = free_name(rows, "own"), free_name(rows, "list")
    ordered = F.array_sort(F.collect_list(F.struct("unit", "d")))
    lists = decided.groupBy(F.shiftright("unit", 33).alias(own)).agg(F.transform(ordered, lambda x: x["d"]).alias(list_))
    joined = rows.join(lists.hint("shuffle_hash"), F.col(part) == F.col(own))
    return joined.withColumn(name, F.get(list_, F.expr(f"cast(`{unit}` & {(1 << 33) - 1} as int)"))).drop(own, list_)


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """(rows as a table bucketed by writing task, and the names of its columns part and unit)."""
    unit = free_name(rows, "unit")
    part = free_name(rows.withColumn(unit, F.lit(0)), "part")
    out = rows.withColumn(unit, F.monotonically_increasing_id()).withColumn(part, F.shiftright(unit, 33))
    return written_by_task(out, name, part, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), part, unit


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str | list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """many joined with one (a row for each keys) on keys; the rows of a hot key are dealt by `by` over `salts` tasks, to
    which its row of `one` is copied as far as many has rows there. many is read twice, so `by` must be stored columns."""
    salt = free_name(many, "salt")
    salted = many.withColumn(salt, F.pmod(F.xxhash64(*([by] if isinstance(by, str) else by)), F.lit(salts)).cast("int"))
    copies = one.join(salted.select(*keys, salt).distinct(), keys)
    return salted.join(copies, [*keys, salt], how).drop(salt)


def plain_columns(df: DataFrame) -> list[str]:
    """The columns of simple types, quoted: what tells rows apart."""
    return [f"`{f.name}`" for f in df.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through the cluster's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_fs(uri: str):
    """(file system, path) of a shared folder for Python workers; file:// and plain paths are local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write: Callable) -> None:
    """Write a file under a name of this attempt, then move it: a lost or repeated task leaves whole files only."""
    system, path = open_fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(attempt) as out:
        write(out)
    system.move(attempt, path)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [b"" if v is None else v for v in values.cast(kind).to_pylist()]


def with_columns_from_text(
    df: DataFrame, column: str, added: list[tuple[str, T.DataType]], rows: Callable[[pa.RecordBatch], list], keep_text: bool = True
) -> DataFrame:
    """Add columns computed from a text column by Arrow batches; other columns pass through untouched.

    rows(batch) returns one sequence of values per added column. Added names must be new.
    """
    kept = [f for f in df.schema.fields if keep_text or f.name != column]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in added])
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}
    kinds = [arrow[t] for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rows(batch)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            arrays += [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
            del made, arrays, batch
        release()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text divisible by parts; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
