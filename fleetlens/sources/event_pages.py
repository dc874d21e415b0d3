"""A host's event log as a Spark data source: batch and stream, by ranges of the sequence.

The log is a Parquet file or folder on a path that Python's file systems open on every machine. A reader plans ranges of the
sequence from the row groups' statistics alone, one task each, and reads only the row groups that a range may touch; filters on
the sequence narrow the ranges before anything is read. A stream's offset is the last sequence taken, so it goes on from its
checkpoint where it stopped, and every event comes once however often it restarts. Events of a log are appended: a sequence
below the offset that turns up later isn't seen, as a host that is asked for what comes after a sequence wouldn't send it.

    event_pages.register(spark)
    spark.read.format("event_pages").option("sequence", "event_id").load(path)
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Range(InputPartition):
    """Events with a sequence above `after`, at most `upto`."""

    after: int
    upto: int


class Log:
    """The files of a log, their row groups and the sequences these hold."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("event_pages needs a path")
        self.path, self.sequence = options["path"], options.get("sequence", "sequence")
        self.rows = int(options.get("rowsAPartition", "100000"))
        if self.rows < 1:
            raise ValueError("rowsAPartition must be positive")

    def files(self):
        from pyarrow import fs
        from pyarrow import parquet as pq

        if "://" in self.path or self.path.startswith("file:"):
            system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        else:
            system, root = fs.LocalFileSystem(), self.path
        if system.get_file_info(root).type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith((".", "_"))]
        else:
            found = [root]
        for path in sorted(found):
            yield pq.ParquetFile(path, filesystem=system)

    def groups(self, file) -> Iterator[tuple[int, int, int, int]]:
        """Number, rows, least and largest sequence of each row group; without statistics it may hold any."""
        column = file.schema_arrow.get_field_index(self.sequence)
        if column < 0:
            raise ValueError(f"{self.path} has no column {self.sequence}")
        leaf = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == self.sequence)
        for g in range(file.num_row_groups):
            group = file.metadata.row_group(g)
            s = group.column(leaf).statistics
            known = s is not None and s.has_min_max
            yield g, group.num_rows, s.min if known else LEAST, s.max if known else MOST

    def last(self) -> int:
        """The largest sequence of the log, LEAST if it is empty."""
        out = LEAST
        for file in self.files():
            for g, rows, low, high in self.groups(file):
                if rows and low == LEAST and high == MOST:
                    seen = [v for v in file.read_row_group(g, [self.sequence])[0].to_pylist() if v is not None]
                    high = max(seen, default=LEAST)
                out = max(out, high) if rows else out
        return out

    def ranges(self, after: int, upto: int) -> list[Range]:
        """Ranges of about `rows` events that cover (after, upto], cut by the share of sequences that row groups hold."""
        held = [(low, high, rows) for file in self.files() for _, rows, low, high in self.groups(file) if rows and high > after and low <= upto]
        if upto <= after or not held:
            return []
        low, high = max(after + 1, min(h[0] for h in held)), min(upto, max(h[1] for h in held))
        parts = max(1, -(-sum(h[2] for h in held) // self.rows))
        step = max(1, -(-(high - low + 1) // parts))
        cuts = [low - 1, *range(low - 1 + step, high, step), high]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: Range, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A range's events in the order of their sequence."""
        import pyarrow.compute as pc

        found = []
        for file in self.files():
            wanted = [g for g, rows, low, high in self.groups(file) if rows and high > part.after and low <= part.upto]
            for batch in file.iter_batches(row_groups=wanted, columns=schema.names) if wanted else ():
                column = batch.column(schema.get_field_index(self.sequence))
                kept = batch.filter(pc.and_(pc.greater(column, part.after), pc.less_equal(column, part.upto)))
                if kept.num_rows:
                    found.append(kept.select(schema.names))
        if found:
            yield from pa.Table.from_batches(found).sort_by(self.sequence).cast(schema).combine_chunks().to_batches()


class EventPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_pages"

    def schema(self) -> StructType:
        for file in Log(self.options).files():
            return from_arrow_schema(file.schema_arrow)
        raise ValueError("an empty log needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Batch(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Stream(self.options, schema)


class Batch(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.log, self.schema = Log(options), to_arrow_schema(schema)
        self.after, self.upto = LEAST, MOST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the sequence are taken; Spark applies the others."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.log.sequence,) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.after = max(self.after, f.value - isinstance(f, GreaterThanOrEqual))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.upto = min(self.upto, f.value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.after, self.upto = max(self.after, f.value - 1), min(self.upto, f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.log.ranges(self.after, self.upto)

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Range):
            yield from self.log.read(part, self.schema)


class Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.log, self.schema = Log(options), to_arrow_schema(schema)
        self.start = int(options.get("after", LEAST))

    def initialOffset(self) -> dict:
        return {"sequence": self.start}

    def latestOffset(self) -> dict:
        return {"sequence": max(self.start, self.log.last())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.log.ranges(start["sequence"], end["sequence"])

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from self.log.read(part, self.schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventPages)
