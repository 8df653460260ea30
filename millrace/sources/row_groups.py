"""A Python data source over Parquet files: a partition for each row group, of which filters skip some, and a stream of new files."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[str]]:
    """The Parquet files of a path, which is a file, a folder or a folder and a pattern, by name."""
    head, _, tail = path.rpartition("/")
    pattern = tail if "*" in tail else "*"
    system, root = pyarrow.fs.FileSystem.from_uri(head if "*" in tail else path) if "://" in path else (pyarrow.fs.LocalFileSystem(), head if "*" in tail else path)
    if system.get_file_info(root).type == pyarrow.fs.FileType.File:
        return system, [root]
    found = [f for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".parquet")]
    return system, sorted(f.path for f in found if fnmatch.fnmatch(f.base_name, pattern))


def read_group(path: str, partition: RowGroup | None, schema: StructType) -> Iterator[pa.RecordBatch]:
    if partition is None:  # what Spark asks for where there are no partitions
        return
    system, _ = _files(path)
    with system.open_input_file(partition.path) as held:
        yield from pq.ParquetFile(held).iter_batches(row_groups=[partition.group], columns=schema.names)


def may_hold(least, most, wanted: Filter) -> bool:
    """Whether a row group whose values lie between two bounds may have a row that passes the filter."""
    if isinstance(wanted, EqualTo):
        return wanted.value is not None and least <= wanted.value <= most
    if isinstance(wanted, In):
        return any(v is not None and least <= v <= most for v in wanted.value)
    if isinstance(wanted, GreaterThan):
        return most > wanted.value
    if isinstance(wanted, GreaterThanOrEqual):
        return most >= wanted.value
    if isinstance(wanted, LessThan):
        return least < wanted.value
    if isinstance(wanted, LessThanOrEqual):
        return least <= wanted.value
    return True


class GroupReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.wanted = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column of the table skip row groups; Spark still applies all filters to the rows."""
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1:
                self.wanted.append(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Reads the files' footers only."""
        system, files = _files(self.path)
        out: list[InputPartition] = []
        for path in files:
            told = pq.ParquetFile(system.open_input_file(path)).metadata
            for g in range(told.num_row_groups):
                group = told.row_group(g)
                stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                if all(self._may(stats.get(f.attribute[0]), f) for f in self.wanted):
                    out.append(RowGroup(path, g))
        return out

    @staticmethod
    def _may(stats, wanted: Filter) -> bool:
        if stats is None or not stats.has_min_max:
            return True
        try:
            return may_hold(stats.min, stats.max, wanted)
        except TypeError:  # bounds of another kind than the filter's value say nothing
            return True

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return read_group(self.path, partition, self.schema)


class GroupStream(DataSourceStreamReader):
    """New files by name: an offset is the number of files that were read. Files must come in the order of their names."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path)[1])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, files = _files(self.path)
        own = files[start["files"] : end["files"]]
        return [RowGroup(path, g) for path in own for g in range(pq.ParquetFile(system.open_input_file(path)).metadata.num_row_groups)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return read_group(self.path, partition, self.schema)


class RowGroups(DataSource):
    """``spark.read.format("row_groups").load(path)``: a path that pyarrow reads, on the driver and on every executor."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        system, files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Parquet files in {self.options['path']}")
        return from_arrow_schema(pq.read_schema(system.open_input_file(files[0])), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return GroupReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return GroupStream(self.options["path"], schema)


def register_row_groups(spark: SparkSession) -> None:
    """Make the source known to a session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RowGroups)
