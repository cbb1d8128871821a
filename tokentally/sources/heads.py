"""The beginnings and sizes of files, without reading the rest."""

from __future__ import annotations

import fnmatch
import json
import sys
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, head string, bytes bigint"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        from tokentally.streaming.tail import open_path

        self.open = open_path
        self.roots, self.pattern, self.size, self.files = json.loads(options["paths"]), options["pattern"], int(options["bytes"]), int(options.get("filesPerTask", "500"))

    def partitions(self) -> list[InputPartition]:
        found = []
        for root in self.roots:
            system, inner, scheme = self.open(root)
            found += [scheme + f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)]
        found.sort()
        return [_Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, inner, _ = self.open(path)
            with system.open_input_file(inner) as f:
                yield path, f.read(self.size).decode("utf-8", "replace"), f.size()


class HeadSource(DataSource):
    """Options: paths (a JSON list), pattern, bytes, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "tokentally_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def file_heads(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl", size: int = 16 * 1024) -> DataFrame:
    """file_path (as in files.lines()), head (the first ``size`` bytes), bytes (the file's size) of all files below ``paths``."""
    from pyspark import cloudpickle

    from tokentally.streaming import tail

    for module in (sys.modules[__name__], tail):
        cloudpickle.register_pickle_by_value(module)  # workers need not have this package
    spark.dataSource.register(HeadSource)
    return spark.read.format("tokentally_heads").option("paths", json.dumps(paths)).option("pattern", pattern).option("bytes", str(size)).load()
