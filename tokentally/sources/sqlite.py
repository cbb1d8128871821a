"""A Spark data source for SQLite tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Table:
    """A table of a file, opened read-only."""

    def __init__(self, schema, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.rows = int(options.get("rowsPerPartition", "100000"))
        self.conditions: list[tuple[str, list]] = []
        self.push = options.get("pushFilters", "false").lower() == "true"

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def ranges(self, after: int = -(2**63), to: int = 2**63 - 1) -> list[_Range]:
        """Ranges of as many rows each, however far apart their ids are: one entry for rowsPerPartition rows."""
        with self._connect() as c:
            firsts = [r for (r,) in c.execute(f'SELECT id FROM (SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS n FROM "{self.table}" WHERE rowid > ? AND rowid <= ?) WHERE (n - 1) % ? = 0 ORDER BY id', (after, to, self.rows))]
        return [_Range(a, b) for a, b in zip(firsts, [*[f - 1 for f in firsts[1:]], to], strict=True)] if firsts else [_Range(0, -1)]

    def read_range(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        where = "".join(f" AND {text}" for text, _ in self.conditions)
        values = [v for _, vs in self.conditions for v in vs]
        with self._connect() as c:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?{where} ORDER BY rowid', (partition.low, partition.high, *values))


class _Reader(_Table, DataSourceReader):
    """Reads ranges of row ids, so that a large table is many tasks; comparisons of columns with texts or whole numbers are left to SQLite."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.conditions = []
        if not self.push:
            yield from filters
            return
        for f in filters:
            told = self._condition(f)
            if told is None:
                yield f
            else:
                self.conditions.append(told)

    def _condition(self, f: Filter) -> tuple[str, list] | None:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in self.columns:
            return None
        plain = lambda v: isinstance(v, str | int) and not isinstance(v, bool)
        if isinstance(f, IsNotNull):
            return f'"{column}" IS NOT NULL', []
        if type(f) in _OPERATORS and plain(f.value):
            return f'"{column}" {_OPERATORS[type(f)]} ?', [f.value]
        if isinstance(f, In) and f.value and all(map(plain, f.value)):
            return f'"{column}" IN ({", ".join("?" * len(f.value))})', list(f.value)
        if isinstance(f, StringStartsWith):
            return f'substr("{column}", 1, ?) = ?', [len(f.value), f.value]
        return None

    def partitions(self) -> list[InputPartition]:
        return self.ranges()

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.read_range(partition)


class _StreamReader(_Table, DataSourceStreamReader):
    """Rows as they are added: those with ids above the last one read."""

    def initialOffset(self) -> dict:
        return {"row": -(2**63)}

    def latestOffset(self, *_) -> dict:
        with self._connect() as c:
            return {"row": c.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0] or -(2**63)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start["row"], end["row"])

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.read_range(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class SqliteSource(DataSource):
    """Options: path, table, rowsPerPartition, pushFilters; the schema must be given.

    With pushFilters, comparisons are left to SQLite.  Spark 4.1 keeps a reader with the filters of the first
    query on a frame for later queries on the same frame, so it is for frames that are always filtered alike; others are loaded anew.
    """

    @classmethod
    def name(cls) -> str:
        return "tokentally_sqlite"

    def schema(self) -> str:
        return "id string, session_id string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)


def register_sqlite(spark: SparkSession) -> None:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
