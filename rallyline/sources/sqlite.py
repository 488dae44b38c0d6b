"""A data source for tables of SQLite files, read in ranges of row ids."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary", "": "string"}


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.parts, self.columns = options["path"], options["table"], int(options.get("parts", 1)), columns

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition):
        named = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'select {named} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").option("path", ...).option("table", ...)``; register the class first."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            found = db.execute(f"""pragma table_info("{self.options['table']}")""").fetchall()
        return ", ".join(f"`{r[1]}` {KINDS.get(r[2].upper().split('(')[0], 'string')}" for r in found)

    def reader(self, schema) -> Reader:
        return Reader(self.options, schema.fieldNames())


def read_table(spark, path: str, table: str, parts: int = 1):
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("parts", parts).load()
