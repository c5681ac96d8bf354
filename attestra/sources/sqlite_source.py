"""A read-only SQLite data source: spark.read.format("sqlite").option("path", ...).option("table", ...)."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from attestra.plans.schemas import CATALOG_SOURCE


class Rows(InputPartition):
    """Row numbers from first to before stop."""

    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.table, self.parts = options.get("table", "documentos"), int(options.get("partitions", 4))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            low, high = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if low is None:
            return []
        step = (high - low) // self.parts + 1
        return [Rows(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, part: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as c:
            yield from c.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ?', (part.first, part.stop))


class SqliteSource(DataSource):
    """Columns default to those of the catalogue's source; a schema given to the reader prunes them."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        return CATALOG_SOURCE

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)
