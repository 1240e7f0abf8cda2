"""Change feed of a service as a stream, page by page, by a composite cursor.

The service gives pages of rows in the order of (time, id), strictly after a cursor. The
stream's offset is that cursor, so a checkpoint names the last row that was taken, also in
the middle of rows of one time. A micro-batch is one page; it is replayed by asking for the
rows between its two cursors again, so a restart repeats what was not committed and loses
nothing. A row that has changed meanwhile has moved behind the later cursor and comes then,
in its newest form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from millrace.functions import vocab as V

Cursor = tuple[str, object] | None


class PagedReader(SimpleDataSourceStreamReader):
    """``fetch(cursor, limit)`` gives at most ``limit`` rows (tuples in the columns' order)
    after a cursor (time as text, id), in cursor order; ``None`` is the beginning."""

    def __init__(self, fetch: Callable[[Cursor, int], list[tuple]], time_at: int, id_at: int, page: int) -> None:
        self.fetch, self.time_at, self.id_at, self.page = fetch, time_at, id_at, page

    def initialOffset(self) -> dict:
        return {"time": None, "id": None}

    def _cursor(self, row: tuple) -> tuple:
        return str(row[self.time_at]), row[self.id_at]

    @staticmethod
    def _after(offset: dict) -> Cursor:
        return None if offset["time"] is None else (offset["time"], offset["id"])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self.fetch(self._after(start), self.page)
        if not rows:
            return iter(()), start
        time, own = self._cursor(rows[-1])
        return iter(rows), {"time": time, "id": own}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at, last = self._after(start), self._after(end)
        while last is not None:
            rows = self.fetch(at, self.page)
            for row in rows:
                if self._cursor(row) > last:
                    return
                yield row
            if len(rows) < self.page:
                return
            at = self._cursor(rows[-1])

    def commit(self, end: dict) -> None:
        """Nothing to do: the service keeps no position."""


def read_changes(spark: SparkSession, fetch: Callable[[Cursor, int], list[tuple]], schema: str, *, time: str = "updated_at", id_col: str = "id", page: int = V.SYNC_PAGE, name: str = "change_feed") -> DataFrame:
    """A streaming table of a service's changes. ``fetch`` is called where the driver's Python
    workers run and has to be safe to call again with the same cursor."""
    columns = [part.strip().split()[0] for part in schema.split(",")]
    reader = PagedReader(fetch, columns.index(time), columns.index(id_col), min(max(page, 1), V.SYNC_PAGE))
    source = name

    class ChangeFeed(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema) -> PagedReader:
            return reader

    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format(source).load()
