"""Save files as a Spark data source: format("loam_save").

    spark.dataSource.register(SaveFile)
    spark.read.format("loam_save").option("table", "chunk").load("world.db")
    spark.readStream.format("loam_save").option("table", "mapchunk").option("page", 4096).load("saves")

A save is an SQLite file; a folder of them is read as many worlds, whose name is the
file's. Keys are split at their quantiles, so that input partitions have about as
many rows each, however the keys lie. option("payload", "false") reads keys alone.
option("pushdown", "true") looks up only keys that conditions on position allow, where
spark.sql.python.filterPushdown.enabled is on, as Spark asks for it. The files must
lie where every executor can open them. Land the rows as Parquet and work from there.
"""

from __future__ import annotations

import os
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

TABLES = ("chunk", "mapchunk", "mapregion", "gamedata")
#: Keys that one statement looks up.
KEYS = 500


class Keys(InputPartition):
    """Keys from low to high of a save, or the listed ones; ends marks the end of a
    stream."""

    def __init__(self, path: str, low: int | None = None, high: int | None = None, listed: list[int] | None = None, ends: bool = False):
        super().__init__((path, low, high, listed, ends))
        self.path, self.low, self.high, self.listed, self.ends = path, low, high, listed, ends


class _Saves:
    """What the batch and the stream reader share."""

    def __init__(self, options):
        self.root, self.table = options["path"].removeprefix("file:"), options.get("table", "chunk")
        self.split = int(options.get("partitions", "8"))
        if self.table not in TABLES:
            raise ValueError(f"unknown table {self.table}")
        self.key = "savegameid" if self.table == "gamedata" else "position"
        self.data = "data" if options.get("payload", "true").lower() == "true" else "NULL"

    def paths(self) -> list[str]:
        if not os.path.isdir(self.root):
            return [self.root]
        return sorted(os.path.join(self.root, n) for n in os.listdir(self.root) if n.endswith((".db", ".vcdbs")))

    @staticmethod
    def open(path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def ranges(self, db, low: int | None, high: int | None) -> list[tuple[int, int]]:
        """Ranges of keys between low and high with about as many rows each: as many
        as partitions are asked for, if there are that many keys."""
        between, bounds = _between(self.key, low, high)
        n, last = db.execute(f"SELECT count(*), max({self.key}) FROM {self.table} {between}", bounds).fetchone()
        if not n:
            return []
        parts = min(self.split, n)
        places = [k * n // parts + 1 for k in range(parts)]
        marks = ",".join("?" * len(places))
        numbered = f"SELECT {self.key} AS k, row_number() OVER (ORDER BY {self.key}) AS n FROM {self.table} {between}"
        starts = [k for (k,) in db.execute(f"SELECT k FROM ({numbered}) WHERE n IN ({marks}) ORDER BY k", [*bounds, *places])]
        return [(a, b - 1) for a, b in zip(starts, starts[1:])] + [(starts[-1], last)]

    def rows(self, part: Keys):
        name = os.path.splitext(os.path.basename(part.path))[0]
        with self.open(part.path) as db:
            if part.listed is not None:
                for at in range(0, len(part.listed), KEYS):
                    some = part.listed[at : at + KEYS]
                    found = db.execute(f"SELECT {self.key}, {self.data} FROM {self.table} WHERE {self.key} IN ({','.join('?' * len(some))}) ORDER BY {self.key}", some)
                    yield from ((k, data, name) for k, data in found)
                return
            between, bounds = _between(self.key, part.low, part.high)
            yield from ((k, data, name) for k, data in db.execute(f"SELECT {self.key}, {self.data} FROM {self.table} {between} ORDER BY {self.key}", bounds))


def _between(key: str, low: int | None, high: int | None) -> tuple[str, list[int]]:
    terms = [(f"{key} >= ?", low), (f"{key} <= ?", high)]
    given = [(t, v) for t, v in terms if v is not None]
    return ("WHERE " + " AND ".join(t for t, _ in given) if given else ""), [v for _, v in given]


class SaveReader(_Saves, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.low = self.high = self.listed = None

    def take(self, filters):
        """Takes equality, membership and bounds of position over; Spark keeps the rest."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("position",) or not isinstance(value, (int, tuple, list)):
                yield f
            elif isinstance(f, (EqualTo, In)):
                keys = {value} if isinstance(f, EqualTo) else {v for v in value if v is not None}
                self.listed = sorted(keys if self.listed is None else keys & set(self.listed))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(low, self.low)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(high, self.high)
            else:
                yield f

    def partitions(self):
        out = []
        for path in self.paths():
            if self.listed is not None:
                keys = [k for k in self.listed if (self.low is None or k >= self.low) and (self.high is None or k <= self.high)]
                step = max(1, -(-len(keys) // self.split))
                out += [Keys(path, listed=keys[at : at + step]) for at in range(0, len(keys), step)]
            else:
                with self.open(path) as db:
                    out += [Keys(path, a, b) for a, b in self.ranges(db, self.low, self.high)]
        return out or [Keys(self.root, listed=[])] if self.paths() else []

    def read(self, partition):
        return iter(()) if partition.listed == [] else self.rows(partition)


class PushedReader(SaveReader):
    """SaveReader with conditions; Spark refuses it while pushing down is off."""

    def pushFilters(self, filters):
        return self.take(filters)


class SaveStream(_Saves, DataSourceStreamReader):
    """A save, or many, from the first key to the last in pages.

    The offset is the last key read of each world, so a stream that stops goes on
    where it was and reads no key twice. A batch has up to page rows of each world.
    When all cursors have reached the end, a row with complete = true and no key
    follows; worlds without rows have only that. Keys that are added behind a cursor
    later are read as further pages, and another such row follows.
    """

    def __init__(self, options):
        super().__init__(options)
        self.page, self.at = int(options["page"]), None
        if self.page < 1:
            raise ValueError("a page has a row at least")

    def initialOffset(self):
        return {"keys": {}, "complete": False}

    def latestOffset(self):
        now = self.at if self.at is not None else self.initialOffset()
        keys, complete = dict(now["keys"]), True
        for path in self.paths():
            name = os.path.basename(path)
            with self.open(path) as db:
                between, bounds = _between(self.key, keys[name] + 1 if name in keys else None, None)
                page = f"SELECT {self.key} AS k FROM {self.table} {between} ORDER BY {self.key} LIMIT {self.page + 1}"
                n, last = db.execute(f"SELECT count(*), max(k) FROM (SELECT k FROM ({page}) LIMIT {self.page})", bounds).fetchone()
                more = db.execute(f"SELECT count(*) FROM ({page})", bounds).fetchone()[0] > self.page
            complete &= not more
            if n:
                keys[name] = last
        self.at = {"keys": keys, "complete": complete}
        return self.at

    def partitions(self, start, end):
        if self.at is None:  # after a restart the last batch is planned first
            self.at = end
        out = []
        for path in self.paths():
            name = os.path.basename(path)
            if name in end["keys"] and end["keys"][name] != start["keys"].get(name):
                low = start["keys"][name] + 1 if name in start["keys"] else None
                with self.open(path) as db:
                    out += [Keys(path, a, b) for a, b in self.ranges(db, low, end["keys"][name])]
        return [*out, Keys(self.root, ends=True)] if end["complete"] and end != start else out

    def read(self, partition):
        if partition.ends:
            return iter([(None, None, None, True)])
        return ((*row, False) for row in self.rows(partition))


class SaveFile(DataSource):
    @classmethod
    def name(cls):
        return "loam_save"

    def schema(self):
        return "position long, data binary, world string" + (", complete boolean" if "page" in self.options else "")

    def reader(self, schema):
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (PushedReader if pushed else SaveReader)(self.options)

    def streamReader(self, schema):
        return SaveStream(self.options)


def write_saves(rows: DataFrame, folder: str, table: str = "mapchunk") -> None:
    """Write a save for each world of rows (world, position, data) to a folder that
    all executors have mounted. A world's rows, which are one save, meet in one
    task; of a repeated position the last data in their order stays."""
    where = folder.removeprefix("file:")

    def write(world: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(where, exist_ok=True)
        path = os.path.join(where, f"{world.world.iloc[0]}.db")
        part = f"{path}.{os.getpid()}.part"
        with sqlite3.connect(part) as db:
            db.execute(f"CREATE TABLE {table} (position INTEGER PRIMARY KEY, data BLOB)")
            db.executemany(f"INSERT OR REPLACE INTO {table} VALUES (?, ?)", world.sort_values(["position", "data"])[["position", "data"]].itertuples(index=False))
        os.replace(part, path)  # a task that is run again writes the same save
        return pd.DataFrame({"path": [path]})

    rows.select("world", "position", "data").groupBy("world").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
