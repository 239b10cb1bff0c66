"""Map stores in SQLite files as a Spark data source, both ways, and chunk files of recordings.

Every map is one file.  A table of many maps is read as one DataFrame: ranges of rows of each file are the partitions, filters on
numbers, strings and nulls run in the files, and bounds on the key leave out all ranges that can't hold it.
"""

from __future__ import annotations

import glob
import logging
import os
import re
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.text import map_time, stem

#: The tables of a map file, and the column that is the row's number there.
TABLES = {
    "Node": "id long, stamp double, pose binary",
    "Feature": "node_id long, pos_x double, pos_y double, depth_x double, depth_y double, depth_z double, descriptor_size int, descriptor binary",
    "Data": "id long, image binary, depth binary, calibration binary",
    "Link": "from_id long, to_id long, type int",
    "Info": "parameters string",
}
ROW_NUMBERS = {"Node": "id", "Data": "id"}
#: The column that tells the maps apart: the file's name without suffix.
MAP = "map_id"
#: What a filter is in a map file.
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
SAFE_NAME = re.compile(r"[\w.-]+")

log = logging.getLogger(__name__)


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    last: int


def files_of(path: str) -> list[str]:
    """The map files that a path names: a file, all *.db of a folder, or a pattern; in order of name."""
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/*.db"))
    return sorted(glob.glob(path)) if glob.has_magic(path) and not os.path.exists(path) else [path]


def columns_of(table: str) -> dict[str, str]:
    """The columns of a table with their types; sources run where no session parses them."""
    return dict(c.split() for c in TABLES[table].split(", "))


def connected(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


class SqliteMapReader(DataSourceReader):
    """Reads the columns of a schema; ``conditions`` and ``bounds`` come from pushed filters, ``rows_read`` counts what the
    files gave."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.table = options["path"], options.get("table", "Node")
        if self.table not in TABLES:
            raise ValueError(f"a map has no table {self.table!r}")
        known = set(columns_of(self.table))
        if not set(columns) <= {*known, MAP}:
            raise ValueError(f"{self.table} has no columns {sorted(set(columns) - known - {MAP})}")
        self.columns, self.parts = columns, int(options.get("numpartitions", 4))
        self.skip = options.get("broken", "fail") == "skip"
        self.conditions: list[tuple[str, list]] = []
        self.bounds: tuple[int | None, int | None] = tuple(int(options[k]) if k in options else None for k in ("low", "high"))
        self.maps: set[str] | None = None
        self.rows_read = 0

    def taken(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what a file can tell: comparisons with numbers and strings, sets of them, nulls.  Names come from the schema and
        values are bound, never written into the statement."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
            plain = all(isinstance(v, int | float | str) and not isinstance(v, bool) and v == v for v in values)
            if name == MAP and isinstance(f, EqualTo | In) and plain:
                self.maps = set(values) if self.maps is None else self.maps & set(values)
            elif name == MAP and isinstance(f, IsNotNull):
                continue  # every file has a name
            elif name not in self.columns or name == MAP:
                yield f
            elif isinstance(f, IsNull | IsNotNull):
                self.conditions.append((f'"{name}" IS {"NOT " * isinstance(f, IsNotNull)}NULL', []))
            elif isinstance(f, In) and plain:
                self.conditions.append((f'"{name}" IN ({", ".join("?" * len(values))})', values))
                self._bound(name, min(values, default=0), max(values, default=-1))
            elif type(f) in COMPARED and plain:
                self.conditions.append((f'"{name}" {COMPARED[type(f)]} ?', values))
                low, high = not isinstance(f, LessThan | LessThanOrEqual), not isinstance(f, GreaterThan | GreaterThanOrEqual)
                self._bound(name, values[0] if low else None, values[0] if high else None)
            else:
                yield f

    def _bound(self, name: str, low, high) -> None:
        if name == ROW_NUMBERS.get(self.table) and not any(isinstance(v, str) for v in (low, high)):
            a, b = self.bounds
            self.bounds = (low if a is None else a if low is None else max(a, low)), (high if b is None else b if high is None else min(b, high))

    def partitions(self) -> list[RowRange]:
        out = []
        for path in files_of(self.path):
            if self.maps is not None and name_of(path) not in self.maps:
                continue
            try:
                with connected(path) as c:
                    lo, hi = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.Error as e:
                if not self.skip:
                    raise ValueError(f"{path}: {e}") from e
                log.warning("map %s is left out: %s", path, e)
                continue
            if lo is None:
                continue
            step = max(1, -(-(hi - lo + 1) // self.parts))
            low, high = self.bounds
            every = (RowRange(path, a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step))
            out += [p for p in every if (low is None or p.last >= low) and (high is None or p.first <= high)]
        return out

    def read(self, partition: RowRange) -> Iterator[tuple]:
        names = ", ".join("?" if c == MAP else f'"{c}"' for c in self.columns)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *(c for c, _ in self.conditions)])
        values = [name_of(partition.path)] * (MAP in self.columns) + [partition.first, partition.last] + [v for _, vs in self.conditions for v in vs]
        with connected(partition.path) as c:
            for row in c.execute(f'SELECT {names} FROM "{self.table}" WHERE {where}', values):
                self.rows_read += 1
                yield row


class PushingMapReader(SqliteMapReader):
    """A reader that takes filters; Spark wants its setting on wherever a reader can."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.taken(filters)


def name_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]


class SqliteMapWriter(DataSourceWriter):
    """Each task writes its maps to files of its own; commit moves them to their names, abort deletes them.

    A map must come from one task: deal the rows out by map_id.  Readers never see half a map.
    """

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.folder, self.table, self.overwrite = options["path"], options.get("table", "Node"), overwrite
        if self.table not in TABLES:
            raise ValueError(f"a map has no table {self.table!r}")
        self.columns, self.at = schema.names, schema.names.index(MAP)
        self.types = columns_of(self.table)
        if set(self.columns) != {*self.types, MAP}:
            raise ValueError(f"{self.table} has the columns {sorted(self.types)}, and {MAP} names the map")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[T.Row]) -> Written:
        kinds = {"long": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB", "string": "TEXT"}
        names = [c for c in self.columns if c != MAP]
        row_number = ROW_NUMBERS.get(self.table)
        made = ", ".join(f'"{c}" {kinds[self.types[c]]}' + " PRIMARY KEY" * (c == row_number) for c in names)
        open_: dict[str, sqlite3.Connection] = {}
        files: dict[str, str] = {}
        temporary = f"{self.folder}/_temporary-{self.job}"
        os.makedirs(temporary, exist_ok=True)
        try:
            for row in iterator:
                name = row[self.at]
                if name not in open_:
                    if name is None or not SAFE_NAME.fullmatch(name):
                        raise ValueError(f"{name!r} can't name a map file")
                    files[name] = f"{temporary}/{uuid.uuid4().hex}.db"
                    open_[name] = sqlite3.connect(files[name])
                    open_[name].execute(f'CREATE TABLE "{self.table}" ({made})')
                values = [row[c] for c in names]
                open_[name].execute(f'INSERT INTO "{self.table}" VALUES ({", ".join("?" * len(names))})', [bytes(v) if isinstance(v, bytearray) else v for v in values])
            for c in open_.values():
                c.commit()
        finally:
            for c in open_.values():
                c.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        names = [n for m in told for n in m.files]
        there = {name_of(f) for f in files_of(self.folder)}
        again = sorted({n for n in names if names.count(n) > 1})
        taken = sorted(there & set(names)) if not self.overwrite else []
        if again or taken:
            self.abort(messages)
            raise ValueError(f"maps come from several tasks, deal rows out by {MAP}: {again}" if again else f"maps are there already: {taken}")
        for m in told:
            for name, file in m.files.items():
                os.replace(file, f"{self.folder}/{name}.db")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        temporary = f"{self.folder}/_temporary-{self.job}"
        for f in glob.glob(f"{glob.escape(temporary)}/*"):
            os.remove(f)
        if os.path.isdir(temporary):
            os.rmdir(temporary)


class SqliteMap(DataSource):
    """Options: path (of a file, a folder of *.db, or a pattern, that driver and executors can open), table, numPartitions (ranges
    of rows of each file), broken (fail, or skip: tell and leave out files that aren't maps).

    Writing takes rows with map_id and makes or replaces ``path``/<map_id>.db; append doesn't replace.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlitemap"

    def schema(self) -> str:
        table = self.options.get("table", "Node")
        if table not in TABLES:
            raise ValueError(f"a map has no table {table!r}")
        return f"{TABLES[table]}, {MAP} string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = PushingMapReader if self.options.get("pushfilters") == "true" else SqliteMapReader
        return kind(dict(self.options), schema.names)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteMapWriter(dict(self.options), schema, overwrite)


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteMap)


def read_map(spark: SparkSession, path: str, table: str, broken: str = "fail", parts: int = 4, low: int | None = None, high: int | None = None) -> DataFrame:
    """A table of one or many maps, with map_id; only the ranges of rows that hold row numbers from ``low`` to ``high``.

    Filters go into the files with the option pushFilters and spark.sql.python.filterPushdown.enabled, but Spark 4.1 keeps those of a
    DataFrame's first query for its next ones, which then lose rows: set it only where each query reads anew.
    """
    registered(spark)
    rows = spark.read.format("sqlitemap").option("path", path).option("table", table).option("broken", broken).option("numPartitions", parts)
    for name, value in (("low", low), ("high", high)):
        rows = rows if value is None else rows.option(name, value)
    return rows.load()


def write_maps(rows: DataFrame, folder: str, table: str, overwrite: bool = False) -> None:
    """Write rows with map_id as one file for each map under ``folder``; all maps appear when all are whole.

    Without ``overwrite`` a map that is there already stops the job before any is moved.
    """
    registered(rows.sparkSession)
    os.makedirs(folder, exist_ok=True)
    rows.repartition(MAP).write.format("sqlitemap").mode("overwrite" if overwrite else "append").option("path", folder).option("table", table).save()


def keypoints(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """map_id, node_id and pixels of the features that have them, with their place in the camera (null where unknown)."""
    rows = read_map(spark, path, "Feature", broken).where("pos_x is not null and pos_y is not null")
    return rows.select(MAP, "node_id", "pos_x", "pos_y", "depth_x", "depth_y", "depth_z")


def images(spark: SparkSession, path: str, ids: list[int], broken: str = "fail") -> DataFrame:
    """map_id, id, image of the nodes ``ids`` that have one; ranges of rows below and above all of them aren't read."""
    rows = read_map(spark, path, "Data", broken, low=min(ids, default=0), high=max(ids, default=-1))
    return rows.where(F.col("id").isin(ids) & F.col("image").isNotNull()).select(MAP, "id", "image")


def first_calibrations(spark: SparkSession, path: str, broken: str = "fail") -> DataFrame:
    """map_id, id and calibration blob of each map's first node that has one."""
    rows = read_map(spark, path, "Data", broken).where("calibration is not null")
    first = F.min_by(F.struct("id", "calibration"), "id").alias("_f")
    return rows.groupBy(MAP).agg(first).select(MAP, "_f.id", "_f.calibration")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """map_id, created_at, keyframes, error of every map file of a folder, in order of name; a file that can't be read has the
    reason in ``error`` and nulls, and hinders no other.  Files are opened on the executors."""
    paths = files_of(folder) if os.path.isdir(folder) else []
    if not paths:
        return spark.createDataFrame([], "map_id string, created_at timestamp, keyframes long, error string")

    def counted(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    with connected(path) as c:
                        out.append((name_of(path), c.execute('SELECT count(*) FROM "Node" WHERE pose IS NOT NULL').fetchone()[0], None))
                except sqlite3.Error as e:
                    out.append((name_of(path), None, str(e)))
            yield pd.DataFrame(out, columns=["map_id", "keyframes", "error"]).astype({"keyframes": "Int64"})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 32))
    rows = files.mapInPandas(counted, "map_id string, keyframes long, error string")
    return rows.select("map_id", map_time(F.col("map_id")).alias("created_at"), "keyframes", "error").orderBy("map_id")


def fixed_map(maps: DataFrame, map_id: str) -> DataFrame:
    """The configured map alone: one row of ``catalogue``, or none where it isn't there or can't be read."""
    return maps.where((F.col(MAP) == map_id) & F.col("error").isNull())


def chunk_frames(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Frames of the chunk_*.json files of ``folder`` (arrays of frames of ``schema``), with ``chunk_file`` and ``place``, their place
    in the file's array from 0.  A file that isn't such an array gives no frames."""
    whole = spark.read.text(f"{folder}/chunk_*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("chunk_file"), "value")
    frames = F.from_json("value", T.ArrayType(T._parse_datatype_string(schema)), {"mode": "PERMISSIVE"})
    return whole.select("chunk_file", F.posexplode(frames).alias("place", "frame")).where("frame is not null").select("chunk_file", "place", "frame.*")


def frame_metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The frames of ``chunk_frames`` that have an image, with its stem; of frames with one stem the last by file and place stays."""
    rows = chunk_frames(spark, folder, schema).where("image_path is not null").withColumn("stem", stem(F.col("image_path")))
    last = Window.partitionBy("stem").orderBy(F.desc("chunk_file"), F.desc("place"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "chunk_file", "place")


def image_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """path, stem, length of the images directly in ``folder``, by suffix without regard to case, in order of name; nothing but
    the listing is read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.lower("path").endswith(s)
    return files.where(ends).select("path", stem(F.col("path")).alias("stem"), "length").orderBy("path")
