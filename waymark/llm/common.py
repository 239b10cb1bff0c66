"""Helpers shared by the operators of this package.

Rules that hold for every operator here:

* Inputs are read only through the columns an operator names (``doc_id`` and ``text`` by default); other
  columns are carried along untouched.  An input column that has the name of a column the operator adds is
  replaced by the operator's.
* A null text counts as the empty text unless an operator says otherwise.
* A null id is an ordinary value: it sorts first and never matches another id.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch: with texts of a few hundred kB a batch stays near 100 MB in the worst case.
ARROW_ROWS = 1000
#: Bytes of a batch that ``add_columns`` works on at once, so that what it makes stays small too.
WORK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name`` under ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, so that long texts can't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset in a local session (tests) a temporary folder of this machine is set once and used; on a
    cluster that would be another folder on each machine, so there it must be set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="waymark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/waymark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends, nothing is computed twice."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.waymark_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "waymark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, ``name`` or one made from it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def widened(schema: T.StructType, added: T.StructType) -> T.StructType:
    """``schema`` without the columns that ``added`` replaces (names compare without case), then ``added``."""
    new = {f.name.lower() for f in added.fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(added.fields))


def slices(batches: Iterator[pa.RecordBatch], size: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows of about ``size`` bytes; a longer row stands alone or with few others."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list | pa.Array]]],
    added: str | T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed batch by batch in Python.

    ``make()`` runs once per task and returns a function from a batch to the added columns; ``keep`` names the
    input columns to carry along (all by default).
    """
    small_batches(df.sparkSession)
    added = T._parse_datatype_string(added) if isinstance(added, str) else added
    kept = df.schema if keep is None else T.StructType([df.schema[c] for c in keep])
    out = widened(kept, added)
    names = [f.name for f in out.fields]
    fresh = {f.name for f in added.fields}
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches):
            new = f(batch)
            cols = []
            for name, field in zip(names, target):
                col = new[name] if name in fresh else batch.column(batch.schema.get_field_index(name))
                cols.append(col if isinstance(col, pa.Array) and col.type == field.type else col.cast(field.type) if isinstance(col, pa.Array) else pa.array(col, type=field.type))
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return df.mapInArrow(run, out)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as empty, without a Python list of all of them."""
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""



def sum_packed(rows: DataFrame, dtype: type = np.int64) -> dict[int, np.ndarray]:
    """Sum packed arrays (at int, data binary) by ``at``, in two steps, and return them to the driver.

    Each task sends one array for each ``at``; the first step spreads them over 16 groups for each, so no group
    gathers the arrays of all tasks.  What is left is one array for each ``at``, fetched by one job.
    """

    def total(frame):
        import pandas as pd

        data = np.sum([np.frombuffer(x, dtype=dtype) for x in frame["data"]], axis=0, dtype=dtype)
        return pd.DataFrame({"at": [frame["at"].iloc[0]], "data": [data.tobytes()]})

    some = rows.withColumn("_s", F.pmod(F.xxhash64("data"), F.lit(16))).groupBy("at", "_s").applyInPandas(total, "at int, data binary")
    return {r["at"]: np.frombuffer(r["data"], dtype=dtype) for r in some.groupBy("at").applyInPandas(total, "at int, data binary").collect()}


#: A key with more than this share of all rows is hot: there are at most HOT_KEYS such keys, so they can be broadcast.
HOT_KEYS = 2000


def split_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key, with a boolean ``hot``) on ``key``.

    The rows of hot keys, at most HOT_KEYS keys, are joined by broadcast and so stay where they are; the others
    are shuffled.  ``how`` is inner or left; a null key matches nothing.
    """
    hot, cold = keyed.where("hot").drop("hot"), keyed.where("not hot").drop("hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``keys`` columns, of batches sorted by them; keys aren't null."""
    held: list[pa.RecordBatch] = []
    same = lambda a, b: all(a.column(i)[0] == b.column(i)[0] for i in range(keys))
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for i in range(keys):
            c = batch.column(i).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and not (a == 0 and same(held[-1], part)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: list[str], item: str, points: int, queries: int) -> DataFrame:
    """``rows`` with ``cell``, the part of their group ``key`` that they go to, so that no part holds much more than
    ``points`` rows that are searched (``home``) and ``queries`` that ask; ``home`` is then the row's part in that cell, and
    ``among`` tells whether the cell's homes are also to be compared with each other.

    A group within both bounds is one cell, 0.  A larger one has its homes and askers dealt into blocks by a hash of
    ``item``: all pairs of two homes, and of a home with an asker, are compared in exactly one cell.  The sizes of large
    groups are joined on the key, which Spark splits where a key is hot.
    """
    sizes = rows.groupBy(*key).agg(F.count_if("home").alias("_h"), F.count_if(~F.col("home")).alias("_v")).where((F.col("_h") > points) | (F.col("_v") > queries))
    split = sizes.select(*key, F.ceil(F.col("_h") / points).cast("int").alias("_own"), F.ceil(F.col("_v") / queries).cast("int").alias("_others"))
    n, m = F.greatest(F.col("_own"), F.lit(1)), F.col("_others")
    own = F.pmod(F.xxhash64(item, F.lit(1)), n).cast("int")
    other = F.pmod(F.xxhash64(item, F.lit(2)), F.greatest(m, F.lit(1))).cast("int")
    at = lambda cell, home, among=False: F.struct(cell.cast("int").alias("cell"), F.lit(home).alias("home"), F.lit(among).alias("among"))
    every, each = F.sequence(F.lit(0), n - 1), F.slice(F.sequence(F.lit(0), m), 1, m)
    mine = F.concat(
        F.array(at(own * n + own, True, True)),
        F.transform(F.filter(every, lambda j: j > own), lambda j: at(own * n + j, True)),
        F.transform(F.filter(every, lambda i: i < own), lambda i: at(i * n + own, False)),
        F.transform(each, lambda v: at(n * n + own * m + v, True)),
    )
    theirs = F.transform(every, lambda i: at(n * n + i * m + other, False))
    whole = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home"), F.lit(True).alias("among")))
    cells = F.when(F.col("_own").isNull(), whole).when(F.col("home"), mine).otherwise(theirs)
    rest = [c for c in rows.columns if c not in (*key, "home")]
    return rows.join(split, key, "left").select(*key, *rest, F.explode(cells).alias("_at")).select(*key, "_at.cell", "_at.home", "_at.among", *rest)
