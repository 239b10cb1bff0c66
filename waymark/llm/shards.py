"""Operator 6: sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard.  At each node on its path, every child draws an exponential waiting time from a
hash of the row's id and the child's name, divided by the weight below the child; the least draw wins, so a child is
chosen in proportion to its weight.  A draw depends on one child alone: if weights change inside a subtree, rows move
only out of it or into it, and in a node whose weights all stay as they were no row moves.

A tree that grows by a shard must move rows into that shard only, from everywhere.  So a grown tree keeps the weights it
had and draws at its root for each shard added since: a row that an added shard wins goes straight there, all others
descend as before.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table


@dataclass(frozen=True)
class Tree:
    """region -> rack -> shard -> weight, and (shard, weight) added since, in order.  Weights are positive."""

    regions: dict[str, dict[str, dict[int, float]]]
    added: tuple[tuple[int, float], ...] = ()

    def shards(self) -> list[int]:
        return sorted({s for racks in self.regions.values() for shards in racks.values() for s in shards} | {s for s, _ in self.added})

    def grown(self, shard: int | None = None, weight: float = 1.0) -> Tree:
        """With one more shard (the next number), or with more weight for a given one; rows move only into it."""
        return dataclasses.replace(self, added=(*self.added, (max(self.shards()) + 1 if shard is None else shard, weight)))

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """(name, weight) of the children of the root, the regions and the racks, by the parent's name."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        for region, racks in self.regions.items():
            out[""].append((region, sum(sum(x.values()) for x in racks.values())))
            out[region] = [(f"{region}/{rack}", sum(shards.values())) for rack, shards in racks.items()]
            for rack, shards in racks.items():
                out[f"{region}/{rack}"] = [(f"{region}/{rack}/{s}", w) for s, w in shards.items()]
        out[""] += [(f"+{k}/added/{s}", w) for k, (s, w) in enumerate(self.added)]
        return out


#: Sub-groups of a shard in which slots are numbered; their offsets (shards * this many) reach the driver.
SLOT_GROUPS = 256
#: Copies of one row that are numbered by one task.
SLOT_STEP = 100_000


def uniform_tree(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 2) -> Tree:
    """Shards 0..n-1 of weight 1, filled rack by rack."""
    regions: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(n_shards):
        rack = s // shards_per_rack
        regions.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return Tree(regions)


def _winner(key: Column, children: Column) -> Column:
    """The name of the child of least draw -ln(u) / weight, u in (0, 1) from 53 bits of xxhash64(key, name); ties: least name."""
    bits = lambda c: F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double")
    draw = lambda c: F.struct((-F.ln((bits(c) + 0.5) / F.lit(float(2**53))) / c["weight"]).alias("d"), c["name"].alias("name"))
    return F.array_min(F.transform(children, draw))["name"]


def with_shard(rows: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Add ``name``, the shard of column ``key``: region, rack and shard in turn, each from the children on the path only.

    A null key descends as a key of its own.
    """
    array = lambda x: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(x)])
    known = tree.children()
    inner = F.create_map(*[c for parent, x in sorted(known.items()) if parent for c in (F.lit(parent), array(x))])
    path, out = fresh(rows, "_path"), rows
    out = out.withColumn(path, _winner(F.col(key), array(known[""])))
    for _ in range(2):
        # an added shard has no children: its row has arrived
        out = out.withColumn(path, F.when(F.col(path).contains("/added/"), F.col(path)).otherwise(_winner(F.col(key), F.element_at(inner, F.col(path)))))
    return out.withColumn(name, F.element_at(F.split(path, "/"), -1).cast("int")).drop(path)


def with_slots(df: DataFrame, group: str, order: list[str], groups: int = SLOT_GROUPS, step: int = SLOT_STEP) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each ``group``, without ever sorting a whole group in one task.

    Rows equal in all columns become one row with a count first, so a row repeated any number of times is numbered once.
    Rows of a group are dealt by hash to ``groups`` sub-groups and numbered there; a sub-group starts after all earlier
    ones.  Then a row comes back as often as it was there; one of over ``step`` copies is dealt out in parts of that size.
    """
    from pyspark.sql import Window

    columns = df.columns
    sub = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    counts = sub.groupBy(group, "_sub").agg(F.sum("_n").alias("_c"))
    before = (Window.unboundedPreceding, -1)
    # one row for each group and sub-group: its size does not depend on the number of rows
    start = Window.partitionBy(group).orderBy("_sub").rowsBetween(*before)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(start), F.lit(0))).drop("_c")
    own = Window.partitionBy(group, "_sub").orderBy(*order, *[c for c in columns if c not in order]).rowsBetween(*before)
    numbered = sub.withColumn("_row", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(counts), [group, "_sub"])
    rows = numbered.select(*columns, "_n", (F.col("_start") + F.col("_row")).alias("_at"))
    copies = lambda r, first, last: r.select(*columns, F.explode(F.sequence(F.col("_at") + first, F.col("_at") + last)).alias("slot"))
    last = F.col("_n") - 1
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or these few short rows would be put together again
    many = rows.where(F.col("_n") > step).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))).repartition(tasks, F.col("_at") + F.col("_from"))
    return copies(rows.where(F.col("_n") <= step), F.lit(0).cast("long"), last).unionByName(copies(many, F.col("_from"), F.least(F.col("_from") + (step - 1), last)))


def shard_documents(docs: DataFrame, n_shards: int = 8, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot and grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 and ``text_crc32`` the unsigned CRC-32 of those bytes (null text:
    none, so 1 and 0).  The law is ``key``: id and tree alone decide the shard.  ``grown_shard`` is the shard in the
    tree (the given one, or the uniform one) grown by one shard.  Repeated rows go to one shard, null ids too, and get slots
    of their own; whole texts of any length are read; other columns don't matter; an empty table gives no rows.
    """
    tree = tree or uniform_tree(n_shards)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    # rows equal in id, size and digest are interchangeable: their other columns follow from these
    rows = with_shard(with_shard(rows, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    out = with_slots(rows, "shard", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(table(spark, sf_dir, "documents"))
