"""A corpus from raw documents to token ids: five stages, each calling one operator of the llm package.

Every stage gets all that its predecessor kept.  Rows without an id can't be told apart: near-duplicate and
substring removal leave them as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm import chunks, language, leaks, pieces, simhash
from waymark.llm.common import forget, fresh, materialize, table

#: A document whose best language covers less than this share of its letters is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: The struct that carries a row's columns past an operator.
ROW = "_row"
#: The columns that stages read and change.
OWN = ("doc_id", "text")

#: No SQL can express language models, gear hashes, latent spaces or BPE: tests hold each stage against brute force.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one struct, so that none is replaced by one that an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, F.struct(*(others or [F.lit(0).alias("none")])).alias(ROW))


def unpacked(found: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, with those in ``new`` in place of the old ones."""
    return found.select(*[new.get(c, F.col(c) if c in OWN else F.col(ROW)[c]).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one language covers most letters; texts without a letter go."""
    found = language.identify(packed(docs), language.fit(docs))
    return unpacked(found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, keep one document: that of least (id, text hash), once.

    A row of a repeated id is judged by its own text; unlike texts of one id are components of their own.  Of
    rows equal in id and text the first by the other columns stays.
    """
    key = F.xxhash64("text")
    hashed, component = fresh(docs, "_hash"), fresh(docs, "_component")
    found = simhash.near_duplicates(docs.withColumn(hashed, key), keep=[hashed]).where("doc_id is not null")
    least = found.groupBy(F.col("component_fp").alias(component)).agg(F.min(F.struct("doc_id", hashed)).alias("k")).select("k.*")
    rows = docs.withColumn(hashed, key).join(least, ["doc_id", hashed], "left_semi")
    # a map, alone or within, has no order of its own
    others = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    number = F.row_number().over(Window.partitionBy("doc_id", hashed).orderBy(*(others or [F.col(hashed)])))
    one = rows.withColumn(component, number).where(F.col(component) == 1)
    return one.select(docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; documents of which nothing is left go."""
    found = chunks.dedup_substrings(packed(docs))
    left = (F.col("removed_words") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    return unpacked(found.where(left), docs, n_chars=F.length("text").cast("long"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one."""
    return unpacked(leaks.find_leaks(packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digest for what is left."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_documents(docs.select("doc_id", "text"), model, lists=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_text),
    ("decontamination", drop_benchmark_leaks),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a table goes when the next is written."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, before, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
            forget(before)
            before = docs
    return docs
