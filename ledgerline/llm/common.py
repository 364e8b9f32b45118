"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_root, scratch_path

#: Characters that separate words (and are stripped from lines): space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only, a null text read as empty: whatever other columns the
    table has cannot clash with the operator's own."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and go on from there: what
    follows reads it twice, or a lost executor would make Spark compute it again."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does just that to a text without other
    characters than ASCII, which is told by its number of bytes."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(col) == F.char_length(col), F.lower(col))
             .otherwise(F.translate(col, upper, upper.lower())))


def join_same(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on the named columns, null equal to null; the keys come once, from ``left``."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    out = left.join(right, match, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__right_{k}" for k in keys])


def keep_one(rows: DataFrame, lost: DataFrame, again: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without those whose ``keys`` are in ``lost``; of rows whose keys are in
    ``again`` (rows that repeat the one that stays, rare) one stays."""
    rows = join_same(rows, lost, *keys, how="left_anti")
    again = cut(again)
    if not again.isEmpty():
        rows = (join_same(rows, again, *keys, how="left_anti")
                .unionByName(join_same(rows, again, *keys, how="left_semi").dropDuplicates(list(keys))))
    return rows


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to a fresh place in the session's shared folder and read
    again: later jobs start from the files, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
