"""Readers (SRC-1..10). Every read states its schema or reads a self-describing format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolpick.operators.reports import parse_result_lines, read_run_tree  # noqa: F401  (re-exported)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """SRC-1: CSV with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).option("header", header).option("sep", sep) \
        .option("multiLine", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-5: headerless TSV, e.g. language distances (src, tgt, metric, value)."""
    return read_csv(spark, path, schema, header=False, sep="\t")


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """SRC-2: one split of a split-partitioned Parquet dataset (partition pruning)."""
    return spark.read.parquet(path).where(F.col(split_col) == split)


def read_languages(spark: SparkSession, path: str, languages: list[str], lang_col: str = "language") -> DataFrame:
    """SRC-3: the named languages of a language-partitioned Parquet dataset."""
    return spark.read.parquet(path).where(F.col(lang_col).isin(languages))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (e.g. result CSVs read positionally, allocation files)."""
    return spark.read.text(path)
