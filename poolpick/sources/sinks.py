"""Writers (SNK-1..6).

Large outputs are written partitioned and in parallel; ``coalesce(1)`` is
used only for report frames whose size is bounded by strategies x rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", header).option("sep", sep).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_selection(selection: DataFrame, raw: DataFrame, embeddings: DataFrame | None, out: str,
                    id_col: str = "row_id", all_embeddings: bool = False) -> dict[str, str]:
    """SNK-1/SNK-2: selected raw rows to CSV and Parquet, the embeddings of the selected
    rows (a semi join on the selection, which is bounded by the budget) and, optionally,
    the embeddings of every row (a plain parallel write)."""
    from poolpick.session import materialise

    # the selection (<= budget rows) feeds three writes: compute it once
    selection = materialise(selection.select(id_col, "rank"), "selection")
    rows = raw.join(selection, id_col)
    paths = {"csv": f"{out}/selected_csv", "parquet": f"{out}/selected_parquet"}
    write_csv(rows.select(*[c for c in rows.columns if c != "emb"]), paths["csv"])
    write_parquet(rows, paths["parquet"])
    if embeddings is not None:
        paths["embeddings"] = f"{out}/selected_embeddings"
        write_parquet(embeddings.join(selection.select(id_col), id_col, "left_semi"), paths["embeddings"])
        if all_embeddings:
            paths["all_embeddings"] = f"{out}/all_embeddings"
            write_parquet(embeddings, paths["all_embeddings"])
    return paths


def write_predictions(df: DataFrame, path: str, text_col: str = "prediction", lang_col: str = "language") -> None:
    """SNK-5: one prediction per line, one folder per language."""
    df.select(lang_col, F.col(text_col).cast("string").alias("value")).write.mode("overwrite") \
        .partitionBy(lang_col).text(path)


def write_report(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """SNK-6: small report tables (counts, distances, deltas, averages) as one CSV file."""
    write_csv(df.coalesce(1), path, header=header, sep=sep)


def write_metrics(df: DataFrame, path: str, keys: list[str]) -> dict[str, str]:
    """SNK-4: per run, one JSON object of metrics and a one-row CSV, each in the run's own folder."""
    paths = {"json": f"{path}/json", "csv": f"{path}/csv"}
    one = df.repartition(*keys)  # a run's row meets its folder in one task
    one.write.mode("overwrite").partitionBy(*keys).json(paths["json"])
    one.write.mode("overwrite").partitionBy(*keys).option("header", True).csv(paths["csv"])
    return paths


def read_metrics_json(spark, path: str, schema) -> DataFrame:
    """The written metric objects, keys from the folder names."""
    return spark.read.schema(schema).json(path)
