"""Writers: reduced texts and lexicon tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_texts(df: DataFrame, text: str, path: str) -> None:
    """One text column as it is: rows end with a NUL, since texts hold line breaks."""
    df.select(text).write.mode("errorifexists").option("lineSep", "\0").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A lexicon table (word, replacement or class) as Parquet, its files sorted by word from first to last."""
    df.orderBy(df.columns[0]).write.mode("errorifexists").parquet(path)
