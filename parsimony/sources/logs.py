"""Readers of texts, dictionaries, session logs, gain logs and chat requests.

All are permissive: lines that do not parse are dropped, fields that are missing have their zero value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn

def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def numbered(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, line_no, line) of text files, read line by line and split by split.

    ``line_no`` orders the lines of a file: where the line's split begins and the line's place in it.
    """
    files = spark.read.options(lineSep="\n", **options).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return files.select(F.col("_metadata.file_path").alias("path"), place.alias("line_no"), F.col("value").alias("line"))


def log_lines(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """(path, line_no, line) of every ``*.jsonl`` under a folder, blank lines left out, and lines of more than ``longest`` bytes if that is given."""
    lines = numbered(spark, path, recursiveFileLookup="true", pathGlobFilter="*.jsonl", ignoreMissingFiles="true")
    lines = lines.withColumn("line", fn.trim("line")).where(F.col("line") != "")
    return lines if longest is None else lines.where(F.octet_length("line") <= longest)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, wordtype, definition, line) of a headerless dictionary: plain commas, of which a row has two at least; ``line`` orders the rows."""
    rows = numbered(spark, path)
    return parse_dictionary(rows.select(F.col("line_no").alias("line"), F.regexp_replace("line", "\r$", "").alias("value")))


def parse_dictionary(rows: DataFrame) -> DataFrame:
    """The same from (line, value)."""
    cut = F.split("value", ",", 3)
    return rows.where(F.size(cut) == 3).select(F.lower(F.trim(F.get(cut, 0))).alias("word"), F.trim(F.get(cut, 1)).alias("wordtype"), F.get(cut, 2).alias("definition"), "line")


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _is_text(v: Column, path: str) -> Column:
    """Whether the value at a path is a JSON string or missing; anything else spoils the record."""
    kind = F.schema_of_variant(F.variant_get(v, path, "variant"))
    return F.coalesce(kind.isin("STRING", "VOID"), F.lit(True))


def gain_events(lines: DataFrame) -> DataFrame:
    """(path, line_no, t, cmd, before, after, dir) from gain log lines; a line with a field of the wrong type is dropped."""
    v = F.try_parse_json("line")
    parsed = lines.withColumn("v", v).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    whole = F.lit(True)
    for name in ("t", "before", "after"):
        kind = F.coalesce(F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant")), F.lit("VOID"))
        whole = whole & kind.isin("BIGINT", "VOID")
    good = parsed.where(whole & _is_text(F.col("v"), "$.cmd") & _is_text(F.col("v"), "$.dir"))
    number = lambda n: F.coalesce(F.try_variant_get("v", f"$.{n}", "bigint"), F.lit(0)).alias(n)
    return good.select("path", "line_no", number("t"), _text(F.col("v"), "$.cmd").alias("cmd"), number("before"), number("after"), _text(F.col("v"), "$.dir").alias("dir"))


def session_pieces(lines: DataFrame) -> DataFrame:
    """(path, line_no, role, text): what each session record says.

    Content is a string or a list of blocks; text blocks speak under the message's role,
    tool results, themselves a string or a list of text blocks, under the role "tool". Blank pieces,
    other blocks and records of other types go.
    """
    v = lines.withColumn("v", F.try_parse_json("line")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    typed = v.select("path", "line_no", _text(F.col("v"), "$.type").alias("type"), _text(F.col("v"), "$.message.role").alias("given"), F.try_variant_get("v", "$.message.content", "variant").alias("content"))
    said = typed.where(F.col("type").isin("user", "assistant")).withColumn("role", F.when(F.col("given") == "", F.col("type")).otherwise(F.col("given")))
    plain = said.where(F.schema_of_variant("content") == "STRING").select("path", "line_no", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "role", F.col("content").cast("string").alias("text"))
    listed = said.where(F.schema_of_variant("content").startswith("ARRAY"))
    exploded = lines.sparkSession.tvf.variant_explode(F.col("content").outer())
    blocks = listed.lateralJoin(exploded).select("path", "line_no", "role", F.col("pos").alias("i"), F.col("value").alias("block"))
    kind = F.try_variant_get("block", "$.type", "string")
    texts = blocks.where(kind == "text").select("path", "line_no", "i", F.lit(-1).alias("j"), "role", F.try_variant_get("block", "$.text", "string").alias("text"))
    results = blocks.where(kind == "tool_result").select("path", "line_no", "i", F.try_variant_get("block", "$.content", "variant").alias("content"))
    short = results.where(F.schema_of_variant("content") == "STRING").select("path", "line_no", "i", F.lit(-1).alias("j"), F.lit("tool").alias("role"), F.col("content").cast("string").alias("text"))
    deep = results.where(F.schema_of_variant("content").startswith("ARRAY"))
    nested = deep.lateralJoin(exploded).select("path", "line_no", "i", F.col("pos").alias("j"), F.col("value").alias("block"))
    inner = nested.where(kind == "text").select("path", "line_no", "i", "j", F.lit("tool").alias("role"), F.try_variant_get("block", "$.text", "string").alias("text"))
    return plain.union(texts).union(short).union(inner).where(fn.trim("text") != "")


def session_dirs(lines: DataFrame) -> DataFrame:
    """(path, cwd): the first folder that any record of a session names."""
    v = lines.select("path", "line_no", F.try_variant_get(F.try_parse_json("line"), "$.cwd", "string").alias("cwd"))
    return v.where(F.col("cwd") != "").groupBy("path").agg(F.min_by("cwd", "line_no").alias("cwd"))
