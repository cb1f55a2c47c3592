"""Helpers that the operators share: table access, checkpoints, token bytes and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the five control characters from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share; a temporary one only where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def join_spread(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``groups``: one row per key, ``n`` being how many of ``rows`` have it; every key of ``rows`` is there.

    Keys of more than a hundred-thousandth of all rows (512 at least) are broadcast: there are at most
    100,000 of them, whatever the input, and no task gets all rows of one.
    """
    total = groups.agg(F.sum(n)).collect()[0][0] or 0
    limit = max(512, total // 100_000)
    hot = F.broadcast(groups.where(F.col(n) > limit).drop(n))
    cold = groups.where(F.col(n) <= limit).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def words_of(text) -> list[bytes]:
    """The words of a text in lower case (A-Z only), as UTF-8; ``bytes`` splits on exactly the six spaces."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def lower_ascii(column):
    """Lower-case A-Z only, inside the JVM."""
    return F.translate(column, UPPER, LOWER)


def words(column):
    """The words of a text as an array: no empty strings, null counts as empty."""
    return F.filter(F.split(lower_ascii(F.coalesce(column, F.lit(""))), SPACE_CLASS + "+"), lambda w: w != "")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star rounds.

    ``edges`` has two comparable columns; the result has ``node`` and ``label``, the smallest
    node that can be reached. Each round only groups by node with map-side minima and joins
    back, nodes with very many links by broadcast, so that none meets in one task; lineage is cut by a
    checkpoint each round. The number of rounds grows with the logarithm of the diameter.
    Nodes without links do not appear.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        # not a union: Spark fails on unions of checkpoints whose plan had an empty side
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = join_spread(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small)
        # a forest of stars: no parent has a parent of its own
        done = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        if done:
            same = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
            if same:
                return new.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                    new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
                )
        e = new
