"""Line dedup by distinct-site spread, with DataFrame functions only.

For every line hash a HyperLogLog sketch of the sites that carry the line is aggregated; the
sketches merge from partition to partition. Lines whose estimate lies clearly above the threshold are
boilerplate, lines near it get an exact distinct count, the rest stay. Boilerplate
stays where it stands first and goes everywhere else.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Registers of a sketch, as a power of two.
LG_K = 12


def lines_of(df: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    """(doc, row, site, pos, h1, h2) for each line of at least ``min_chars`` characters, blanks around it aside.

    A row is named by its id and, should ids repeat, a hash of its text. A null site is a site of its own; the two
    hashes of a line together have 128 bits.
    """
    split = df.select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(F.col(text)).alias("row"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    ).withColumn("line", F.trim("line"))
    return split.where(F.length("line") >= min_chars).select("doc", "row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first, n): lines on at least ``sites`` distinct sites, where each stands first and how often it stands.

    An estimate is three standard errors off at most once in 370 lines; the band is at least one site wide, and up to some
    hundred sites the sketch counts exactly, so that no line of a threshold in that range is missed.
    """
    band = max(1, ceil(3 * 1.04 / sqrt(2**lg_k) * sites))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min(F.struct("doc", "row", "pos")).alias("first"), F.count("*").alias("n"))
    spread = spread.select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites - band)
    spread = cut(spread)
    near = spread.where(F.col("estimate") <= sites + band)
    # one row per line and site before lines meet, so that a common line's places do not
    pairs = lines.select("h1", "h2", "site").distinct()
    exact = pairs.join(near.select("h1", "h2", F.lit(1).alias("one")), ["h1", "h2"])
    enough = exact.groupBy("h1", "h2").agg(F.sum("one").alias("found")).where(F.col("found") >= sites).select("h1", "h2")
    sure = spread.where(F.col("estimate") > sites + band).select("h1", "h2", "first", "n")
    return sure.union(near.join(enough, ["h1", "h2"], "left_semi").select("h1", "h2", "first", "n"))


def dedup(df: DataFrame, doc_id: str, text: str, site: str, sites: int = 3, min_chars: int = 16, lg_k: int = LG_K) -> DataFrame:
    """``df`` with ``text`` cleaned, ``n_lines`` and ``n_removed``, which replace columns of these names.

    A line on at least ``sites`` distinct sites stays in the row with the smallest id, at its
    first place there, and is removed from every other place. Lines are compared without blanks around
    them; those below ``min_chars`` characters always stay. Null texts stay null with no lines.
    Equal rows are treated alike. No row is dropped: a text all of whose lines go becomes empty.
    """
    gone, doc, row = (fresh(x, df) for x in ("gone", "doc", "row"))
    lines = lines_of(df, doc_id, text, site, min_chars)
    found = cut(boilerplate(lines, sites, lg_k))
    here = F.struct("doc", "row", "pos")
    away = lines.join(found.drop("n"), ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).groupBy("doc", "row").agg(F.collect_set("pos").alias(gone))
    away = away.select(F.col("doc").alias(doc), F.col("row").alias(row), gone)
    keyed = df.withColumn(row, F.xxhash64(F.col(text)))
    joined = keyed.join(away.withColumnRenamed(row, row + "_"), F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(row) == F.col(row + "_")), "left").drop(row, row + "_", doc)
    split = F.split(text, "\n", -1)
    kept = F.filter(split, lambda _, i: ~F.array_contains(gone, i))
    return (
        joined.withColumn("n_lines", F.coalesce(F.when(F.col(text).isNotNull(), F.size(split)), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .drop(gone)
    )
