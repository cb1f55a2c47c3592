"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Every row belongs to a block by a hash, and blocks to groups of blocks. From the exact row counts
the matrix says how many rows each block sends to each shard. It is drawn in two steps: on the driver for the
groups, whose number is bounded, and from the groups' rows of it for their blocks, each group in a task of its own, from a
seed of its own. Rows are permuted inside their block, dealt out by the matrix, and permuted again inside their
shard, which gives each a gapless slot. The shard sizes are exact: at most one row apart.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Rows that one window of the local permutations holds on average, and groups of blocks at most.
ROWS_PER_BLOCK, GROUPS = 100_000, 1_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good ones, for counts of any size: inversion around the mode by the ratios of neighbouring probabilities."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = (drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5
    reach = int(12 * spread) + 60  # what lies beyond has a probability below 1e-30
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weights = np.concatenate(([0.0], np.cumsum(steps)))
    share = np.cumsum(np.exp(weights - weights.max()))
    return first + int(np.searchsorted(share, rng.random() * share[-1], side="right"))


def matrix(counts: list[int], sizes: list[int], seed) -> np.ndarray:
    """Rows that each block sends to each shard; margins are ``counts`` and ``sizes``."""
    rng = np.random.default_rng(seed)
    free = [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(map(int, counts)):
        rest = sum(free)
        for j, good in enumerate(free):
            rest -= good
            out[i, j] = x = hypergeometric(rng, good, rest, n)
            free[j] -= x
            n -= x
    return out


def shard(df: DataFrame, key: list[str], shards: int, seed: int = 17, rows_per_block: int = ROWS_PER_BLOCK, groups: int = GROUPS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (0 on, gapless inside a shard), which replace columns of these names.

    Law ``rows``: counts of two shards differ by one at most. ``key`` names the columns that
    tell rows apart; rows that are equal in all of them are interchangeable, and a block holds all rows of a key,
    so rows should be few per key. The result depends on rows, key and seed only, not on how the input is split, so a lost task repeats
    its own work. Any column may be null and the table may be empty.
    """
    df = df.drop(*[c for c in ("shard", "slot") if c not in key])
    names = [fresh(x, df) for x in ("h1", "h2", "h3", "part", "rank", "cuts", "block", "start")]
    h1, h2, h3, part, rank, cuts, block, start = names
    hashed = df.select("*", *[F.xxhash64(F.lit(seed * 10 + i), *key).alias(n) for i, n in enumerate(names[:3])])
    total = hashed.count()
    parts = max(1, -(-total // rows_per_block))
    groups = min(groups, parts)
    dealt = hashed.withColumn(part, F.pmod(h1, F.lit(parts)).cast("long"))
    counted = cut(dealt.groupBy(part).count().withColumn("g", F.pmod(part, F.lit(groups)).cast("int")))
    of_group = {r["g"]: r["n"] for r in counted.groupBy("g").agg(F.sum("count").alias("n")).collect()}  # at most ``groups`` numbers
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    drawn = matrix([of_group.get(i, 0) for i in range(groups)], sizes, seed)

    def blocks_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part)
        g = int(pdf["g"].iloc[0])
        bounds = np.cumsum(matrix(pdf["count"].tolist(), drawn[g].tolist(), [seed, g]), axis=1)
        return pd.DataFrame({part: pdf[part], cuts: [b.tolist() for b in bounds]})

    plan = counted.groupBy("g").applyInPandas(blocks_of, f"{part} long, {cuts} array<long>")
    local = Window.partitionBy(part).orderBy(h2, *key)
    sent = (
        dealt.withColumn(rank, F.row_number().over(local))
        .join(plan, part)
        .withColumn("shard", F.size(F.filter(cuts, lambda c: c < F.col(rank))))
        .drop(part, rank, cuts, h1, h2)
    )
    # the second permutation: by a hash inside the shard, block by block so that no window holds a whole shard
    blocks = max(1, -(-total // (shards * rows_per_block)))
    sent = cut(sent.withColumn(block, F.floor(F.shiftrightunsigned(F.col(h3), 32) * blocks / F.lit(2**32))))
    seen = sent.groupBy("shard", block).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.select("shard", block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", block).orderBy(h3, *key)
    return (
        sent.withColumn("slot", F.row_number().over(inside) - 1)
        .join(starts, ["shard", block])
        .withColumn("slot", F.col("slot") + F.col(start))
        .drop(block, start, h3)
    )
