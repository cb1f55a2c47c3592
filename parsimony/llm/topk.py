"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers and lie in blocks in vertical layout: one row per dimension. For a
block of queries and a block of candidates the scores are accumulated some dimensions at a
time. After each step a candidate's score can still grow by the product of the norms of
what remains of query and candidate; pairs that cannot reach the query's k-th best score any more
are dropped and the others compacted. The k-th best score carries over from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 512, 2048, 8
#: Candidate blocks that one task searches in a row for one block of queries, and the share of pairs still alive from which they are compacted.
RUN, COMPACT = 8, 0.25


def integers(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or non-finite components, and null ids, take no part; components beyond 64 bits stand at their limits."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = df.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return held.select("vec_id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """(name, ids, width, data): the rows of each block as one record, dimension by dimension."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        width = max(map(len, pdf["v"]), default=0)
        data = np.zeros((len(pdf), width), np.int64)
        for i, v in enumerate(pdf["v"]):
            data[i, : len(v)] = v
        kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= data.min(initial=0) and data.max(initial=0) <= np.iinfo(k).max)
        return pd.DataFrame({name: [pdf["b"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "kind": [kind], "data": [np.ascontiguousarray(data.T.astype(kind)).tobytes()]})

    # rows of one id, however many, are dealt out as well
    return rows.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).groupBy("b").applyInPandas(run, f"{name} int, ids binary, kind string, data binary")


def unpacked(ids: bytes, kind: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block, and its components as dimensions x rows."""
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(data, kind).astype(np.int64).reshape(-1, len(names))


def kind_for(q: np.ndarray, c: np.ndarray):
    """The fastest number type that holds every partial score exactly; Python's own numbers beyond 64 bits."""
    size = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    largest = size(q) * size(c) * max(len(q), 1)
    return np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else object


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def floor(self) -> np.ndarray:
        """What a score must reach to count, -inf while there are fewer than k."""
        return np.array([s[-1] if len(s) >= self.k else -np.inf for s, _ in self.lists], np.float64)

    def add(self, query: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        order = np.argsort(query, kind="stable")
        query, score, found = query[order], score[order], found[order]
        edges = np.searchsorted(query, np.arange(len(self.ids) + 1))
        for q in np.unique(query).tolist():
            part = slice(edges[q], edges[q + 1])
            s, f = np.concatenate([self.lists[q][0], score[part]]), np.concatenate([self.lists[q][1], found[part]])
            top = np.lexsort((f, ~s))[: self.k]  # ~ has no overflow
            self.lists[q] = (s[top], f[top])


def search(best: Best, q: np.ndarray, c: np.ndarray, c_ids: np.ndarray, step: int = STEP) -> int:
    """Search one block of candidates (dimensions x candidates) for one block of queries (dimensions x queries).

    Returns the number of pairs that were left when they were compacted, or all. Numbers too large for exact bounds
    are multiplied out; scores beyond 64 bits stand at their limits.
    """
    width = max(len(q), len(c))
    q, c = (np.pad(x, ((0, width - len(x)), (0, 0))) for x in (q, c))
    kind = kind_for(q, c)
    if kind is object:
        whole = np.clip(q.T.astype(object) @ c.astype(object), -(2**63), 2**63 - 1).astype(np.int64) if width else np.zeros((q.shape[1], c.shape[1]), np.int64)
        qi, ci = np.nonzero(best.ids[:, None] != c_ids[None, :])
        best.add(qi, whole[qi, ci], c_ids[ci])
        return whole.size
    left = q.shape[1] * c.shape[1]
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # the largest mass first
    q, c = q[order].astype(kind), c[order].astype(kind)
    rest_q = np.sqrt(np.cumsum((q.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    rest_c = np.sqrt(np.cumsum((c.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    own = best.ids[:, None] == c_ids[None, :]
    floor = best.floor()
    score = np.zeros((q.shape[1], c.shape[1]), kind)
    pairs = None
    for d in range(0, width, step):
        e = min(width, d + step)
        if pairs is None:
            score += q[d:e].T @ c[d:e]
        else:
            qi, ci, s = pairs
            for x in range(d, e):
                s = s + q[x, qi] * c[x, ci]
            pairs = (qi, ci, s)
        if e == width:
            break
        slack = 1 + 1e-9
        if pairs is None:
            bound = np.outer(rest_q[e], rest_c[e]) * slack + 1
            least = np.where(own, -np.inf, score - bound)
            k = best.k
            low = np.partition(least, c.shape[1] - k, axis=1)[:, c.shape[1] - k] if c.shape[1] >= k else np.full(len(floor), -np.inf)
            floor = np.maximum(floor, low)
            alive = (score + bound >= floor[:, None]) & ~own
            if alive.mean() < COMPACT:
                qi, ci = np.nonzero(alive)
                left = len(qi)
                pairs = (qi, ci, score[qi, ci])
        else:
            qi, ci, s = pairs
            stay = s + rest_q[e, qi] * rest_c[e, ci] * slack + 1 >= floor[qi]
            pairs = (qi[stay], ci[stay], s[stay])
    if pairs is None:
        qi, ci = np.nonzero((score >= floor[:, None]) & ~own)
        pairs = (qi, ci, score[qi, ci])
    qi, ci, s = pairs
    stay = s >= floor[qi]
    best.add(qi[stay], s[stay].astype(np.int64), c_ids[ci[stay]])
    return left


def top_k(df: DataFrame, vec_id: str, vector: str, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by ``every``.

    Ties go to the smaller id; fewer than k candidates give fewer rows. Repeated rows are candidates each, and one
    query; rows under one id are no candidates for a query of that id, and if their vectors differ its result is the best of all of them. Vectors of
    unequal length are compared as if padded by zeros. The number of blocks follows the table.
    """
    rows = integers(df, vec_id, vector, scale)
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    n, nq = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    left = packed(queries, query_blocks, "qb").select("qb", F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data"))
    right = packed(rows, blocks, "cb").select("*", (F.col("cb") / RUN).cast("int").alias("run"))
    runs = -(-blocks // RUN)
    # every block of queries meets every block of candidates: the stated query set against all rows, block by block
    asked = left.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    offered = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def run(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for _, row in q.iterrows():
            ids, data = unpacked(row["q_ids"], row["q_kind"], row["q_data"])
            best = Best(ids, k)
            for _, block in c.sort_values("cb").iterrows():
                c_ids, values = unpacked(block["ids"], block["kind"], block["data"])
                search(best, data, values, c_ids)
            for i, (score, found) in zip(ids.tolist(), best.lists, strict=True):
                out["query_id"] += [i] * len(score)
                out["vec_id"] += found.tolist()
                out["score"] += score.tolist()
        return pd.DataFrame(out).astype("int64")

    found = asked.groupBy("qb", "run").cogroup(offered.groupBy("qb", "run")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
