"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Benchmark items are put in partitions by their number of distinct word shingles. Of each item the
smallest shingle hashes are kept as its sketch, its length set by the partition: twice as many as an item of that size may miss at the
containment threshold, plus two. The share of a sketch that a document holds estimates how much of the item it contains, however long it
is. An item that may miss k shingles misses k of its sketch at most, so a document that holds fewer of the sketch is no hit, and
no hit is lost. Candidates are verified by exact shingle containment on the strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, words

#: Sketch rows (28 bytes each) and bytes of item texts up to which either is broadcast; beyond, the search shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles, repeats included; fewer words count as one shingle, none as no shingle."""

    def of(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def shingles(text: Column, n: int) -> Column:
    """The distinct n-word shingles as strings."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(_let(words(text), of))


def allowed(size: Column, percent: int) -> Column:
    """Shingles of ``size`` that may miss at a containment of ``percent``."""
    return (size - F.floor((size * percent + 99) / 100)).cast("int")


def sketches(items: DataFrame, item_id: str, text: str, n: int, percent: int) -> DataFrame:
    """(item, size_class, need, h): each item's smallest hashes, as many as its size partition takes, and how many of them a hit holds at least."""
    sized = items.select(F.col(item_id).alias("item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text), n))).alias("hashes")).where(F.size("hashes") > 0)
    sized = sized.withColumn("size_class", F.ceil(F.log2(F.size("hashes"))).cast("int"))
    length = F.least((allowed(F.pow(F.lit(2), F.col("size_class")), percent) + 1) * 2, F.size("hashes"))
    need = F.greatest(length - allowed(F.size("hashes"), percent), F.lit(1))
    return sized.select("item", "size_class", need.alias("need"), F.explode(F.slice("hashes", 1, length)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, item_id, n_item, n_hit): items of which a document holds at least ``percent`` % of the distinct shingles.

    A row of ``docs`` is named by its id and ``row``, a hash of its text; equal rows are found each, with the same result. Null texts
    and texts without words hold nothing and are held by nothing; items of fewer than ``n`` words
    are one shingle, found in documents of the same few words only. Null ids are kept. Other columns are not looked at. Several items of one id
    are found each.
    """
    sketch = cut(sketches(items, item_id, item_text, n, percent).distinct())
    few = sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    light = (items.agg(F.sum(F.octet_length(item_text))).collect()[0][0] or 0) <= BROADCAST_BYTES
    row = F.xxhash64(F.col(text))
    probes = docs.select(F.col(doc_id).alias("doc"), row.alias("row"), F.explode(shingle_hashes(F.col(text), n)).alias("h"))
    shared = probes.join(F.broadcast(sketch) if few else sketch, "h").groupBy("doc", "row", "item", "need").agg(F.size(F.collect_set("h")).alias("found"))
    candidates = cut(shared.where("found >= need").groupBy("doc", "row").agg(F.collect_set("item").alias("items")))
    named = docs.select(F.col(doc_id).alias("doc_id"), row.alias("r"), F.col(text).alias("t"))
    held = named.join(candidates, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("r") == F.col("row")))
    exact = items.select(F.col(item_id).alias("item_id"), shingles(F.col(item_text), n).alias("wanted"))
    held = held.select("row", "doc_id", "items", shingles(F.col("t"), n).alias("there"))
    held = held.select("row", "doc_id", F.explode("items").alias("item_id"), "there")
    pairs = held.join(F.broadcast(exact) if light else exact, "item_id")
    pairs = pairs.select("row", "doc_id", "item_id", F.size("wanted").cast("long").alias("n_item"), F.size(F.array_intersect("wanted", "there")).cast("long").alias("n_hit"))
    return pairs.where((F.col("n_item") > 0) & (F.col("n_hit") * 100 >= F.col("n_item") * percent))


def remove(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that contain an item; all others as they are."""
    own, doc, row = (fresh(x, docs) for x in ("own", "doc", "row"))
    hits = contained(docs, items, doc_id, text, item_id, item_text, n, percent).select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    same = F.col(doc_id).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(row))
    return docs.withColumn(own, F.xxhash64(F.col(text))).join(hits, same, "left_anti").drop(own)
