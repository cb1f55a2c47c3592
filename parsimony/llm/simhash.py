"""SimHash near-duplicates by the generalised pigeonhole principle.

Texts become 64-bit fingerprints of their word shingles. Two fingerprints at most ``tau`` bits
apart must, for any split of the bits into m parts and any part thresholds t_1..t_m with
sum(t_i) = tau - m + 1, agree up to t_i bits in some part i (a threshold of -1 skips a part).
Correlated bits go into the same part, since bits that move together spread few values;
the thresholds are allotted by dynamic programming on estimated candidate counts. Each fingerprint is
indexed by its part values and probes with all values within the part's threshold; a candidate
is verified by its whole distance inside the join. Components of the links are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, join_spread, words_of

BITS = 64
#: Fingerprints under one key beyond which the key is dealt out in tiles; the same for shingle sets, which are larger.
TILE, SET_TILE = 1024, 512
#: Texts under one MinHash key up to which their pairs are joined one by one.
FEW = 12
#: What a probe row costs against a candidate pair, as measured on sorted joins.
PROBE_COST = 6.0
#: MinHash keys of a text and minima in each: sets of a cosine similarity of 0.8 have a Jaccard similarity of 0.64 at least and so no key in common once in 1,480 times, more alike ones more rarely.
KEYS, MINIMA = 24, 3
_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 63, (KEYS * MINIMA, 1), np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, (KEYS * MINIMA, 1), np.uint64)
PLACES = _draw.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint_of(text, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint: bit b is 1 if it is set in over half of the shingles' XXH64; zero without words."""
    found = words_of(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    n, digest = len(found) - shingle + 1, xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    columns = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(columns[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def shingle_set(text, shingle: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words are one shingle, none are none."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in words_of(text)], np.uint64)
    hashes = np.zeros(max(len(words) - shingle + 1, min(len(words), 1)), np.uint64)
    for k in range(min(shingle, len(words))):
        hashes += words[k : k + len(hashes)] * PLACES[k]
    hashes ^= hashes >> np.uint64(31)
    return np.unique(hashes * PLACES[-1])


def minhash_keys(hashes: np.ndarray) -> np.ndarray:
    """``KEYS`` numbers, each a hash of ``MINIMA`` minima over a set of hashes."""
    low = np.full(KEYS * MINIMA, (1 << 64) - 1, np.uint64)
    for k in range(0, len(hashes), 1 << 12):
        low = np.minimum(low, (FACTORS * hashes[k : k + (1 << 12)] + TERMS).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[k * MINIMA : (k + 1) * MINIMA].tobytes(), k) for k in range(KEYS)], np.uint64).view(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes: bit b is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def sketched(df: DataFrame, shingle: int) -> DataFrame:
    """``df`` with ``fp`` and ``keys`` in place of ``text``: the fingerprint and the MinHash keys of its shingle set."""
    keep = [f for f in df.schema.fields if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(len(names))]
            fps = pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], fps, pa.array([minhash_keys(s) for s in sets], pa.list_(pa.int64()))], names=[*names, "fp", "keys"])

    return df.select(*names, "text").mapInArrow(run, T.StructType([*keep, T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def sets_of(df: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``s``, the shingle set, of a frame of ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return df.select("id", "text").mapInArrow(run, T.StructType([df.schema["id"], T.StructField("s", T.ArrayType(T.LongType()))]))


def fingerprints(df: DataFrame, text: str, shingle: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """``df`` without ``text`` and with the fingerprint as a signed 64-bit column; null texts count as empty."""
    keep = [f for f in df.schema.fields if f.name not in (text, name)]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint_of(x.as_py(), shingle, seed) for x in batch.column(batch.schema.get_field_index(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(made.view(np.int64))], names=[*names, name])

    return df.select(*names, text).mapInArrow(run, T.StructType([*keep, T.StructField(name, T.LongType())]))


def moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each two bits, how many have both: 64 x 64 sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "sums"])

    rows = nodes.select("fp").mapInArrow(run, "n long, sums array<double>")
    cells = rows.select("n", F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    sums = np.zeros(BITS * BITS)
    for r in cells:
        sums[r["i"]] = r["x"]
    return (cells[0]["n"] if cells else 0), sums.reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def correlated_parts(correlation: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m parts of nearly equal width: each part starts at the free bit of most correlation and takes the bits closest to it."""
    strength, free, parts = np.abs(correlation), list(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            b = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with the given sum; costs[i][t + 1] is what threshold t costs in part i, -1 being none."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, chosen) in best.items():
            for t, x in enumerate(c, -1):
                if (k := s + t) not in step or v + x < step[k][0]:
                    step[k] = (v + x, [*chosen, t])
        best = step
    return best[total]


def plan(n: int, sums: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated work: (bits of the part, threshold).

    The estimate for a part: its probes, and pairs that agree up to t bits, from the bits'
    shares of ones and, for the correlation inside a part, the effective number of independent bits.
    """
    share = np.diag(sums) / max(n, 1)
    cover = sums / max(n, 1) - np.outer(share, share)
    sd = np.sqrt(np.maximum(np.diag(cover), 1e-9))
    correlation = np.where(np.eye(BITS, dtype=bool), 0, cover / np.outer(sd, sd))
    choices = []
    for m in range(2, tau + 2):
        costs, parts = [], correlated_parts(correlation, m)
        for part in parts:
            inner = correlation[np.ix_(part, part)]
            real = len(part) / np.sqrt(1 + (inner**2).sum() / len(part))
            same = np.array([s * s + (1 - s) * (1 - s) for s in share[part]]).clip(0.5, 1)
            match = float(np.exp(np.log(same).mean() * real))
            row, probes, near = [0.0], 0, 0.0
            for t in range(min(tau, 3) + 1):
                probes += comb(len(part), t)
                near += comb(round(real), t) * match * float(((1 - same) / same).mean()) ** t
                row.append(n * probes * PROBE_COST + n * n / 2 * min(near, 1.0))
            costs.append(row)
        try:
            cost, chosen = allot(costs, tau - m + 1)
        except KeyError:
            continue
        choices.append((cost, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[0])[1]


def key_of(fp: Column, part: list[int]) -> Column:
    """The bits of a part, as one number (bit 0 is the highest)."""
    mask = sum(1 << (BITS - 1 - b) for b in part)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def tile_links(values: np.ndarray, left: np.ndarray, right: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """Links that join all of a tile's fingerprints that are linked inside it: a spanning forest, not every pair."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out: tuple[list[int], list[int]] = ([], [])
    for i in left.tolist():
        near = right[np.bitwise_count(values[i] ^ values[right]) <= tau]
        for j in near.tolist():
            if (a := root(i)) != (b := root(j)):
                parent[a] = b
                out[0].append(i)
                out[1].append(j)
    return out


def tile_copies(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links that join all of a tile's texts whose sets have a cosine similarity of ``percent`` %: a forest of such pairs only.

    Texts of one label are joined already.
    """
    names, label = np.unique(label, return_inverse=True)
    sizes = np.array([len(x) for x in sets], np.int64)
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(tokens, np.cumsum(sizes)[:-1])
    there = np.concatenate([own[j] for j in right])
    ends = np.concatenate(([0], np.cumsum(sizes[right])))
    marked = np.zeros(tokens.max(initial=-1) + 1, bool)
    out: tuple[list[int], list[int]] = ([], [])
    for i in left.tolist():
        if (label[right] == label[i]).all():
            continue
        marked[own[i]] = True
        common = np.diff(np.concatenate(([0], np.cumsum(marked[there])))[ends])
        marked[own[i]] = False
        for j in right[common * common * 10_000 >= sizes[i] * sizes[right] * percent**2].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out[0].append(i)
                out[1].append(j)
    return out


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sets (``id``, ``s``) have a cosine similarity of ``percent`` % or more: common shingles against the geometric mean of the sizes."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common, product = F.size(F.array_intersect("x", "y")).cast("long"), F.size("x").cast("long") * F.size("y")
    return both.where(common * common * 10_000 >= product * percent**2).select(*pairs.columns)


def links(nodes: DataFrame, tau: int, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of node ids whose fingerprints are at most ``tau`` bits apart.

    ``nodes`` has ``id`` and ``fp``. Keys of up to ``tile`` nodes are joined and give every pair;
    larger ones are dealt out in tiles, each of which returns a spanning forest of its links, so
    that no key meets in one task and the components are those of all pairs.
    """
    index, probe = keyed(nodes, tau)
    kind = nodes.schema["id"].dataType.simpleString()
    found, members = meet(index, probe, F.bit_count(F.col("g").bitwiseXOR(F.col("f"))) <= tau, tile)
    found = found.select("a", "b")
    if members is None:
        return found

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values, own = pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy()
        left, right = np.flatnonzero(own == pdf["i"].iloc[0]), np.flatnonzero(own == pdf["j"].iloc[0])
        a, b = tile_links(values, left, right, tau)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return found.union(tiled(members).groupBy("key", "i", "j").applyInPandas(run, f"a {kind}, b {kind}"))


def keyed(nodes: DataFrame, tau: int) -> tuple[DataFrame, DataFrame]:
    """(key, f, b) and (key, g, a): the rows by which nodes are found and those that look for them, and their ``label`` as m and l if there is one."""
    n, sums = moments(nodes)
    # rows carry one hash of part and value, as they are many; what it confuses, the distance tells apart
    rows = []
    label = ["label"] if "label" in nodes.columns else []
    fp = F.col("fp")
    for k, (part, t) in enumerate(plan(n, sums, tau)):
        flips = [sum(1 << (BITS - 1 - b) for b in c) for d in range(t + 1) for c in combinations(part, d)]
        signed = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in flips])
        rows.append(F.struct(F.lit(k).alias("part"), key_of(fp, part).alias("value"), signed.alias("flips")))
    stacked = nodes.select("id", *label, "fp", F.explode(F.array(*rows)).alias("row")).select("id", *label, "fp", "row.*")
    key = F.xxhash64("part", "value").alias("key")
    index = stacked.select(key, F.col("fp").alias("f"), F.col("id").alias("b"), *[F.col(c).alias("m") for c in label])
    probe = stacked.select("part", F.explode("flips").alias("flip"), "value", F.col("fp").alias("g"), F.col("id").alias("a"), *[F.col(c).alias("l") for c in label])
    return index, probe.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).select(key, "g", "a", *["l" for _ in label])


def meet(index: DataFrame, probe: DataFrame, near: Column, tile: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs that keys of up to ``tile`` nodes give, and the members of the larger keys (key, fp, id, tiles), if there are any."""
    hot = cut(index.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    few = hot.limit(1).count() == 0
    cold = index if few else index.join(hot, "key", "left_anti")
    found = probe.join(cold, (probe["key"] == cold["key"]) & (F.col("a") < F.col("b")) & near).drop("key", "f", "g")
    if few:
        return found, None
    # a hot key: its index rows and the probes that reach it are one set
    label = ["label"] if "m" in index.columns else []
    there = index.select("key", F.col("f").alias("fp"), F.col("b").alias("id"), *[F.col("m").alias(c) for c in label])
    members = there.union(probe.select("key", F.col("g").alias("fp"), F.col("a").alias("id"), *[F.col("l").alias(c) for c in label])).join(hot, "key")
    return found, members.distinct()


def tiled(members: DataFrame) -> DataFrame:
    """Members dealt out in tiles: tile (i, j) compares part i with part j of a key."""
    members = members.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return members.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("tiles", "other")


def near_duplicates(df: DataFrame, doc_id: str, text: str, tau: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``df`` without ``text`` and with ``fp`` (signed) and ``component_id``, which replace columns of these names.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``tau`` bits reach, the row's own
    included. Null texts count as empty, texts without words share the fingerprint zero. A null
    id is no smallest id: its row takes the component of its fingerprint, null if it is
    alone. Equal rows stay, each with the same component. An empty table gives an empty result.
    """
    rows = cut(fingerprints(df.drop("component_id") if "component_id" not in (doc_id, text) else df, text, shingle, seed))
    nodes = cut(rows.groupBy("fp").agg(F.min(doc_id).alias("low"), F.count("*").alias("n")))
    components = connected_components(links(nodes.select("fp", F.col("fp").alias("id")), tau))
    labelled = nodes.join(components, nodes["fp"] == components["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "low", "n")
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    return join_spread(rows, labelled.join(lowest, "label").select("fp", "component_id", "n"), "fp")


def near_copies(df: DataFrame, doc_id: str, text: str, tau: int = 4, shingle: int = 5, percent: int = 80, few: int = FEW, tile: int = SET_TILE) -> DataFrame:
    """(doc_id, text_id, component_id): groups of texts whose sets of ``shingle``-word shingles have a cosine similarity of ``percent`` % or more.

    The cosine is what a fingerprint estimates. Candidates are texts whose fingerprints lie at most ``tau`` bits apart,
    and texts with a MinHash key in common, since at the lowest similarity fingerprints differ in far more bits.
    Every candidate is verified on the shingle sets. First each text meets the smallest text of its keys; what
    is in one group by then is not compared again, so that a large group takes no square of its size. Keys with more than one group
    are compared whole: pair by pair, or in tiles that return a forest of verified pairs, so that no pair is lost to
    a text that is like neither. Equal texts are one node, named by their MD5. ``component_id`` is the
    smallest id of the group; texts without words are equal. A null id is no smallest id.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.unhex(F.md5(body))
    rows = cut(sketched(df.select(F.col(doc_id).alias("doc_id"), name.alias("id"), body.alias("text")), shingle))
    nodes = cut(rows.groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    texts = df.select(name.alias("id"), body.alias("text")).dropDuplicates(["id"])

    def sets(ids: DataFrame) -> DataFrame:
        return sets_of(texts.join(ids.distinct(), "id", "left_semi"), shingle)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    keys = nodes.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    keys = cut(keys.join(shared, "key"))
    stars = cut(keys.where("a < id").groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")))
    first = connected_components(alike(stars, cut(sets(ends(stars))), percent))
    known = cut(nodes.join(first, nodes["id"] == first["node"], "left").select("id", F.coalesce("label", "id").alias("label"), "low", "n", "fp"))
    # what is left: fingerprints that are near, and keys of more than one group
    index, probe = keyed(known, tau)
    found, members = meet(index, probe, (F.bit_count(F.col("g").bitwiseXOR(F.col("f"))) <= tau) & (F.col("l") != F.col("m")), TILE)
    named = keys.join(known.select("id", "label"), "id")
    mixed = named.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
    rest = cut(named.join(mixed, "key", "left_semi").select("key", "id", "label", "n"))
    small = rest.where(F.col("n") <= few)
    other = small.select("key", F.col("id").alias("b"), F.col("label").alias("m"))
    side = small.select("key", F.col("id").alias("a"), F.col("label").alias("l")).join(other, "key").where("a < b and l <> m")
    pairs = cut(found.select("a", "b", "l", "m").union(side.select("a", "b", "l", "m")).distinct())
    large = rest.where(F.col("n") > few).select("key", "id", "label", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    if members is not None:
        alone = members.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("key")
        large = large.union(members.join(alone, "key", "left_semi").select("key", "id", "label", "tiles"))
    large = cut(large)
    compared = cut(sets(ends(pairs).union(large.select("id"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, found = pdf["own"].to_numpy(), [np.asarray(x, np.int64) for x in pdf["s"]]
        left, right = np.flatnonzero(own == pdf["i"].iloc[0]), np.flatnonzero(own == pdf["j"].iloc[0])
        label = pdf["label"].to_numpy()
        l, m = tile_copies(found, label, left, right, percent) if len(left) and len(right) else ([], [])
        return pd.DataFrame({"l": label[l], "m": label[m]})

    verified = tiled(large).join(compared, "id").groupBy("key", "i", "j").applyInPandas(run, "l binary, m binary")
    groups = connected_components(alike(pairs, compared, percent).select("l", "m").union(verified), "l", "m")
    labelled = known.join(groups.select(F.col("node").alias("label"), F.col("label").alias("group")), "label", "left").select("id", F.coalesce("group", "label").alias("group"), "low", "n")
    lowest = labelled.groupBy("group").agg(F.min("low").alias("component_id"))
    return join_spread(rows.select("doc_id", "id"), labelled.join(lowest, "group").select("id", "component_id", "n"), "id").select("doc_id", F.lower(F.hex("id")).alias("text_id"), "component_id")
