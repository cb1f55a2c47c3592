"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision node has a context tree of its own over the
preceding bytes, the nearest at the root. Every tree node estimates its bit by
Krichevsky and Trofimov's rule, and the trees mix the estimates of all depths from 0 to 5 with the weights
that their probability of the training bits gives them; a context that was never seen gives either bit one half. The probabilities of a byte's eight bits
multiply to the byte's; the logarithms of a text's bytes add up to its code length.

A text is its words in lower case (A-Z) with one space between them and a final end byte.

How it is distributed. Contexts of five bytes and the byte they precede are the model's counts. Texts
lie in chunks of bounded size; a chunk passes on each of its distinct strings once, packed
by a bucket of the string's nearest context bytes. Buckets add up the counts of all chunks and hold whole subtrees from
depth 3 on; the bounded rest (depths 0 to 2) is summed over the buckets. Each chunk gets back the
logarithms for its own strings. What is moved grows with the text, and no task or driver
holds more than a chunk, a bucket or the bounded top of the trees.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, words_of

DEPTH = 5
PAD, END_TOKEN = b"\n" * DEPTH, b" "
#: Bytes of text in a chunk on average, chunks whose counts are merged at once, and chunks of a bucket that are scored at once.
CHUNK_BYTES, FAN_IN, SCORED_AT_ONCE = 16_000_000, 64, 1024
#: Parts of a bucket by the third context byte.
SPLITS = 4
STRINGS, TOKENS = 0, 1
_LOW40 = np.uint64((1 << 40) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys_of(buffer: bytes) -> np.ndarray:
    """For each byte from the sixth on: its five predecessors, the nearest highest, and the byte itself, as 48 bits."""
    if len(buffer) <= DEPTH:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    v = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (len(buffer) - DEPTH,), (1,))
    return ((v & _LOW40) << np.uint64(8)) | ((v >> np.uint64(40)) & np.uint64(255))


def text_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every byte of the texts and of their ends, and where each text's keys start."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    keys = keys_of(b"".join([PAD + t + b"\n" for t in texts]))
    starts = np.cumsum(sizes) - sizes
    if len(texts) > 1:  # keys of the padding between texts
        stay = np.ones(len(keys), bool)
        gaps = np.cumsum(sizes + DEPTH)[:-1] - DEPTH
        stay[(gaps[:, None] + np.arange(DEPTH)).ravel()] = False
        keys = keys[stay]
    return keys, starts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    near = ((keys >> np.uint64(32)) * _MIX) >> np.uint64(33)
    return (near % np.uint64(buckets)).astype(np.int64) * SPLITS + ((keys >> np.uint64(24)) & np.uint64(SPLITS - 1)).astype(np.int64)


def _log_gammas(size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    from math import lgamma

    return np.array([lgamma(n + 0.5) for n in range(size)]), np.array([lgamma(n + 1.0) for n in range(size)])


HALVES, WHOLES = _log_gammas()


def _log_gamma(table: np.ndarray, n: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    big = n >= len(table)
    if big.any():
        x = n[big] + plus
        out[big] = (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(HALVES, n0, 0.5) + _log_gamma(HALVES, n1, 0.5) - _log_gamma(WHOLES, n0 + n1, 1.0) - np.log(np.pi)


def stop_weight(log_own: np.ndarray, log_below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability, and the posterior share of its own estimate in it."""
    weighted = np.logaddexp(log_own, log_below) - np.log(2)
    return weighted, np.exp(log_own - np.log(2) - weighted)


def _parents(node: np.ndarray, j: int) -> np.ndarray:
    """Nodes of one depth less: the farthest context byte goes, the j bits decided so far stay."""
    bits = np.uint64((1 << j) - 1)
    return ((node >> np.uint64(j + 8)) << np.uint64(j)) | (node & bits)


def _gather(node: np.ndarray, *sums: np.ndarray):
    """Distinct nodes, where each came to, and the sums by node."""
    kept, place = np.unique(node, return_inverse=True)
    return kept, place, [np.bincount(place, s, len(kept)) for s in sums]


def subtree(keys: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, tuple, np.ndarray]:
    """One bit position in one bucket: the mixture of depths 3 to 5 for each key's own bit, the sums for depth 2, and each key's node there."""
    bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
    node = keys >> np.uint64(8 - j)
    node, at, (n, ones) = _gather(node, counts, counts * bit)
    below = log_kt((n - ones).astype(np.int64), ones.astype(np.int64))
    p = _estimate(n, ones, at, bit)
    for _ in range(DEPTH - 3):
        node, place, (n, ones, s) = _gather(_parents(node, j), n, ones, below)
        at = place[at]
        below, own = stop_weight(log_kt((n - ones).astype(np.int64), ones.astype(np.int64)), s)
        own = own[at]
        p = own * _estimate(n, ones, at, bit) + (1 - own) * p
    node, place, sums = _gather(_parents(node, j), n, ones, below)
    return p, (node, *sums), node[place[at]]


def _estimate(n: np.ndarray, ones: np.ndarray, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit == 1, ones[at], n[at] - ones[at]) + 0.5) / (n[at] + 1)


class Top:
    """Depths 0 to 2 of all trees: per bit position and node of depth 2 the line a * p + b that takes the mixture of the depths below to the whole one."""

    def __init__(self, rows: pa.Table):
        self.lines: list[tuple] = []
        at_j, node, n, ones, s = (rows[c].to_numpy() for c in ("j", "node", "n", "ones", "s"))
        for j in range(8):
            own = at_j == j
            order = np.argsort(node[own], kind="stable")
            k = node[own][order].astype(np.uint64)
            sums = [x[own][order] for x in (n, ones, s)]
            place = np.arange(len(k))
            a, b0, b1 = np.ones(len(k)), np.zeros(len(k)), np.zeros(len(k))
            here = k
            for depth in (2, 1, 0):
                total, one, below = sums
                below, stop = stop_weight(log_kt((total - one).astype(np.int64), one.astype(np.int64)), below)
                w, e1 = stop[place], ((one + 0.5) / (total + 1))[place]
                a, b0, b1 = (1 - w) * a, w * (1 - e1) + (1 - w) * b0, w * e1 + (1 - w) * b1
                if depth:
                    here, up, sums = _gather(_parents(here, j), total, one, below)
                    place = up[place]
            self.lines.append((k, a, b0, b1))

    def apply(self, j: int, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        k, a, b0, b1 = self.lines[j]
        i = np.searchsorted(k, node)
        return a[i] * p + np.where(bit == 1, b1[i], b0[i])


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 of the probability of each key's last byte after the five before it; ``keys`` are all of a bucket, sorted."""
    out = np.zeros(len(keys))
    for j in range(8):
        p, _, node = subtree(keys, counts, j)
        bit = ((keys >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
        out += np.log10(top.apply(j, node, bit, p))
    return out


def squeeze(numbers: np.ndarray) -> bytes:
    """64-bit integers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) + len(numbers).to_bytes(8, "little")


def unsqueeze(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[-8:], "little")
    planes = pa.decompress(data[:-8], decompressed_size=n * 8, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(kind).reshape(n)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def squeeze_names(names: list[bytes]) -> bytes:
    joined = b"\n".join(names)
    return pa.compress(joined, codec="zstd", asbytes=True) + len(joined).to_bytes(8, "little")


def unsqueeze_names(data: bytes) -> list[bytes]:
    return pa.decompress(data[:-8], decompressed_size=int.from_bytes(data[-8:], "little"), codec="zstd", asbytes=True).split(b"\n")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kept, place = np.unique(np.concatenate(keys), return_inverse=True)
    return kept, np.bincount(place, np.concatenate(counts), len(kept)).astype(np.int64)


PACKED = "kind int, bucket int, chunk int, keys binary, counts binary"


def _packed(rows: list[tuple]) -> pa.Table:
    kind, bucket, chunk, keys, counts = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "chunk": pa.array(chunk, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def _chunk_counts(docs: pa.Table, buckets: int) -> pa.Table:
    """The distinct strings and tokens of a chunk with their counts in its training texts, by bucket."""
    chunk = docs["chunk"][0].as_py()
    found, counted = [], []
    tokens: list[Counter] = [Counter(), Counter()]
    batch: list[bytes] = []
    flags: list[int] = []

    def strings() -> None:
        keys, starts = text_keys(batch)
        sizes = np.diff(np.append(starts, len(keys)))
        both = (keys << np.uint64(1)) | np.repeat(np.array(flags, np.uint64), sizes)
        both, n = np.unique(both, return_counts=True)
        found.append(both >> np.uint64(1))
        counted.append(np.where(both & np.uint64(1), 0, n))
        if len(found) > 4:
            found[:], counted[:] = ([x] for x in merged(found, counted))
        batch.clear()
        flags.clear()

    size = 0
    for text, held in zip(docs["text"], docs["held_out"].to_pylist(), strict=True):
        words = words_of(text.as_py())
        tokens[held].update(words)
        tokens[held][END_TOKEN] += 1
        batch.append(b" ".join(words))
        flags.append(int(held))
        size += len(batch[-1])
        if size > 4_000_000:
            strings()
            size = 0
    if batch:
        strings()
    rows = []
    keys, counts = merged(found, counted)
    where = bucket_of(keys, buckets)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(buckets * SPLITS + 1))
    for b in np.unique(where).tolist():
        part = order[edges[b] : edges[b + 1]]
        rows.append((STRINGS, b, chunk, squeeze_sorted(keys[part]), squeeze(counts[part])))
    by_bucket: dict[int, list[bytes]] = {}
    for t in tokens[0].keys() | tokens[1].keys():
        by_bucket.setdefault(crc32(t) % (buckets * SPLITS), []).append(t)
    for b, names in by_bucket.items():
        names.sort()
        rows.append((TOKENS, b, chunk, squeeze_names(names), squeeze(np.array([tokens[0][t] for t in names], np.int64))))
    return _packed(rows)


def _merge(rows: pa.Table) -> pa.Table:
    """Rows of one kind and bucket as one."""
    kind, bucket, group = (rows[c][0].as_py() for c in ("kind", "bucket", "group"))
    counts = [unsqueeze(c.as_py()) for c in rows["counts"]]
    if kind == STRINGS:
        keys, n = merged([unsqueeze_sorted(k.as_py()) for k in rows["keys"]], counts)
        return _packed([(kind, bucket, group, squeeze_sorted(keys), squeeze(n))])
    total: dict[bytes, int] = {}
    for k, c in zip(rows["keys"], counts, strict=True):
        for t, n in zip(unsqueeze_names(k.as_py()), c.tolist(), strict=True):
            total[t] = total.get(t, 0) + n
    names = sorted(total)
    return _packed([(kind, bucket, group, squeeze_names(names), squeeze(np.array([total[t] for t in names], np.int64)))])


def _top_rows(batches):
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            k, c = unsqueeze_sorted(keys.as_py()), unsqueeze(counts.as_py())
            for j in range(8):
                _, (node, n, ones, s), _ = subtree(k, c, j)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), j, np.int32)), pa.array(node.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(s)], names=["j", "node", "n", "ones", "s"])


def _totals(batches):
    for batch in batches:
        counts = [unsqueeze(c.as_py()) for c in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(int(c.sum()) for c in counts)]), pa.array([sum(int((c > 0).sum()) for c in counts)])], names=["n", "v"])


class Lookup:
    """Values of sorted distinct keys: one probe of a direct table, and a binary search for keys that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(12, min(23, int(len(keys) * 8).bit_length())))
        self.table = np.zeros(1 << int(64 - self.shift), np.int32)
        self.table[(keys * _MIX) >> self.shift] = np.arange(len(keys), dtype=np.int32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        i = self.table[(keys * _MIX) >> self.shift]
        wrong = np.flatnonzero(self.keys[i] != keys)
        i[wrong] = np.searchsorted(self.keys, keys[wrong])
        return self.values[i]


def score(docs: DataFrame, doc_id: str, text: str, held_out: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    The model learns from rows whose boolean ``held_out`` is false (null counts as false) and scores all. Scores are log10
    probabilities: ``score`` by the trees, ``base_score`` by add-one counts of tokens (the words and
    one end). Null texts count as empty. Texts of any length are whole; a chunk holds at
    least one. Without training rows every bit has probability 1/2. Results do not depend on how the rows are split.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(16, min(4096, chunks))
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    parts = cut(chunked.groupBy("chunk").applyInArrow(lambda t: _chunk_counts(t, buckets), PACKED))
    model, groups = parts, chunks
    while True:
        groups = -(-groups // FAN_IN)
        model = model.withColumn("group", (F.col("chunk") / FAN_IN).cast("int")).groupBy("kind", "bucket", "group").applyInArrow(_merge, PACKED)
        if groups == 1:
            break
    model = cut(model)
    totals = model.where(F.col("kind") == TOKENS).select("counts").mapInArrow(_totals, "n long, v long").agg(F.sum("n"), F.sum("v")).collect()[0]
    n_train, distinct = int(totals[0] or 0), int(totals[1] or 0)
    # at most 2^16 contexts of two bytes with 255 nodes each, whatever the input
    sums = model.where(F.col("kind") == STRINGS).select("keys", "counts").mapInArrow(_top_rows, "j int, node long, n long, ones long, s double")
    top = docs.sparkSession.sparkContext.broadcast(Top(sums.groupBy("j", "node").agg(*[F.sum(c).alias(c) for c in ("n", "ones", "s")]).toArrow()))
    scored_groups = -(-chunks // SCORED_AT_ONCE)
    offered = model.select("kind", "bucket", "keys", "counts", F.explode(F.sequence(F.lit(0), F.lit(scored_groups - 1))).alias("group"))
    asked = parts.withColumn("group", (F.col("chunk") / SCORED_AT_ONCE).cast("int"))

    def answer(whole: pa.Table, wanted: pa.Table) -> pa.Table:
        kind = wanted["kind"][0].as_py()
        counts = unsqueeze(whole["counts"][0].as_py())
        out = []
        if kind == STRINGS:
            keys = unsqueeze_sorted(whole["keys"][0].as_py())
            values = log_probabilities(keys, counts, top.value)
            for chunk, k in zip(wanted["chunk"].to_pylist(), wanted["keys"], strict=True):
                own = k.as_py()
                out.append((kind, 0, chunk, own, values[np.searchsorted(keys, unsqueeze_sorted(own))].astype(np.float32).tobytes()))
        else:
            known = dict(zip(unsqueeze_names(whole["keys"][0].as_py()), counts.tolist(), strict=True))
            for chunk, k in zip(wanted["chunk"].to_pylist(), wanted["keys"], strict=True):
                own = k.as_py()
                out.append((kind, 0, chunk, own, squeeze(np.array([known[t] for t in unsqueeze_names(own)], np.int64))))
        return _packed(out)

    answers = offered.groupBy("kind", "bucket", "group").cogroup(asked.groupBy("kind", "bucket", "group")).applyInArrow(answer, PACKED)
    kind_of_id = rows.schema["doc_id"].dataType
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    whole_numbers = ("n_tokens", "n_known", "train_tokens", "n_bytes")
    schema = T.StructType([T.StructField(n, kind_of_id if n == "doc_id" else T.BooleanType() if n == "held_out" else T.LongType() if n in whole_numbers else T.DoubleType()) for n in names])

    def finish(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, values, terms = [], [], {}
        unknown = -np.log10(float(n_train + distinct + 1))
        for kind, k, v in zip(known["kind"].to_pylist(), known["keys"], known["counts"], strict=True):
            if kind == STRINGS:
                keys.append(unsqueeze_sorted(k.as_py()))
                values.append(np.frombuffer(v.as_buffer(), np.float32))
            else:
                logs = np.log10(unsqueeze(v.as_py()) + 1.0) + unknown
                terms.update(zip(unsqueeze_names(k.as_py()), logs.tolist(), strict=True))
        keys, values = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(keys)
        look = Lookup(keys[order], values[order])
        out: dict[str, list] = {n: [] for n in names[2:]}
        batch: list[bytes] = []

        def strings() -> None:
            k, starts = text_keys(batch)
            out["score"] += np.add.reduceat(look(k).astype(np.float64), starts).tolist()
            out["n_bytes"] += np.diff(np.append(starts, len(k))).tolist()
            batch.clear()

        size = 0
        for x in texts["text"]:
            words = words_of(x.as_py())
            batch.append(b" ".join(words))
            words.append(END_TOKEN)
            each = [terms[w] for w in words]
            out["n_tokens"].append(len(words))
            out["n_known"].append(len(words) - each.count(unknown))
            out["base_score"].append(sum(each))
            size += len(batch[-1])
            if size > 4_000_000:
                strings()
                size = 0
        if batch:
            strings()
        out["train_tokens"] = [n_train] * len(texts)
        out["bits_per_byte"] = [-s * 3.321928094887362 / n for s, n in zip(out["score"], out["n_bytes"], strict=True)]
        return pa.table({"doc_id": texts["doc_id"], "held_out": texts["held_out"], **{n: pa.array(out[n], pa.int64() if n in whole_numbers else pa.float64()) for n in names[2:]}})

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
