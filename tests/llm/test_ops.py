"""Each operator against a brute-force version on small fixtures with nulls, empties, repeats and long texts."""

import hashlib
import html
import math
import random
import re
import struct
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parsimony.llm import bpe, cotrain, ctw, decontaminate, linededup, pii, queries, sharding, simhash, template, topk
from parsimony.llm.common import connected_components, words_of

PATH = f"{queries.TOKENIZERS}/word_bpe_49k.json"
TEXTS = [None, "", " \n\t", "word", "The cat sat on the mat.\nThe cat sat.", "The cat sat on the mat.\nThe cat sat.", "naïve CAFÉ x y", "a" * 30_000, "x y " * 9_000, "one two three four five six"]


def docs(spark, rows=None):
    rows = TEXTS if rows is None else rows
    data = [(i, t, "en", f"s{i % 3}", None, "clash") for i, t in enumerate(rows)] + [(None, "no id here at all", None, None, 3, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, keep string")


def empty(spark):
    return docs(spark).where("false")


def words(text):
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


# ---- 1 ------------------------------------------------------------------------------------


def naive_ctw(train, texts):
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    counts = {}
    bits = lambda x: [((256 | x) >> (8 - j), x >> (7 - j) & 1) for j in range(8)]
    for t in train:
        b = ctw.PAD + t + b"\n"
        for p in range(5, len(b)):
            for u, bit in bits(b[p]):
                for d in range(6):
                    counts.setdefault((b[p - d : p], u), [0, 0])[bit] += 1
    weighted, below = {}, Counter()
    for c, u in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[c, u])
        weighted[c, u] = own if len(c) == 5 else float(np.logaddexp(own, below[c, u])) - math.log(2)
        if c:
            below[c[1:], u] += weighted[c, u]

    def bit_of(ctx, u, bit):
        # the weighted probability of the node's bits with one more, over that without: an unseen node has probability 1
        def with_bit(d):
            k = (ctx[5 - d :], u)
            n = counts.get(k, [0, 0])
            own = kt(n[0] + (bit == 0), n[1] + (bit == 1))
            if d == 5:
                return own
            child = weighted.get((ctx[4 - d :], u), 0.0)
            return float(np.logaddexp(own, below.get(k, 0.0) - child + with_bit(d + 1))) - math.log(2)

        return math.exp(with_bit(0) - weighted.get((b"", u), 0.0))

    out = []
    for t in texts:
        b = ctw.PAD + t + b"\n"
        out.append(sum(math.log10(bit_of(b[p - 5 : p], u, bit)) for p in range(5, len(b)) for u, bit in bits(b[p])))
    return out


def test_ctw(spark):
    rows = ["the cat sat", "the mat sat on the cat", "", None, "A cat! naïve", "the cat sat", "zebra quux", "on the mat the cat"]
    df = docs(spark, rows).withColumn("held", F.col("doc_id").isin(6, 7))
    got = {r.doc_id: r for r in ctw.score(df, "doc_id", "text", "held", chunk_bytes=40).collect()}
    texts = {**dict(enumerate(rows)), None: "no id here at all"}
    plain = {i: b" ".join(words(t)) for i, t in texts.items()}
    want = dict(zip(plain, naive_ctw([t for i, t in plain.items() if i not in (6, 7)], list(plain.values())), strict=True))
    counts = Counter(w for i, t in texts.items() if i not in (6, 7) for w in [*words(t), b"END"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = [*words(t), b"END"]
        assert got[i].score == pytest.approx(want[i], rel=1e-5)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, i in (6, 7))


def test_ctw_sums_to_one(spark):
    """Over all 256 next bytes the model's probabilities sum to one."""
    text = b"abcab abd"
    keys, counts = np.unique(ctw.text_keys([text])[0], return_counts=True)
    ctx = b"b abd"
    every = np.unique(np.concatenate([keys, np.array([k for x in range(256) for k in ctw.keys_of(ctx + bytes([x]))], np.uint64)]))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, keys)] = counts
    import pyarrow as pa

    rows = [(j, node, n, ones, s) for j in range(8) for node, n, ones, s in zip(*ctw.subtree(every, full, j)[1], strict=True)]
    j, node, n, ones, s = zip(*rows, strict=True)
    top = ctw.Top(pa.table({"j": j, "node": [int(x) for x in node], "n": [int(x) for x in n], "ones": [int(x) for x in ones], "s": s}))
    p = 10 ** ctw.log_probabilities(every, full, top)
    assert p[np.isin(every, [k for x in range(256) for k in ctw.keys_of(ctx + bytes([x]))])].sum() == pytest.approx(1.0)


def test_ctw_rows(spark):
    """Repeated rows and ids, a very long text and clashing columns."""
    rows = ["ab ab ab ba " * 20_000, "ab ba", "ab ba", "x"]
    df = docs(spark, rows).withColumn("held", F.lit(False)).withColumns({n: F.lit("clash") for n in ("score", "chunk", "kind", "n_bytes")})
    got = ctw.score(df.union(df), "doc_id", "text", "held", chunk_bytes=100_000).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.score, r.n_bytes))
    assert len(got) == 10 and all(len(v) == 1 for v in by.values()) and by[1] == by[2]
    assert by[0].pop()[1] == len(rows[0])


def test_ctw_empty(spark):
    assert ctw.score(empty(spark).withColumn("held", F.lit(False)), "doc_id", "text", "held").count() == 0


# ---- 2 ------------------------------------------------------------------------------------


def naive_fingerprint(text, k):
    w = words(text)
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def naive_components(values, near):
    label = {i: i for i in range(len(values))}
    changed = True
    while changed:
        changed = False
        for i in label:
            for j in label:
                if near(values[i], values[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprint():
    for t in TEXTS:
        for k in (1, 4, 5):
            assert simhash.fingerprint_of(t, k) == naive_fingerprint(t, k)


def test_near_duplicates(spark):
    got = simhash.near_duplicates(docs(spark), "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 1
    fps = [naive_fingerprint(t, 4) for t in TEXTS]
    want = naive_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (1 << 64) - 1, r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert next(r for r in got if r.doc_id is None).component_id is None
    assert simhash.near_duplicates(empty(spark), "doc_id", "text").count() == 0
    clash = simhash.near_duplicates(docs(spark).withColumns({"component_id": F.lit("x"), "fp": F.lit("y"), "n": F.lit("kept")}), "doc_id", "text")
    assert clash.columns.count("component_id") == 1 and clash.columns.count("fp") == 1
    assert {(r.doc_id, r.fp, r.component_id, r.n) for r in clash.collect()} == {(r.doc_id, r.fp, r.component_id, "kept") for r in got}


def test_hot_fingerprint(spark):
    """A third of all rows in one group: its key is broadcast, the others are joined."""
    got = simhash.near_duplicates(docs(spark, ["same text"] * 900 + [f"w{i} x{i} y{i} z{i} a{i}" for i in range(40)]), "doc_id", "text").collect()
    assert len(got) == 941 and {r.component_id for r in got if r.doc_id is not None and r.doc_id < 900} == {0}


@pytest.mark.parametrize("tile", [8, 10_000])
def test_links(spark, tile):
    """Random clusters of fingerprints: hot keys in tiles and plain joins both give all components."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:12]:
        for _ in range(25):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(s, s) for s in signed], "id long, fp long")
    found = {r.node: r.label for r in connected_components(simhash.links(nodes, 4, tile=tile)).collect()}
    want = naive_components(values, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = Counter()
    for i, s in enumerate(signed):
        groups[found.get(s, s), want[i]] += 1
    assert len({a for a, _ in groups}) == len({b for _, b in groups}) == len(groups)


def test_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near = base.copy()
    near[50] = "changed"
    far = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    df = docs(spark, [" ".join(base), " ".join(near), " ".join(far), " ".join(base), None, ""])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df, "doc_id", "text").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4, None: None}
    assert simhash.near_copies(empty(spark), "doc_id", "text").count() == 0


def shingle_set(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def alike_groups(texts, percent=80):
    """Smallest position of each text's group, from the plain cosine similarities of the shingle sets of all pairs."""
    sets = [shingle_set(t) for t in texts]
    return naive_components(sets, lambda a, b: len(a & b) ** 2 * 10_000 >= percent**2 * len(a) * len(b))


@pytest.mark.parametrize("tile", [2, 10_000])
def test_near_copies_between_unlike(spark, tile):
    """Groups whose texts a third text with the same fingerprint, but other five-word shingles, lies between."""
    rng, texts = random.Random(8), []
    for _ in range(6):
        a, b = [f"w{rng.randrange(10**6)}" for _ in range(2)]
        base = [a, b] * 60
        for k in range(6):
            texts.append(" ".join([*base, *[f"x{k % 2}{i}" for i in range(4 + k)]]))
    far = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(100)) for _ in range(5)]
    texts += far + [f"{t} y{i}" for i, t in enumerate(far)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, texts), "doc_id", "text", few=tile, tile=tile).collect()}
    assert {i: got[i] for i in range(len(texts))} == alike_groups(texts)


@pytest.mark.parametrize("tile", [7, 512])
def test_near_copies_in_a_large_group(spark, tile):
    """Many variants of one text, with keys in tiles smaller than the group, and the same keys pair by pair."""
    rng, texts = random.Random(9), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for _ in range(60):
        w = base.copy()
        for i in rng.sample(range(120), rng.randint(1, 9)):
            w[i] = f"s{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, texts), "doc_id", "text", few=4, tile=tile).collect()}
    assert {i: got[i] for i in range(len(texts))} == alike_groups(texts)


def test_tile_copies():
    """A text within the fingerprint distance of all others and like none joins nothing; the others are joined."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 100)
    sets = [rng.integers(0, 1 << 60, 100), *[np.concatenate((base[:95], rng.integers(0, 1 << 60, 5))) for _ in range(6)]]
    every = np.arange(len(sets))
    a, b = simhash.tile_copies(sets, every.copy(), every, every, 80)
    assert len(a) == 5 and 0 not in a + b
    assert simhash.tile_copies(sets, np.zeros(7, int), every, every, 80) == ([], [])


def edited(rng, text, kind, share):
    """A copy with words appended, cut from the end or substituted."""
    w = text.split()
    k = round(len(w) * share)
    if kind == "appended":
        return " ".join([*w, *[f"a{rng.randrange(10**6)}" for _ in range(k)]])
    if kind == "cut":
        return " ".join(w[: len(w) - k])
    for i in rng.sample(range(len(w)), max(1, k // 6)):
        w[i] = f"s{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_recall(spark):
    """Copies of a similarity of 0.8 or more are found, with no filter of fingerprints in the brute force."""
    rng, texts = random.Random(11), []
    for k in range(45):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 400)))
        kind = ("appended", "cut", "substituted")[k % 3]
        texts += [base, edited(rng, base, kind, rng.uniform(0.05, {"appended": 0.54, "cut": 0.35, "substituted": 0.24}[kind]))]
    far = [k for k in range(0, len(texts), 2) if (simhash.majority(simhash.shingle_set(texts[k])) ^ simhash.majority(simhash.shingle_set(texts[k + 1]))).bit_count() > 4]
    want = alike_groups(texts)
    assert any(want[k + 1] == k for k in far)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, texts), "doc_id", "text").collect()}
    assert {i: got[i] for i in range(len(texts))} == want


def test_near_copies_repeats(spark):
    """Passages that repeat: the sets are alike, the numbers of words are not."""
    rng = random.Random(12)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    texts = [" ".join([passage] * n) for n in (1, 2, 3, 4)]
    assert [len(simhash.shingle_set(t)) for t in texts] == [len(shingle_set(t)) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, texts), "doc_id", "text").collect()}
    assert {i: got[i] for i in range(4)} == dict.fromkeys(range(4), 0)


def test_allot():
    assert simhash.allot([[0, 5, 9], [0, 1, 50], [0, 2, 3]], 1)[0] == min(a + b + c for i, a in enumerate([0, 5, 9]) for j, b in enumerate([0, 1, 50]) for k, c in enumerate([0, 2, 3]) if i + j + k - 3 == 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and all(got[201 + i] == 200 for i in range(30))


# ---- 3 ------------------------------------------------------------------------------------


def test_matrix():
    m = sharding.matrix([5, 0, 100, 7], [28, 28, 28, 28], 1)
    assert m.sum(axis=0).tolist() == [28] * 4 and m.sum(axis=1).tolist() == [5, 0, 100, 7]


@pytest.mark.parametrize("size", [0, 1, 39, 1003])
def test_sharding(spark, size):
    df = spark.range(size).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("clash"))
    rows = sharding.shard(df, ["doc_id"], 40, rows_per_block=10).collect()
    assert len(rows) == size and sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((r.doc_id is None, r.doc_id) for r in df.collect())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == size


def test_hypergeometric():
    """Shares of draws against exact probabilities, and margins beyond 10^9 rows."""
    rng = np.random.default_rng(3)
    for good, bad, drawn in ((5, 9, 6), (30, 4, 10), (1, 1, 1), (0, 5, 3), (7, 0, 2)):
        got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(20_000))
        for k in range(max(0, drawn - bad), min(good, drawn) + 1):
            p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
            assert abs(got[k] / 20_000 - p) < 0.02
    sizes, counts = [30_000_000] * 40, [400_000_000, 0, 799_999_999, 1]
    m = sharding.matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes
    assert abs(m[0] - 10_000_000).max() < 6 * (400_000_000 / 40 * 2 / 3) ** 0.5
    many = [sharding.hypergeometric(rng, 10**12, 39 * 10**12, 100_000) for _ in range(2000)]
    assert abs(np.mean(many) - 2500) < 6 and 45 < np.std(many) < 53


def test_sharding_groups_and_clashes(spark):
    """Blocks drawn group by group, columns with the names of helpers, repeated rows and nulls."""
    df = spark.range(900).select(F.col("id").alias("doc_id"), *[F.lit(None).cast("string").alias(n) for n in ("start", "shard", "slot", "part", "block", "cuts", "rank", "n")])
    df = df.union(df.where("doc_id < 40")).union(df.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard(df, ["doc_id"], 7, rows_per_block=20, groups=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 941 and {len(x) for x in by.values()} == {134, 135} and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert set(rows[0].asDict()) == {"doc_id", "start", "shard", "slot", "part", "block", "cuts", "rank", "n"}


def test_sharding_spreads(spark):
    """Every tenth of the input falls into all shards about evenly, and a second run gives the same."""
    rows = sharding.shard(spark.range(8000).withColumnRenamed("id", "doc_id"), ["doc_id"], 8, rows_per_block=500).collect()
    again = sharding.shard(spark.range(8000).repartition(7).withColumnRenamed("id", "doc_id"), ["doc_id"], 8, rows_per_block=500).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == {r.doc_id: (r.shard, r.slot) for r in again}
    cells = Counter((r.doc_id // 800, r.shard) for r in rows)
    assert sum((n - 100) ** 2 / 100 for n in (cells[i, j] for i in range(10) for j in range(8))) < 120


# ---- 4 ------------------------------------------------------------------------------------


def test_cotrain(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [*w, rng.choice(["idiot", "moron"])]
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, 0 if bad and i % 8 else 1, 1 if bad and not i % 8 else 0))
    df = docs(spark, texts)
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = cotrain.train(df, known, "doc_id", "text", ["lang", "source", "n_chars"])
    got = {r.doc_id: r for r in cotrain.score(df, "text", ["lang", "source", "n_chars"], model).collect()}
    right = [got[i].keep == (q == 1 and t == 0) for i, q, t in labels if i % 3 == 0]
    assert len(got) == 601 and sum(right) / len(right) > 0.93
    assert cotrain.score(empty(spark), "text", ["lang"], model).count() == 0
    none = cotrain.train(empty(spark), known.where("false"), "doc_id", "text", ["lang", "source", "n_chars"])
    assert all(r.keep for r in cotrain.score(docs(spark), "text", ["lang", "source", "n_chars"], none).collect())
    # repeated ids, clashing names and the order of rows change nothing in the fit
    twice = df.union(df.where("doc_id < 300")).withColumns({n: F.lit("clash") for n in ("y", "o", "h", "id", "words")})
    again = [cotrain.train(x, known, "doc_id", "text", ["lang", "source", "n_chars"], rounds=0) for x in (twice, twice.orderBy(F.desc("doc_id")))]
    assert np.array_equal(again[0].views[0].base.words, again[1].views[0].base.words) and np.array_equal(again[0].views[0].base.words, model.views[0].base.words)
    long = docs(spark, ["word " * 200_000, None, ""])
    assert cotrain.score(long, "text", ["lang", "source", "n_chars"], model).count() == 4


def test_packed():
    for w in ([], [0], [cotrain.BUCKETS - 1], sorted(random.Random(1).sample(range(cotrain.BUCKETS), 700))):
        assert cotrain.unpacked(cotrain.packed(np.array(w, np.int32))).tolist() == w


def test_sure_documents_teach():
    """Every unlabelled document counts: what one view is sure of gives the other view's features their log-odds."""
    rng = np.random.default_rng(4)
    model = cotrain.Model(fitted=True)
    model.views[1].base.words[7] = -50.0
    model.views[1].scale = np.array([1.0, 4.0, 0.0, 0.0])
    words = [np.array([1, 2] if i % 2 else [1, 3], np.int32) for i in range(400)]
    meta = [np.array([5] if i % 2 else [7], np.int32) for i in range(400)]
    counts = [np.zeros((3, w + 1), np.int64) for w in (cotrain.BUCKETS, cotrain.META_BUCKETS)]
    cotrain.sure_counts(model, words, meta, rng.random((400, cotrain.STYLE)), counts)
    assert counts[0][:, -1].tolist() == [400, 200, 200] and counts[0][:, [1, 2, 3]].tolist() == [[400, 200, 200], [200, 200, 0], [200, 0, 200]]
    taught = cotrain.log_odds(counts[0])
    assert taught[0, 2] > 0.5 > -0.5 > taught[0, 3] and taught[1, 3] > 0.5 > -0.5 > taught[1, 2] and abs(taught[:, 1]).max() < 0.1
    assert cotrain.taught_features([words[0], words[1]], taught)[0, 1] > 0.2


def test_co_training_helps_with_few_labels():
    """With labels for few words, what the metadata view is sure of teaches the text view the others."""
    rng = np.random.default_rng(5)

    def row(bad):
        topic = rng.choice(np.arange(100, 400) if bad else np.arange(500, 800), 6, replace=False)
        return np.unique(np.concatenate([topic, rng.choice(100, 10)])).astype(np.int32), np.array([7 if bad else 8], np.int32), np.zeros(cotrain.STYLE), float(not bad)
    labelled, pool = [row(rng.random() < 0.5) for _ in range(200)], [row(i % 2) for i in range(3000)]
    column = lambda rows, i: [r[i] for r in rows]
    none = [np.zeros((2, w), np.float32) for w in (cotrain.BUCKETS, cotrain.META_BUCKETS)]
    before = cotrain.fit_views(labelled, none, None)
    counts = [np.zeros((3, w + 1), np.int64) for w in (cotrain.BUCKETS, cotrain.META_BUCKETS)]
    cotrain.sure_counts(before, column(pool, 0), column(pool, 1), np.array(column(pool, 2)), counts, sure=0.9)
    after = cotrain.fit_views(labelled, [cotrain.log_odds(c) for c in counts], before)
    fresh = [row(i % 2) for i in range(600)]
    right = [np.mean((m.logits(column(fresh, 0), column(fresh, 1), np.array(column(fresh, 2)))[0] > 0) == np.array(column(fresh, 3))) for m in (before, after)]
    assert right[0] < 0.8 and right[1] > 0.95


# ---- 5 ------------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><header>Site</header><nav><ul><li><a href='/x'>Home</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><!-- ad {i} --><div class=\"ad\">Buy {i}</div><article><h1>{t} &amp; co</h1><p>First <b>bold</b>&nbsp;text\n of {i}.<br>More.</p><aside>See also</aside>"
    "<p>Second &lt;one&gt; {i}</p><form><input><button>Go</button></form><section id=comments><p>I disagree</p></section></article><div class='sidebar'>Links</div><footer>&copy; all</footer></body></html>"
)


def test_template(spark):
    rows = [(i, f"https://a.example.com/{i}?x=http://b.c/", PAGE.format(i=i, t=f"Title {i}")) for i in range(6)]
    rows += [(6, "nonsense", "<p>Loose <i>text</i><p>Two"), (7, None, None), (8, "http://a.example.com/8", ""), (9, "http://a.example.com/9", "<article><p>cut off here <b>and"), (None, "http://x/", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = {r.page_id: r for r in template.extract_all(df, "page_id", "url", "html").collect()}
    for i in range(6):
        assert got[i].text == f"Title {i} & co\nFirst bold text of {i}. More.\nSecond <one> {i}"
        assert got[i].n_chars == len(got[i].text)
    assert got[6].text == "Loose text\nTwo" and got[7].text == "" and got[8].text == "" and got[9].text == "cut off here and" and got[None].text == "plain"
    assert template.extract_all(df.where("false"), "page_id", "url", "html").count() == 0


def test_template_on_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op5_template(spark, sf_dir).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def naive_classes(pages, support=template.SUPPORT, least=template.LEAST_PAGES):
    """Valid classes by whole occurrence vectors: the sets of their tokens, those that stand once a page and those that repeat."""
    counts = [Counter(t for *_, t in template.placed(p) if t) for p in pages]
    tags = {t for p in pages for kind, _, _, t in template.placed(p) if kind != "text"}
    by = {}
    for t in set().union(*counts):
        vector = tuple(c[t] for c in counts)
        if sum(map(bool, vector)) >= max(least, support * len(pages)):
            by.setdefault(vector, set()).add(t)
    valid = [(v, c) for v, c in by.items() if len(c) > 1 and c & tags]
    return {frozenset(c) for v, c in valid if max(v) == 1}, {frozenset(c) for v, c in valid if max(v) > 1}


NESTED = (
    "<html><body><div class='top'>Site {i}</div><div class=x><div class=body><h1>Title {i}</h1><div class='post-header'><h2>Part {i}</h2></div><p>Own text {i} that is long enough to be most of what the page says.</p>"
    "<div class=box>All rights kept</div>{list}</div></div><div class=more>Read also {i}</div></body></html>"
)


def nested(i):
    return NESTED.format(i=i, list="".join(f"<div class=entry><h3>Entry</h3><p><u>No.</u> item {i} {k}</p></div>" for k in range(1 + i % 3)))


def test_equivalence_classes(spark):
    for made in ([PAGE.format(i=i, t=i) for i in range(4)], [nested(i) for i in range(9)]):
        rows = [("h", i, p) for i, p in enumerate(made)]
        r = template.templates(spark.createDataFrame(rows, "host string, page_id int, html string"), "page_id", "html").first()
        by = {}
        for t, c in zip(r.tokens, r.classes, strict=True):
            by.setdefault(c, set()).add(t)
        once, repeated = naive_classes(made)
        assert {frozenset(v) for c, v in by.items() if c > 0} == once and {frozenset(v) for c, v in by.items() if c < 0} == repeated
        order = [t for *_, t in template.placed(made[0])]
        for c in by:
            if c > 0:
                own = [t for t, k in zip(r.tokens, r.classes, strict=True) if k == c]
                assert own == [t for t in order if t in by[c]]


def test_template_decides(spark):
    """Pages without an article element: the skeleton's slots hold the text; constant text and a nested class's labels are the template's."""
    pages = spark.createDataFrame([(i, "https://h.example.com/", nested(i)) for i in range(9)], "page_id long, url string, html string")
    for tokens in (10**6, 0):
        got = {r.page_id: r.text for r in template.extract_all(pages, "page_id", "url", "html", tokens=tokens).collect()}
        for i in range(9):
            assert got[i] == "\n".join([f"Title {i}", f"Part {i}", f"Own text {i} that is long enough to be most of what the page says.", *[f"No. item {i} {k}" for k in range(1 + i % 3)]])
    assert "Read also 3" in template.extract(nested(3)) and "Entry" in template.extract(nested(3))
    # a page that breaks the order of the skeleton is read without it
    page = nested(1).replace("<div class=x>", "").replace("<div class='top'>Site 1</div>", "") + "<div class=x>"
    assert "Read also 1" in template.extract(page, template.Template([template.placed(nested(1))[k][3] for k in (0, 1, 2)], [1, 1, 1]))


def test_headings_and_long_pages():
    assert template.extract("<article><div class='post-header'><h1>Title</h1></div><p>Body</p><div class=related>See</div></article>") == "Title\nBody\nSee"
    import time

    for page in ("<div><p>a</section>", "<div>", "<article><nav>", "</div>a", "<b>x"):
        took = []
        for n in (4_000, 16_000):
            start = time.process_time()
            template.extract(page * n)
            took.append(time.process_time() - start)
        assert took[1] < 10 * took[0] + 0.5, page


# ---- 6, 8 -----------------------------------------------------------------------------------


def test_linededup(spark):
    line, rare = "this line stands everywhere", "this line stands on two sites"
    rows = [f"{line}\nown {i} text of some length\n{rare if i < 2 else 'x'}\n{line}\n" for i in range(6)] + [None, "", "short\nshort", "k" * 50_000]
    got = {r.doc_id: r for r in linededup.dedup(docs(spark, rows), "doc_id", "text", "source").collect()}
    assert got[0].text == f"{line}\nown 0 text of some length\n{rare}\n" and got[0].n_removed == 1
    assert got[3].text == "own 3 text of some length\nx\n" and (got[3].n_lines, got[3].n_removed) == (5, 2)
    assert got[1].text.count(rare) == 1 and got[6].text is None and got[6].n_lines == 0 and got[7].text == "" and got[8].text == "short\nshort" and len(got[9].text) == 50_000
    assert linededup.dedup(empty(spark), "doc_id", "text", "source").count() == 0
    # repeated rows, ids that repeat with other texts, and columns with the names of helpers
    twice = docs(spark, rows).withColumns({n: F.lit("clash") for n in ("gone", "_gone", "row", "doc", "row_", "n_lines", "h1")})
    again = linededup.dedup(twice.union(twice), "doc_id", "text", "source").collect()
    assert len(again) == 2 * len(got) and {(r.doc_id, r.text, r.n_removed, r.gone, r.row, r.doc, r.h1) for r in again} == {(r.doc_id, r.text, r.n_removed, *["clash"] * 4) for r in got.values()}
    other = spark.createDataFrame([(1, line, f"s{i}") for i in range(4)] + [(1, f"{line}\nx", "s9")], "doc_id long, text string, source string")
    assert sorted(r.text for r in linededup.dedup(other, "doc_id", "text", "source").collect()) in ([*[line] * 4, "x"], [*[""] * 4, f"{line}\nx"])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, sf_dir, same, name):
    assert same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.SQL[name]).df())


def test_decontaminate(spark):
    rng = random.Random(2)
    item = [f"w{i}" for i in range(30)]
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    whole, most, some = noise(5000) + item + noise(5000), noise(20) + item[:28] + noise(20), item[:12] + noise(9)
    df = docs(spark, [" ".join(whole), "\n".join(most).upper(), " ".join(some), None, "", "tiny item", "x"])
    items = spark.createDataFrame([(1, " ".join(item)), (2, "Tiny item"), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(df, items, "doc_id", "text", "item_id", "text").collect()}
    assert got == {(0, 1), (1, 1), (5, 2)}
    clash = df.withColumns({n: F.lit("clash") for n in ("row", "own", "doc", "items", "item", "h", "need")})
    assert {(r.doc_id, r.row, r.own) for r in decontaminate.remove(clash.union(clash), items, "doc_id", "text", "item_id", "text").collect()} == {(i, "clash", "clash") for i in (2, 3, 4, 6, None)}
    assert decontaminate.contained(clash.union(clash), items.where("item_id = 2"), "doc_id", "text", "item_id", "text").count() == 2
    assert {r.doc_id for r in decontaminate.remove(df, items, "doc_id", "text", "item_id", "text").collect()} == {2, 3, 4, 6, None}
    assert decontaminate.contained(df, items.where("false"), "doc_id", "text", "item_id", "text").count() == 0
    assert decontaminate.contained(empty(spark), items, "doc_id", "text", "item_id", "text").count() == 0


@pytest.mark.parametrize("rows", [10**6, 0])
def test_containment_of_every_size(spark, rows, monkeypatch):
    """Items of 1 to 200 words with words left out: whole or near, against brute force, broadcast and shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", rows)
    rng = random.Random(5)
    items, texts = [], []
    for k in range(40):
        w = [f"w{rng.randrange(50 if k % 4 == 0 else 10**6)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 15, 40, 200]))]
        items.append((k, " ".join(w)))
        v = w.copy()
        for _ in range(rng.choice([0, 1, 1, len(w) // 20, len(w) // 8])):
            v[rng.randrange(len(v))] = "changed"
        texts.append(" ".join(v) if k % 5 == 0 else " ".join([f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(300))] + v + ["end"]))
    sets, wanted = [shingle_set(t) for t in texts], [shingle_set(t) for _, t in items]
    want = {(i, k) for i, s in enumerate(sets) for k, w in enumerate(wanted) if len(s & w) * 100 >= len(w) * 80}
    got = decontaminate.contained(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 15


# ---- 7 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_equals_library(tokenizer):
    from pathlib import Path

    own = bpe.ForcedBoundaryBPE(Path(PATH).read_text(encoding="utf-8"))
    rng = random.Random(9)
    odd = "aAbB  \n\t\x0b\x1c\x1f\x85  'sSTll12٣½ßİΣςññéÉ漢字ｱ😀👍🏽.,!?-_<|>|endoftext|‍̀﻿ẞǅﬁ"
    texts = [t or "" for t in TEXTS] + ["a<|endoftext|>b <|startoftext|><|endoftext|", "it's we'll I'VE ΑΣ Σ", "the" * 5000]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        got, decoded = own.encode(t)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, repr(t)
        assert decoded.decode() == tokenizer.decode(ids, skip_special_tokens=False) == own.decode(got)


def test_bpe_frame(spark, tokenizer):
    from pathlib import Path

    got = {r.doc_id: r for r in bpe.encode(docs(spark), "text", Path(PATH).read_text(encoding="utf-8")).collect()}
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode(empty(spark), "text", Path(PATH).read_text(encoding="utf-8")).count() == 0


# ---- 9 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [64, 2**40])
def test_topk(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 32)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(150, 24)).astype(np.float32) / 4
    vectors[10:14] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 24), (None, [0.5] * 24), (5, vectors[5].tolist()), (20, vectors[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, "vec_id", "embedding", k=7, scale=scale).collect())
    ints = [[math.floor(scale * float(x)) for x in v] for v in vectors]
    want = []
    for q in range(0, 150, 20):
        score = lambda c: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ints[q], c, strict=True))))
        scores = sorted((-score(c), i) for i, c in [*enumerate(ints), (5, ints[5]), (20, ints[20])] if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:7])]
    assert got == want
    assert len(got) == len(want) and topk.top_k(df.where("false"), "vec_id", "embedding").count() == 0


def test_topk_beyond_64_bits(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_topk_prunes():
    """Pairs that cannot reach the best any more are dropped before the last dimension, and the result is exact."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    data = np.floor(24 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) / 4)).astype(np.int64)
    ids = np.arange(4000)
    best = topk.Best(ids[:50], 20)
    left = [topk.search(best, data[:50].T, data[k : k + 1000].T, ids[k : k + 1000]) for k in range(0, 4000, 1000)]
    assert max(left[1:]) < 0.25 * 50 * 1000
    whole = data[:50] @ data.T
    for q in range(50):
        want = sorted((-whole[q, i], i) for i in range(4000) if i != q)[:20]
        assert [(-s, i) for s, i in zip(*map(list, best.lists[q]), strict=True)] == want


# ---- 10 -------------------------------------------------------------------------------------

SAMPLES = [
    None, "", "mail a.b+c@x-y.example.com, or @no.de or a@b or x@y.z@w.vv", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255", "4111 1111 1111 1111 and 4111111111111112 or 4111-1111-1111-1111-4",
    "+1 (269) 555-3296 +12 +123456789012345678 call +44 20 7946 0958. again", "é 7 é user@host.org 10.0.0.1 " * 50, "9" * 20_000, "a" * 20_000 + "@", "@" * 5000, "1." * 9000,
]


def naive_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(11)
    texts = [t for t in SAMPLES if t and len(t) < 5000] + ["".join(rng.choice("a@.+-( )0123456789é_") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t) == naive_spans(t), repr(t)
    for t in SAMPLES:
        pii.base_spans(t or "")  # long runs end soon


def test_detect(spark):
    df = docs(spark, SAMPLES + [f"call +1 (269) 555-{1000 + i} or mail q{i}@x.example.com at 10.0.{i}.1 with 4111111111111111 v{i} on day {i}" for i in range(80)])
    field = pii.train(df, "text")
    got = {r.doc_id: r for r in pii.detect(df, "text", field).collect()}
    for i, t in enumerate(SAMPLES):
        base = naive_spans(t) if t and len(t) < 15_000 else pii.base_spans(t or "")
        assert got[i].base == pii.joined(base) and got[i].n_email == sum(k == 0 for k, *_ in base)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert pii.detect(empty(spark), "text", field).count() == 0
    assert pii.train(empty(spark), "text").unary.shape == (pii.FEATURES, pii.LABELS)


def mentions(n, seed):
    """Texts with a number or address and a shorter mention of it, and as many with a mention of nothing; (text, span to be added or None)."""
    rng, out = random.Random(seed), []
    for i in range(n):
        word = lambda k: " ".join(rng.choice(["the", "call", "was", "or", "note", "and"]) for _ in range(k))
        a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
        box = f"{rng.choice('abcdef')}{rng.choice('xyz')}.{rng.randrange(999)}"
        whole, form = (f"+1 ({a}) {b}-{c}", rng.choice([f"{a}{b}{c}", f"{a}-{b}-{c}", f"{b}-{c}"])) if i % 2 else (f"{box}@mail{rng.randrange(9)}.example.com", f"{box}@mail")
        if i % 4 >= 2:
            form = pii.unlike(form, rng.getrandbits(60))
        text = f"{word(9)} {whole} {word(rng.randint(5, 200))} "
        out.append((text + form + " " + word(4), None if i % 4 >= 2 else (3 if i % 2 else 0, len(text), len(text) + len(form))))
    return out


def test_skip_links_decide():
    """A mention that no pattern proves is added because of what it repeats: with the skip links, and not without them."""
    field = pii.fit(*pii.counted([pii.example(t, i * 7919) for i, (t, _) in enumerate(mentions(600, 1))]))
    blind = pii.Field(field.unary, field.near, np.zeros_like(field.far))
    held = mentions(400, 2)
    found = {}
    for name, f in (("all", field), ("blind", blind)):
        got = [pii.added(t, pii.base_spans(t), f) for t, _ in held]
        hits = sum(want in g for g, (_, want) in zip(got, held, strict=True) if want)
        found[name] = hits / 200, sum(map(len, got)) - hits
    assert found["all"][0] > 0.9 and found["all"][1] <= 4
    assert found["blind"][0] < 0.1


def test_neighbours_are_one_span():
    text = "x +1 (826) 555-4081 190.137.223.204 y"
    field = pii.fit(*pii.counted([pii.example(t, i) for i, (t, _) in enumerate(mentions(600, 1))] + [pii.example(f"at 10.2.{i}.4 and +1 ({200 + i}) 555-1{i}", 3 + i) for i in range(100, 200)]))
    spans = pii.added(text, pii.base_spans(text), field)
    assert spans in ([], [(3, 2, 19)])


def test_messages_exact_on_trees():
    """On a chain loopy messages give the exact marginals."""
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS,) * 2), rng.normal(size=(pii.LABELS,) * 2))
    feats = [pii.features(t) for t in ("a1", "+1", "x@y.z", "123")]
    near, far = [(0, 1), (1, 2)], [(2, 3)]
    got = field.marginals(feats, [0] * 4, near, far, rounds=200)
    local = field.unary[np.array(feats)].sum(axis=1)
    total = local[0][:, None, None, None] + local[1][None, :, None, None] + local[2][None, None, :, None] + local[3]
    total = total + field.near[:, :, None, None] + field.near[None, :, :, None] + field.far[None, None]
    p = np.exp(total - total.max())
    p /= p.sum()
    want = np.stack([p.sum(axis=tuple(a for a in range(4) if a != i)) for i in range(4)])
    assert np.allclose(got, want, atol=2e-3)


def test_words():
    for t in TEXTS:
        assert words_of(t) == words(t)
