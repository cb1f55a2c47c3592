"""The pipeline's stages on the small tables, each against a brute-force version on its own input."""

import hashlib
import struct
from collections import defaultdict

import corpus_pipeline as pipeline

from parsimony.llm import queries
from parsimony.llm.common import table, words_of


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def brute_lines(docs):
    """Texts after line dedup; None for documents that go."""
    sites, first = defaultdict(set), {}
    for i, r in sorted(docs.items()):
        for k, line in enumerate(r.text.split("\n")):
            if len(key := line.strip(" ")) >= 16:
                sites[key].add(r.source)
                first.setdefault(key, (i, k))
    out = {}
    for i, r in docs.items():
        lines = r.text.split("\n")
        kept = [x for k, x in enumerate(lines) if len(sites[x.strip(" ")]) < 3 or first[x.strip(" ")] == (i, k)]
        out[i] = "\n".join(kept) if len(kept) == len(lines) or "".join(kept).strip(" ") else None
    return out


def shingle_set(text, n=5):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(docs):
    """Smallest id of each document's group: texts whose sets of five-word shingles have a cosine similarity of 0.8 or more."""
    ids = sorted(docs)
    sets = {i: shingle_set(docs[i].text) for i in ids}
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) ** 2 * 100 >= 64 * len(sets[a]) * len(sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in ids}


def test_stages(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in table(spark, sf_dir, "labels").collect()}
    items = [shingle_set(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    names, seen = docs.columns, [rows_of(docs)]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == len(pipeline.STAGES) - 1 or docs.columns == names
        seen.append(rows_of(docs))
    raw, good, clean, single, free, coded = seen
    assert sum((i in good) == y for i, y in labels.items()) / len(labels) > 0.85
    assert all(good[i] == raw[i] for i in good)
    assert {i: r.text for i, r in clean.items()} == {i: t for i, t in brute_lines(good).items() if t is not None}
    assert set(single) == {i for i, low in brute_groups(clean).items() if i == low}
    leaks = {i for i, r in single.items() if any(len(s & shingle_set(r.text)) >= 0.8 * len(s) for s in items if s)}
    assert set(free) == set(single) - leaks
    tokenizer = Tokenizer.from_file(f"{queries.TOKENIZERS}/word_bpe_49k.json")
    assert set(coded) == set(free)
    for i, r in coded.items():
        ids = tokenizer.encode(free[i].text, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r.n_tokens == len(ids)


def test_run(spark, sf_dir):
    assert 0 < pipeline.run(spark, sf_dir).count() < table(spark, sf_dir, "documents").count()


def test_stages_on_nothing(spark, sf_dir):
    nothing = table(spark, sf_dir, "documents").where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0, name
