"""A quality classifier by co-training.

Two views of a document, its text (words and style) and its page metadata (origin, language, length and
layout in steps), each have a logistic classifier fitted on labelled documents. Then, round by round, each view scores
every unlabelled document, and those that it is sure of teach the other view: over the
whole corpus it is counted how often each feature stands in documents that the one view is sure of, and the
log-odds of these counts become a second classifier inside the other view, weighed on labelled documents. Both views are calibrated and
mixed on labelled documents kept out of the fit, and applied to every document.

Features are extracted once and lie in the shared folder; a round reads them and returns
counts per feature, whose number is fixed. Fits run in a task of their own, not on the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, words_of

#: Labelled documents that the fit uses at most. They bound the fit only: every document is scored, and every unlabelled one may teach.
LABELLED = 8_000
#: Buckets of hashed words and word beginnings and of metadata, rounds of co-training, and the calibrated confidence for a pseudo-label.
BUCKETS, META_BUCKETS, ROUNDS, SURE = 1 << 19, 1 << 12, 2, 0.97
#: Sample documents that a feature must stand in to get a weight, and lengths of the word beginnings that are features.
LEAST_DOCS, STEMS = 3, (4, 5)
#: Of twenty labelled documents, those that calibrate the views and those that mix them; the others fit. Of fewer than ``SMALL`` a quarter does both.
CALIBRATE, MIX, SMALL, QUARTER = (0, 1), (2,), 400, (3, 7, 11, 15, 19)
#: What a document needs to be kept, as a calibrated probability of being clean.
KEEP = 0.5
STYLE = 10
SYMBOLS = frozenset(b"!#$%&*|=_<>~^\\")
STRIP = bytes(range(0x21, 0x30)) + b":;<=>?@[\\]^_`{|}~"


def text_features(text) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words of the whole text and of their beginnings, and measures of its layout."""
    value = text or ""
    found = words_of(value)
    plain = {w.strip(STRIP) for w in set(found)}
    plain.discard(b"")
    hashed = {crc32(w) % BUCKETS for w in plain}
    for k in STEMS:
        hashed.update([crc32(w, k) % BUCKETS for w in {w[:k] for w in plain if len(w) > k}])
    hashed = np.array(sorted(hashed), np.int32)
    n, raw = max(len(found), 1), value.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    symbols = sum(counts[c] for c in SYMBOLS)
    lines = value.split("\n")
    style = [
        upper / max(upper + lower, 1),
        min(symbols / n, 3.0),
        len(set(found)) / n,
        sum(map(len, found)) / n / 10,
        log1p(n) / 10,
        counts[48:58].sum() / max(len(raw), 1),
        min(counts[124] / n, 1.0),
        len(set(lines)) / max(len(lines), 1),
        sum(a == b for a, b in zip(found, found[1:], strict=False)) / n,
        min((counts[44] + counts[46]) / n, 1.0),
    ]
    return hashed, np.array(style, np.float64)


def meta_features(values: tuple, style: np.ndarray) -> np.ndarray:
    """Buckets of the metadata: each field's value, numbers by their order of magnitude, and each layout measure in steps."""
    out = []
    for i, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = round(log1p(max(v, 0)) * 2)
        out.append(crc32(f"{i}={v}".encode()) % META_BUCKETS)
    out += [crc32(f"layout {i}={int(x * 25)}".encode()) % META_BUCKETS for i, x in enumerate(style.tolist())]
    return np.array(sorted(set(out)), np.int32)


@dataclass
class Logistic:
    """Sparse presence features and a few dense ones, fitted on labelled rows."""

    words: np.ndarray
    dense: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return np.array([self.words[r].sum() for r in rows]) + dense @ self.dense + self.bias


def fit(rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, steps: int = 250, rate: float = 0.05, decay: float = 3e-4) -> Logistic:
    """Regularised logistic regression by Adam on the whole sample; the classes weigh the same."""
    n = len(rows)
    if n == 0 or y.min() == y.max():
        return Logistic(np.zeros(width, np.float32), np.zeros(dense.shape[1]), float(y[0] * 2 - 1 if n else 0) * 4)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    used, flat, often = np.unique(flat, return_inverse=True, return_counts=True)
    stays = often >= LEAST_DOCS
    used, owner, flat = used[stays], owner[stays[flat]], (np.cumsum(stays) - 1)[flat[stays[flat]]].astype(np.int32)
    m, by_feature = len(used), np.argsort(flat, kind="stable")
    owners, starts = np.unique(owner, return_index=True)
    owner_of, feature_starts = owner[by_feature], np.concatenate(([0], np.cumsum(often[stays])[:-1]))
    w = np.where(y > 0.5, 0.5 / (y > 0.5).sum(), 0.5 / (y <= 0.5).sum())
    p = np.zeros(m + dense.shape[1] + 1)
    shrink = np.concatenate([np.ones(m), np.full(dense.shape[1], 0.1), [0.0]])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        z = dense @ p[m:-1] + p[-1]
        if m:
            z[owners] += np.add.reduceat(p[:m][flat], starts)
        error = w * (sigmoid(z) - y)
        sparse = np.add.reduceat(error[owner_of], feature_starts) if m else np.zeros(0)
        g = np.concatenate([sparse, dense.T @ error, [error.sum()]]) + decay * shrink * p
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        p -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(width, np.float32)
    weights[used] = p[:m]
    return Logistic(weights, p[m:-1], float(p[-1]))


def newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, pull: float) -> np.ndarray:
    """Weights of a logistic fit that is pulled towards ``start``; targets are smoothed as in Platt scaling."""
    up, down = y.sum(), len(y) - y.sum()
    target, ab = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2)), start
    for _ in range(60):
        p = sigmoid(x @ ab)
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + pull * np.eye(len(start))
        ab = ab - np.clip(np.linalg.solve(h, x.T @ (p - target) + pull * (ab - start)), -1, 1)
    return ab


def taught_features(rows: list[np.ndarray], taught: np.ndarray) -> np.ndarray:
    """The mean log-odds of each row's features for sure clean and for sure rejected documents."""
    return np.array([taught[:, r].mean(axis=1) if len(r) else (0.0, 0.0) for r in rows]).reshape(-1, 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class View:
    """A classifier of one view: the fit on labelled rows, what the other view's sure documents teach, and how both make a calibrated log-odds."""

    base: Logistic
    taught: np.ndarray
    scale: np.ndarray

    def parts(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        return np.column_stack([self.base.score(rows, dense), np.ones(len(rows)), taught_features(rows, self.taught)])


def _unfitted() -> list[View]:
    return [View(Logistic(np.zeros(w, np.float32), np.zeros(STYLE), 0.0), np.zeros((2, w), np.float32), np.zeros(4)) for w in (BUCKETS, META_BUCKETS)]


@dataclass
class Model:
    """Both views and their weights in the mix."""

    views: list[View] = field(default_factory=_unfitted)
    mix: tuple[float, ...] = (0.0, 0.0, 1.0, 4.0)
    centre: np.ndarray = field(default_factory=lambda: np.zeros(STYLE))
    spread: np.ndarray = field(default_factory=lambda: np.ones(STYLE))
    fitted: bool = False

    def logits(self, words: list[np.ndarray], meta: list[np.ndarray], style: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds of being clean by the text and by the metadata."""
        dense = self.dense(style)
        return [v.parts(r, dense) @ v.scale for v, r in zip(self.views, (words, meta), strict=True)]

    def dense(self, style: np.ndarray) -> np.ndarray:
        return (style.reshape(-1, STYLE) - self.centre) / self.spread

    def combined(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(sides(text, meta) @ np.array(self.mix))


def sides(text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """What the mix weighs: either view, and the one that is less sure that the document is clean, since one defect is enough."""
    return np.column_stack([text, meta, np.minimum(text, meta), np.ones(len(text))])


def fit_views(labelled: list[tuple], taught: list[np.ndarray], before: Model | None) -> Model:
    """``labelled``: (words, meta, style, y). Most rows fit the views, others calibrate them and weigh what they were taught, others mix them."""
    model = Model()
    if not labelled:
        return model
    part = lambda kinds: [r for i, r in enumerate(labelled) if i % 20 in kinds] or labelled
    calibrating, mixing = (QUARTER, QUARTER) if len(labelled) < SMALL else (CALIBRATE, MIX)
    base, held, mixed = part([k for k in range(20) if k not in calibrating + mixing]), part(calibrating), part(mixing)
    y = lambda rows: np.array([r[3] for r in rows], float)
    style = lambda rows: np.array([r[2] for r in rows])
    model.centre, model.spread, model.fitted = style(base).mean(axis=0), style(base).std(axis=0) + 1e-3, True
    dense, of_held = model.dense(style(base)), model.dense(style(held))
    for v in (0, 1):
        made = before.views[v].base if before else fit([r[v] for r in base], dense, y(base), len(model.views[v].base.words))
        model.views[v] = View(made, taught[v], np.zeros(4))
        model.views[v].scale = newton(model.views[v].parts([r[v] for r in held], of_held), y(held), np.array([0.5, 0.0, 0.0, 0.0]), 2.0)
    x = sides(*model.logits([r[0] for r in mixed], [r[1] for r in mixed], style(mixed)))
    model.mix = tuple(newton(x, y(mixed), np.array([0.0, 0.0, 1.0, 0.0]), 5.0).tolist())
    return model


def sure_counts(model: Model, words: list[np.ndarray], meta: list[np.ndarray], style: np.ndarray, counts: list[np.ndarray], sure: float = SURE) -> None:
    """Adds to the counts of each view's features: in all documents, in those that the other view finds clean for sure, and in those that it rejects for sure; the last column counts documents."""
    p = [sigmoid(x) for x in model.logits(words, meta, style)]
    for v, rows in enumerate((words, meta)):
        other = p[1 - v]
        for kind, chosen in enumerate((np.ones(len(rows), bool), other >= sure, other <= 1 - sure)):
            counts[v][kind, -1] += chosen.sum()
            if chosen.any():
                flat = np.concatenate([r for r, c in zip(rows, chosen.tolist(), strict=True) if c])
                counts[v][kind, :-1] += np.bincount(flat, minlength=counts[v].shape[1] - 1)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Per feature how much more often than in all documents it stands in the sure clean and in the sure rejected ones; 0 where that is not known."""
    every, total = counts[0, :-1] + 1, counts[0, -1] + 2
    out = [np.log((counts[k, :-1] + every / total * 2) / (counts[k, -1] + 2) / (every / total)) if counts[k, -1] else np.zeros(len(every)) for k in (1, 2)]
    return np.where(counts[0, :-1] >= LEAST_DOCS, out, 0.0).astype(np.float32)


def packed(words: np.ndarray) -> bytes:
    """Sorted buckets by their differences, byte plane by byte plane, compressed."""
    planes = np.diff(words, prepend=np.int32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(words).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * 4, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n), dtype=np.int64).astype(np.int32)


def features(docs: DataFrame, doc_id: str, text: str, meta: list[str]) -> DataFrame:
    """(id, h, words, meta, style) of every document, its whole text; h is a hash of the text, words are packed."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"), *[F.col(m).alias(f"m{i}") for i, m in enumerate(meta)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(x.as_py()) for x in batch.column(2)]
            fields = [batch.column(3 + i).to_pylist() for i in range(len(meta))]
            values = [meta_features(tuple(f[i] for f in fields), style) for i, (_, style) in enumerate(made)]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([packed(w) for w, _ in made], pa.binary()), pa.array(values, ints), pa.array([s for _, s in made], pa.list_(pa.float64()))], names=["id", "h", "words", "meta", "style"]
            )

    return rows.mapInArrow(run, f"id {kind}, h long, words binary, meta array<int>, style array<double>")


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, meta: list[str], labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``labelled`` labelled documents, drawn by a hash of the id, and on what both views are sure of among all others.

    A document is clean if its quality is 1 and it is not toxic; labels with nulls are not used. Of several rows
    with a labelled id one counts, the same whatever the order of rows. Without labels, or without labelled
    documents, every document is found clean.
    """
    marked = labels.where("quality is not null and toxic is not null").groupBy(F.col(doc_id).alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    marked = marked.select("id", ((F.col("q") == 1) & (F.col("t") == 0)).cast("int").alias("y"))
    order = F.xxhash64(F.lit(4), F.col("id"))
    there = docs.select(F.col(doc_id).alias("id"))
    chosen = cut(marked.join(there, "id", "left_semi").withColumn("o", order).orderBy("o", "id").limit(labelled))
    rows = cut(features(docs, doc_id, text, meta).join(F.broadcast(chosen), "id", "left"))  # at most ``labelled`` rows of three numbers
    sample = rows.where("y is not null").groupBy("id").agg(F.min(F.struct("o", "h", "words", "meta", "style", "y")).alias("r")).select("id", "r.*")
    sample = cut(sample.repartition(1))  # at most ``labelled`` rows
    others = rows.where("y is null").select("words", "meta", "style")
    context = docs.sparkSession.sparkContext

    def fitted(sent) -> bytes:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, before = pickle.loads(sent.value)
            taught = [log_odds(c) for c in counts] if counts else [np.zeros((2, w), np.float32) for w in (BUCKETS, META_BUCKETS)]
            rows = sorted((row for batch in batches for row in _rows(batch)), key=lambda r: r[0])
            model = fit_views([r[1:] for r in rows], taught, before)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

        made = sample.select("words", "meta", "style", "y", "o", F.col("id").cast("string").alias("id"), "h").mapInArrow(run, "model binary").collect()
        return made[0][0] if made else pickle.dumps(Model())

    model = fitted(context.broadcast(pickle.dumps((None, None))))
    for _ in range(rounds):
        if not pickle.loads(model).fitted:
            break
        sent = context.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            model = pickle.loads(sent.value)
            counts = [np.zeros((3, len(v.base.words) + 1), np.int64) for v in model.views]
            for batch in batches:
                sure_counts(model, [unpacked(x.as_py()) for x in batch.column(0)], _lists(batch.column(1)), batch.column(2).flatten().to_numpy(), counts)
            for v, c in enumerate(counts):
                b = np.flatnonzero(c[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), v, np.int32)), pa.array(b.astype(np.int32)), *[pa.array(x[b]) for x in c]], names=["view", "b", "every", "clean", "bad"])

        sums = others.mapInArrow(run, "view int, b int, every long, clean long, bad long").groupBy("view", "b").agg(*[F.sum(c).alias(c) for c in ("every", "clean", "bad")])
        got = sums.where(F.col("every") >= LEAST_DOCS).toArrow()  # one row per bucket at most
        counts = [np.zeros((3, w + 1), np.int64) for w in (BUCKETS, META_BUCKETS)]
        view, b = got["view"].to_numpy(), got["b"].to_numpy()
        for v in (0, 1):
            for k, c in enumerate(("every", "clean", "bad")):
                counts[v][k, b[view == v]] = got[c].to_numpy()[view == v]
        model = fitted(context.broadcast(pickle.dumps((counts, pickle.loads(model)))))
    return pickle.loads(model)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    words, meta, style, y, o, name, h = batch.columns
    for w, m, s, label, *key in zip([unpacked(x.as_py()) for x in words], _lists(meta), _lists(style), y.to_pylist(), o.to_pylist(), name.to_pylist(), h.to_pylist(), strict=True):
        yield (*[tuple(key)], w, m, s, label)


def score(docs: DataFrame, text: str, meta: list[str], model: Model, keep: float = KEEP) -> DataFrame:
    """``docs`` with p_text, p_meta, p_clean and keep (p_clean at least ``keep``): every document, its whole text.

    Null texts count as empty, null metadata as a value of its own. Columns with these names are replaced.
    """
    made = ["p_text", "p_meta", "p_clean", "keep"]
    fields = [f for f in docs.schema.fields if f.name not in made]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *[T.StructField(n, T.BooleanType() if n == "keep" else T.DoubleType()) for n in made]])
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            view = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            found = [text_features(x.as_py()) for x in view[text]]
            values = [view[m].to_pylist() for m in meta]
            of_meta = [meta_features(tuple(v[i] for v in values), style) for i, (_, style) in enumerate(found)]
            a, b = model.logits([w for w, _ in found], of_meta, np.array([s for _, s in found]))
            p = model.combined(a, b)
            yield pa.RecordBatch.from_arrays([*[view[n] for n in names], pa.array(sigmoid(a)), pa.array(sigmoid(b)), pa.array(p), pa.array(p >= keep)], names=[*names, *made])

    return docs.mapInArrow(run, schema)
