"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns find what their form alone proves. The field then labels every token that
holds a digit or an at sign: neighbouring tokens are linked, and so are distant tokens that
repeat or resemble each other (same last digits, same mailbox, same string), so that what is
certain in one place speaks for its likes elsewhere. Loopy message passing gives each token's
label; confident tokens outside the patterns' spans are added, neighbouring pieces of a phone number as one span. Weights are
trained here on tokens that the patterns label, and on mentions put into the sampled texts that no pattern
can prove: shorter forms of a phone or address that the text holds, and forms just like them of nothing in
the text. Their shape tells nothing; what is like them elsewhere in the text does.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; label i is KINDS[i - 1].
LABELS = len(KINDS) + 1
#: Different texts that the weights are fitted on, about, and the marginal from which a token is added.
SAMPLE, CONFIDENT = 3000, 0.9
ROUNDS = 12

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A match cannot begin inside a run of digits: one at the run's start would have begun earlier.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
DIGITS = re.compile(r"[^0-9]+")
EDGE = ".,;:!?()[]{}\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each at sign back over the mailbox and on over the host; linear in the text."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1  # no match crosses an at sign that failed
        if m:
            yield start, low
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; offsets in code points."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def _bucket(n: int, *limits: int) -> int:
    return bisect_right(limits, n)


#: Features of a token and how many values each has.
WIDTHS = (12, 5, 3, 5, 3, 2, 2, 2, 2, 2)
OFFSETS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
FEATURES = sum(WIDTHS) + 1


def features(token: str) -> list[int]:
    """Indexes of the features of a token: its shape only."""
    digits = DIGITS.sub("", token)
    n = len(digits)
    letters = sum(c.isalpha() for c in token)
    values = (
        _bucket(n, 1, 2, 3, 4, 5, 8, 12, 15, 16, 17, 20),
        _bucket(letters, 1, 4, 10, 25),
        min(token.count("@"), 2),
        min(token.count("."), 4),
        min(token.count("-"), 2),
        int(token.startswith("+")),
        int("(" in token),
        int("=" in token or "_" in token),
        int(n >= 12 and luhn(digits)),
        int(len(token) == n),
    )
    return [o + v for o, v in zip(OFFSETS, values, strict=True)] + [FEATURES - 1]


def likeness(token: str) -> str | None:
    """What similar tokens share: the last seven digits, the mailbox, or the string itself."""
    core = token.strip(EDGE)
    digits = DIGITS.sub("", core)
    if len(digits) >= 7 and "." not in core and "@" not in core:
        return "#" + digits[-7:]
    if "@" in core:
        return "@" + core.split("@")[0].lower()
    return core.lower() if len(core) >= 6 else None


def links_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links of neighbours (one space apart) and skip links: each token with the next of its likeness, so that repeats cost no square."""
    near = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] == 1]
    last: dict[str, int] = {}
    far = []
    for i, (s, e) in enumerate(spans):
        if (key := likeness(text[s:e])) is not None:
            if key in last:
                far.append((last[key], i))
            last[key] = i
    return near, far


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """The label that the patterns give each token: the kind of the first span that meets it."""
    by_start = sorted((s, e, k) for k, s, e in base)
    starts = [b[0] for b in by_start]
    out = []
    for s, e in spans:
        i = bisect_right(starts, e - 1) - 1
        out.append(by_start[i][2] + 1 if i >= 0 and by_start[i][1] > s else 0)
    return out


@dataclass
class Field:
    """The trained weights: token features by label, and log-potentials of neighbours and of skip links."""

    unary: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def marginals(self, feats: list[list[int]], known: list[int], near: list, far: list, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities of each token by loopy message passing over all links of the document; ``known`` labels are held."""
        local = self.unary[np.array(feats)].sum(axis=1)
        held = np.array(known)
        local[held > 0] -= 30
        local[held > 0, held[held > 0]] += 30
        if not near and not far:
            return _softmax(local)
        i, j = np.array([*near, *far]).T
        to, start = np.concatenate([j, i]), np.concatenate([i, j])
        tables = np.concatenate([np.broadcast_to(self.near, (len(near), LABELS, LABELS)), np.broadcast_to(self.far, (len(far), LABELS, LABELS))])
        tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(i), 2 * len(i)), np.arange(len(i))])
        messages = np.zeros((len(to), LABELS))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, to, messages)
            out = belief[start] - messages[back]
            out = out[:, :, None] + tables
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            new = 0.5 * messages + 0.5 * new
            if np.abs(new - messages).max() < 1e-3:
                break
            messages = new
        belief = local.copy()
        np.add.at(belief, to, messages)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def short_forms(kind: int, found: str) -> list[str]:
    """Forms of a phone number or an address that no pattern proves."""
    if KINDS[kind] == "email":
        box, _, host = found.partition("@")
        return [f"{box}@{host.split('.')[0]}"]
    digits = DIGITS.sub("", found)
    if KINDS[kind] != "phone" or len(digits) < 10:
        return []
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [a + b + c, f"{a}-{b}-{c}", f"{b}-{c}"]


def unlike(form: str, seed: int) -> str:
    """The same form with other digits and letters, drawn from a seed."""
    out = []
    for c in form:
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(chr(48 + (seed >> 33) % 10) if c.isdigit() else chr(97 + (seed >> 33) % 26) if c.isalpha() else c)
    return "".join(out)


def example(text: str, seed: int) -> tuple[list[list[int]], list[int], list, list]:
    """Features, labels and links of a text with mentions put at its end: of each kind's first span a short form, and a form like it of nothing.

    What the text itself repeats in a form that no pattern proves has no label to learn from: -1.
    """
    base, own = base_spans(text), len(text)
    firsts: dict[int, str] = {}
    for k, s, e in base:
        firsts.setdefault(k, text[s:e])
    given: list[tuple[int, int, int]] = []
    for k, found in firsts.items():
        forms = short_forms(k, found)
        if forms:
            form = forms[seed % len(forms)]
            for mention, label in ((form, k), (unlike(form, seed), None)):
                start = len(text) + 3
                text += " , " + mention
                if label is not None:
                    given.append((label, start, len(text)))
    spans = tokens_of(text)
    near, far = links_of(text, spans)
    known = labels_of(spans, [*base, *given])
    keys = [likeness(text[s:e]) for s, e in spans]
    proven = {key for key, k, (s, _) in zip(keys, known, spans, strict=True) if k and s < own}
    known = [-1 if k == 0 and s < own and key in proven else k for key, k, (s, _) in zip(keys, known, spans, strict=True)]
    return [features(text[s:e]) for s, e in spans], known, near, far


def counted(examples: list[tuple[list[list[int]], list[int], list, list]]) -> tuple[dict[tuple, int], np.ndarray]:
    """How often each (features, label) occurs, and how often each two labels are linked, by kind of link."""
    rows: dict[tuple, int] = {}
    tables = np.zeros((2, LABELS, LABELS), np.int64)
    for feats, known, close, distant in examples:
        for f, k in zip(feats, known, strict=True):
            if k >= 0:
                rows[(*f, k)] = rows.get((*f, k), 0) + 1
        for table, pairs in zip(tables, (close, distant), strict=True):
            for i, j in pairs:
                if known[i] >= 0 and known[j] >= 0:
                    table[known[i], known[j]] += 1
                    table[known[j], known[i]] += 1
    return rows, tables


def fit(rows: dict[tuple, int], tables: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Piecewise training: the token weights by softmax regression, each kind of link by how much more often than for tokens at large its ends have these labels."""
    unary = np.zeros((FEATURES, LABELS))
    unary[FEATURES - 1, 0] = 1.0
    if rows:
        kept = np.array(sorted(rows))
        counts = np.array([rows[tuple(k)] for k in kept.tolist()])
        x = np.zeros((len(kept), FEATURES))
        np.put_along_axis(x, kept[:, :-1], 1.0, axis=1)
        y, w = np.eye(LABELS)[kept[:, -1]], (counts / counts.sum())[:, None]
        speed = np.zeros_like(unary)
        for _ in range(steps):
            step = x.T @ (w * (_softmax(x @ unary) - y)) + decay * unary
            speed = 0.9 * speed - rate * step
            unary = unary + speed
    share = np.ones(LABELS)
    for key, n in rows.items():
        share[key[-1]] += n
    share, made = share / share.sum(), []
    for table in tables + 1.0:
        joint = table / table.sum()
        made.append(np.clip(np.log(joint / np.outer(share, share)), -3, 3))
    return Field(unary, *made)


def train(df: DataFrame, text: str, sample: int = SAMPLE) -> Field:
    """Weights from about ``sample`` different texts that hold a digit or an at sign, drawn by a hash of the text.

    Tasks return counts of (features, label) and of linked labels; the driver gets their sums, which the
    number of features bounds.
    """
    held = df.select(F.col(text).alias("text")).where(F.col(text).rlike("[0-9@]"))
    every = max(1, -(-held.count() // sample))
    drawn = held.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(1).to_pylist()
            rows, tables = counted([example(x.as_py(), h % (1 << 32)) for x, h in zip(batch.column(0), seeds, strict=True)])
            keys = [*map(list, rows), *([-1 - i, a, b] for i in range(2) for a in range(LABELS) for b in range(LABELS))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array([*rows.values(), *tables.ravel().tolist()], pa.int64())], names=["key", "n"])

    rows, tables = {}, np.zeros((2, LABELS, LABELS), np.int64)
    for r in drawn.mapInArrow(run, "key array<int>, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        if r["key"][0] < 0:
            tables[-1 - r["key"][0], r["key"][1], r["key"][2]] = r["n"]
        else:
            rows[tuple(r["key"])] = r["n"]
    return fit(rows, tables)


def added(text: str, base: list[tuple[int, int, int]], field: Field, confident: float = CONFIDENT) -> list[tuple[int, int, int]]:
    """Spans that the field adds: confident tokens that meet no span of the patterns, without the punctuation around them; neighbouring pieces of a phone number are one span."""
    spans = tokens_of(text)
    known = labels_of(spans, base)
    if all(known):
        return []
    near, far = links_of(text, spans)
    marginals = field.marginals([features(text[s:e]) for s, e in spans], known, near, far)
    out: list[tuple[int, int, int]] = []
    for (s, e), k, p in zip(spans, known, marginals, strict=True):
        label = int(p.argmax())
        if k == 0 and label and p[label] >= confident:
            token = text[s:e]
            s += len(token) - len(token.lstrip(EDGE if token[0] != "(" or ")" not in token else EDGE.replace("(", "")))
            e -= len(token) - len(token.rstrip(EDGE))
            if out and out[-1][0] == label - 1 == KINDS.index("phone") and s - out[-1][2] <= 2 and not text[out[-1][2] : s].strip(" )"):
                s = out.pop()[1]  # the next word of the same number
            if s < e:
                out.append((label - 1, s, e))
    return out


def detect(df: DataFrame, text: str, field: Field, confident: float = CONFIDENT) -> DataFrame:
    """``df`` without ``text`` and with n_email, n_ip, n_card, n_phone (of the patterns), base (their spans) and spans (all).

    Spans are ``kind:start:end`` with offsets in code points, by kind, then start. Every row
    by itself; null texts count as empty. Columns of ``df`` with the new names are replaced.
    """
    made = [*[f"n_{k}" for k in KINDS], "base", "spans"]
    keep = [f for f in df.schema.fields if f.name != text and f.name not in made]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *[T.StructField(n, T.LongType() if n[:2] == "n_" else T.StringType()) for n in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for x in batch.column(batch.schema.get_field_index(text)):
                value = x.as_py() or ""
                base = base_spans(value)
                all_spans = sorted([*base, *added(value, base, field, confident)])
                for i in range(len(KINDS)):
                    out[i].append(sum(k == i for k, _, _ in base))
                out[-2].append(joined(base))
                out[-1].append(joined(all_spans))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], *[pa.array(o, pa.int64() if n[:2] == "n_" else pa.string()) for n, o in zip(made, out, strict=True)]],
                names=[*names, *made],
            )

    return df.select(*names, text).mapInArrow(run, schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
