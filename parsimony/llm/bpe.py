"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that never stand side by side inside any vocabulary token cannot be joined
by any merge, so every such place is a certain cut. A word is cut there, the fragments are
encoded independently (and kept, as fragments repeat), and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: What str.split() takes for white space but the file's patterns do not, and the patterns' own white space.
ODD = regex.compile(r"[\x1c-\x1f]")
ODD_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Words and fragments that a worker keeps; older ones go when there are more.
KEPT = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file of the kind byte-level BPE with word ends.

    ``content`` is the JSON text. Results equal those of the tokenizers library with
    add_special_tokens=False; special tokens in a text are found as the library finds them.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.content, self.vocab, self.suffix = content, model["vocab"], model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.inside = self._pairs_inside()
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.fragments: dict[tuple[str, ...], tuple[int, ...]] = {}
        self._normalizer = None

    def _pairs_inside(self) -> set[tuple[str, str]]:
        pairs = set()
        for token in self.vocab:
            symbols = self._symbols(token)
            pairs.update(zip(symbols, symbols[1:], strict=False))
        return pairs

    def _symbols(self, token: str) -> list[str]:
        body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
        symbols = list(body)
        if body is not token and symbols:
            symbols[-1] += self.suffix
        return symbols

    def normalize(self, text: str) -> str:
        """NFC, lower case. White space needs no folding: every piece lies between spaces.

        Below U+0300 every text is in NFC and lower-casing is one to one with the library's; other
        texts go through the library's own normalizer.
        """
        if text.isascii() or max(text) < "̀":
            return text.lower()
        if self._normalizer is None:
            from tokenizers import Tokenizer

            self._normalizer = Tokenizer.from_str(self.content).normalizer
        return self._normalizer.normalize_str(text)

    def fragment(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of one fragment: the merge of least rank first, the leftmost of equal ones; a heap keeps long ones linear-logarithmic."""
        known = self.fragments.get(symbols)
        if known is not None:
            return known
        parts: list[str | None] = list(symbols)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(queue, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(queue, (r, h, parts[h], parts[i]))
        ids = tuple(self.vocab[p] for p in parts if p is not None and p in self.vocab)
        if len(symbols) < 64:
            if len(self.fragments) >= KEPT:
                self.fragments.clear()
            self.fragments[symbols] = ids
        return ids

    def piece(self, piece: str) -> list[int]:
        """Ids of one word: cut at the forced boundaries, fragments encoded one by one."""
        letters = [self.letters[b] for b in piece.encode("utf-8")]
        letters[-1] += self.suffix
        ids, start, inside = [], 0, self.inside
        for i in range(1, len(letters)):
            if (letters[i - 1], letters[i]) not in inside:
                ids += self.fragment(tuple(letters[start:i]))
                start = i
        return ids + list(self.fragment(tuple(letters[start:])))

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """Little-endian ids and decoded bytes of text without white space."""
        ids = [i for piece in self.pieces.findall(chunk) for i in self.piece(piece)]
        made = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids)).encode("utf-8")
        if len(chunk) < 64:
            if len(self.chunks) >= KEPT:
                self.chunks.clear()
            self.chunks[chunk] = made
        return made

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a whole text as little-endian 32-bit integers, and the text decoded from them."""
        ids, decoded = [], []
        sections = self.split_special.split(text) if self.split_special else [text]
        for section in sections:
            if section in self.special:
                ids.append(struct.pack("<I", self.special[section]))
                decoded.append(section.encode())
                continue
            kept = self.chunks
            plain = self.normalize(section)
            for chunk in ODD_SPACE.split(plain) if ODD.search(plain) else plain.split():
                i, d = kept.get(chunk) or self.chunk(chunk)
                if i:
                    ids.append(i)
                    decoded.append(d)
        return b"".join(ids), b" ".join(decoded)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included: tokens with a space between them, as the file names no decoder."""
        return " ".join(self.names[i] for (i,) in struct.iter_unpack("<I", ids) if i in self.names)


def encode(df: DataFrame, text: str, content: str, ids: bool = True) -> DataFrame:
    """``df`` without ``text`` and with n_tokens, ids (binary, if wanted), ids_sha256, decoded_sha256.

    Each row by itself, batch by batch. Null texts count as empty; a text of any length works.
    Columns of ``df`` with the names of the new ones are replaced.
    """
    shipped = df.sparkSession.sparkContext.broadcast(content)  # one vocabulary file, of fixed size
    made = [("n_tokens", T.LongType()), *([("ids", T.BinaryType())] if ids else []), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    keep = [f for f in df.schema.fields if f.name != text and f.name not in dict(made)]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in made]])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(shipped.value)
        for batch in batches:
            out: dict[str, list] = {n: [] for n, _ in made}
            for x in batch.column(batch.schema.get_field_index(text)):
                got, decoded = bpe.encode(x.as_py() or "")
                out["n_tokens"].append(len(got) // 4)
                out["ids_sha256"].append(hashlib.sha256(got).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if ids:
                    out["ids"].append(got)
            types = {"n_tokens": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names], *[pa.array(out[n], types.get(n, pa.string())) for n, _ in made]],
                names=[*names, *[n for n, _ in made]],
            )

    return df.select(*names, text).mapInArrow(run, schema)
