"""Operator 9: byte-level BPE encoding and decoding.

Tokens' bytes are mapped to Latin-1, so that pyahocorasick can hold them as strings. For a pre-token, one pass of the
automaton gives the longest token that starts at each byte. The encoder then walks from left to right, takes the
longest token that is compatible with the one before it, falls back to the next shorter prefix token, and backtracks
where none fits; positions found to be dead ends are never tried again, so the work is linear. Two tokens are
compatible if the merges would leave exactly these two; that is decided from the merge trees along the seam and
memoised. The result equals the merges by rank.

Null and empty texts give no ids. Rows are independent: repeated rows, ties, hot keys and further columns have no
influence, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import work

#: Pre-tokens and token pairs that a Python worker remembers at most; then it starts afresh.
REMEMBER_WORDS, REMEMBER_PAIRS = 300_000, 400_000
#: Longer pre-tokens are encoded each time.
REMEMBER_BYTES = 64

_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Encoder and decoder for a rank file (base64 token, rank) and a pre-token pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ids = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ids[base64.b64decode(token).decode("latin-1")] = int(rank)
        size = max(self.ids.values()) + 1
        self.text = [""] * size
        for token, rank in self.ids.items():
            self.text[rank] = token
        self.bytes = [x.encode("latin-1") for x in self.text]
        self.length = [len(x) for x in self.text]
        self.packed = [x.to_bytes(4, "little") for x in range(size)]
        self.trie = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.trie.add_word(token, rank)
        self.trie.make_automaton()
        self.shorter = [self._prefix(x) for x in self.text]
        self.left, self.right, self.merged = list(range(size)), list(range(size)), {}
        for token in sorted(self.ids, key=self.ids.get):
            if len(token) > 1:
                self._learn(token)
        self.find = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}

    def _prefix(self, token: str) -> int:
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.ids:
                return self.ids[token[:n]]
        return -1

    def _learn(self, token: str) -> None:
        """The two parts that the last merge of a token joins."""
        parts = self.by_merges(token, self.ids[token])
        if len(parts) == 2:
            rank = self.ids[token]
            self.left[rank], self.right[rank] = parts
            self.merged[parts[0] << 32 | parts[1]] = rank

    def by_merges(self, word: str, below: int | None = None) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, while there is one (under a rank)."""
        parts = list(word)
        while len(parts) > 1:
            rank, at = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or below is not None and rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[x] for x in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: undo the later merge at the seam, and see if the seam would have joined before it."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            known, until = True, 1 << 60
            while True:
                joined = self.merged.get(a << 32 | b)
                if joined is not None and joined < until:
                    known = False
                    break
                if a > b and self.right[a] != a:
                    until, a = a, self.right[a]
                elif self.left[b] != b:
                    until, b = b + 1, self.left[b]
                elif self.right[a] != a:
                    until, a = a, self.right[a]
                else:
                    break
            if len(self.fits) >= REMEMBER_PAIRS:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_word(self, word: str) -> list[int]:
        """word: the bytes of a pre-token as Latin-1."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(word), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.trie.iter(word):  # of one start, the longest token ends last
            longest[end + 1 - length[token]] = token
        open_, out, at, token = bytearray(b"\x01") * (n + 1), [], 0, longest[0]
        while True:
            before = out[-1] if out else -1
            while token >= 0:
                if open_[at + length[token]]:
                    if before < 0:
                        break
                    fit = fits.get(before << 32 | token)
                    if self.compatible(before, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError("the ranks lack a token for some byte")
                open_[at] = 0
                token = out.pop()
                at -= length[token]
                token = shorter[token]

    def word_ids(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        data = word.encode("utf-8")
        ids = b"".join([self.packed[x] for x in self.encode_word(data.decode("latin-1"))])
        if len(data) <= REMEMBER_BYTES:
            if len(self.seen) >= REMEMBER_WORDS:
                self.seen.clear()
            self.seen[word] = ids
        return ids

    def forget(self) -> None:
        """Free what was remembered: a Python worker goes on to other work, and keeps its coder."""
        self.seen, self.fits = {}, {}

    def encode(self, text: str) -> bytes:
        seen, make = self.seen.get, self.word_ids
        return b"".join([seen(word) or make(word) for word in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        token = self.bytes
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def coder(ranks_path: str, pattern: str) -> Coder:
    """One Coder a Python worker."""
    if (ranks_path, pattern) not in _coders:
        _coders[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _coders[ranks_path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, token_ids (binary, little-endian unsigned 32-bit), n_tokens. Null text: no ids."""
    work.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            ids = [code.encode(x) if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "token_ids", "n_tokens"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, token_ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds decoded (binary): the bytes that the ids stand for. Null ids: no bytes."""
    work.arrow_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            out = [code.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex), and the columns in keep.

    with_ids: token_ids (binary) too.
    """
    work.arrow_batches(docs.sparkSession)
    names = [c for c in keep or [] if c != id_col]
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("__text"), *[docs[c] for c in names])
    added = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()} | ({"token_ids": T.BinaryType()} if with_ids else {})
    schema = T.StructType([*chosen.select("doc_id", *names).schema.fields, *(T.StructField(k, v) for k, v in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            many, ids_sha, text_sha, every = [], [], [], []
            for text in batch.column(1):
                ids = code.encode(text.as_py() or "")
                many.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(code.decode(ids)).hexdigest())
                every.append(ids if with_ids else b"")
            found = [pa.array(many, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(every, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *found[: len(added)]], schema.names)
        code.forget()

    return chosen.mapInArrow(run, schema)
