"""Operator 13: SentencePiece BPE encoding and decoding.

A model of merges joins, again and again, the adjacent pair whose joined piece has the best score, leftmost first. The
same result without merging: one pass of an Aho-Corasick automaton gives the longest piece that starts at each
character; the encoder walks from left to right, takes the longest piece that is compatible with the one before it,
falls back to shorter prefixes, and backtracks where none fits. A bitfield marks positions found to be dead ends, which
are never tried again, so the work is linear. Two pieces are compatible if merging the characters of both again leaves
exactly these two; that is decided along the seam, by undoing the later merge beside it again and again, and memoised. Where
several pieces share a score, all characters are merged again, as in the definition.

A text is cut before each space that follows something else, if no piece of the model crosses such a place, and at ASCII
characters that no piece has; words that come again are looked up. Characters that no piece has become their bytes. Normalisation other than the space that is
put before a text is refused, as are pieces of the user's own.

Null and empty texts give the begin and end ids alone. Rows are independent: repeated rows, ties, hot keys and further
columns have no influence, and an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import work

#: Words that a Python worker remembers at most in each of two generations, and pairs of pieces; then it starts afresh.
REMEMBER_WORDS, REMEMBER_PAIRS = 400_000, 400_000
#: Longer words are encoded each time.
REMEMBER_CHARS = 64
#: What a space is to the model.
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and the kind of model that merges.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))
_models: dict[str, "Model"] = {}


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields: integers, or the bytes of what is longer or a float."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Encoder and decoder for a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces, self.kinds, self.score = [], [], {}
        prefix, removes, escapes, own = 1, 1, 1, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                piece, kind = own[1].decode("utf-8"), own.get(3, NORMAL)
                if kind == NORMAL:
                    self.score.setdefault(piece, struct.unpack("<f", own.get(2, bytes(4)))[0])
                if kind in (USER_DEFINED, UNUSED):
                    raise ValueError("pieces of the user's own and unused ones are not supported")
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trained = dict(fields(value))
            elif number == 3:
                own = dict(fields(value))
                prefix, removes, escapes = own.get(3, 1), own.get(4, 1), own.get(5, 1)
                if own.get(2):
                    raise ValueError("a model that normalises texts is not supported")
        if trained.get(3) != MERGES or removes or not escapes:
            raise ValueError("a model of merges that keeps all spaces is wanted")
        self.prefix = SPACE if prefix else ""
        self.begin, self.end = trained.get(41, 1), trained.get(42, 2)
        self.ids = {p: i for i, (p, k) in reversed(list(enumerate(zip(self.pieces, self.kinds)))) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.byte) < 256:
            raise ValueError("a model with a piece for each byte is wanted")
        self.text = list(self.pieces)
        for char in sorted(set("".join(self.ids)) - self.ids.keys()):  # of pieces, but none itself: a number beyond all ids
            self.ids[char] = len(self.text)
            self.text.append(char)
        self.length = [len(x) for x in self.text]
        self.packed = [struct.pack("<I", i) for i in range(len(self.pieces))]
        self.packed += [self.as_bytes(x) for x in self.text[len(self.pieces) :]]
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        as_text = {UNKNOWN: lambda p: " ⁇ ", CONTROL: str, NORMAL: lambda p: p.replace(SPACE, " ")}
        self.said = [bytes([int(p[3:5], 16)]) if k == BYTE else as_text[k](p).encode("utf-8") for p, k in zip(self.pieces, self.kinds)]
        self.trie = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.trie.add_word(piece, i)
        self.trie.make_automaton()
        self.shorter = [self._prefix(x) if self.ids.get(x) == i else -1 for i, x in enumerate(self.text)]
        self.chars = known = {x for x in self.ids if len(x) == 1}
        times = Counter(self.score.values())
        self.tied = {self.ids[p] for p, x in self.score.items() if len(p) > 1 and times[x] > 1}
        self.crosses = any(f"{c}{SPACE}" in p for p in self.ids for c in set(p) - {SPACE})
        alone = "".join(chr(x) for x in range(128) if chr(x) not in known and chr(x) != " ")
        cut = f"{SPACE}*[^{SPACE}{re.escape(alone)}]+|{SPACE}+" + (f"|[{re.escape(alone)}]" if alone else "")
        self.cut = (lambda text: [text]) if self.crosses else re.compile(cut).findall
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, dict[int, bool]] = defaultdict(dict)
        self.pairs = 0
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def as_bytes(self, char: str) -> bytes:
        """Ids of a character that is no piece: one for each of its bytes."""
        return b"".join(self.packed[self.byte[x]] for x in char.encode("utf-8"))

    def runs(self, word: str) -> list[str]:
        """The word cut at characters that no piece has."""
        if self.chars.issuperset(word):
            return [word]
        return ["".join(own) for known, run in groupby(word, self.chars.__contains__) for own in ([run] if known else run)]

    def _prefix(self, piece: str) -> int:
        for n in range(len(piece) - 1, 0, -1):
            if piece[:n] in self.ids:
                return self.ids[piece[:n]]
        return -1

    def by_merges(self, word: str) -> list[int]:
        """The definition: join the adjacent pair of the best score, leftmost first, while there is one."""
        parts = list(word)
        while len(parts) > 1:
            least, at = min((-self.score.get(parts[i] + parts[i + 1], -np.inf), i) for i in range(len(parts) - 1))
            if least == np.inf:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[x] for x in parts]

    def joined(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that a piece's last merge joins; itself twice for a character, None if merges never give it."""
        if piece not in self.parts:
            text = self.text[piece]
            found: tuple[int, int] | None = (piece, piece)
            if len(text) > 1:
                parts, made = list(text), None
                while len(parts) > 1:
                    least, at = min((-self.score.get(parts[i] + parts[i + 1], -np.inf), i) for i in range(len(parts) - 1))
                    if least == np.inf:
                        break
                    made = tuple(parts[at : at + 2])
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                found = (self.ids[made[0]], self.ids[made[1]]) if len(parts) == 1 else None
            self.parts[piece] = found
        return self.parts[piece]

    def stay_apart(self, a: int, b: int) -> bool | None:
        """What compatible() asks, from the merges along the seam; None where pieces share a score."""
        if self.joined(a) is None or self.joined(b) is None:
            return False
        text, score = self.text, self.score.get
        until, tied = None, self.tied
        while True:
            if a in tied or b in tied:
                return None
            own = score(text[a] + text[b])
            if own is not None and (until is None or own > until[0] or own == until[0] and until[1]):
                return False
            late_a, late_b = (score(text[x]) if len(text[x]) > 1 else np.inf for x in (a, b))  # the worse score is the later merge
            if late_a < late_b:
                until, a = (late_a, False), self.joined(a)[1]
            elif late_b < np.inf:  # of two merges of one score the right one is later, and the seam's comes before it
                until, b = (late_b, True), self.joined(b)[0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's characters again leaves a and b; a of -1 is the start of a word."""
        known = self.joined(b) is not None if a < 0 else self.stay_apart(a, b)
        if known is None:
            known = self.by_merges(self.text[a] + self.text[b]) == [a, b]
        if self.pairs >= REMEMBER_PAIRS:
            self.pairs = 0
            for own in self.fits.values():
                own.clear()
        self.pairs += 1
        self.fits[a][b] = known
        return known

    def encode_run(self, word: str) -> list[int]:
        """word: characters that pieces have."""
        n, length, shorter, fits, compatible = len(word), self.length, self.shorter, self.fits, self.compatible
        longest = [self.ids[x] for x in word]
        for end, piece in self.trie.iter(word):  # of one start, the longest piece ends last
            longest[end + 1 - length[piece]] = piece
        dead, any_dead = bytearray(n // 8 + 1), False
        out, at, piece, before = [], 0, longest[0], -1
        while True:
            get = fits[before].get
            while piece >= 0:
                fit = get(piece)
                if (compatible(before, piece) if fit is None else fit) and not (any_dead and dead[(at + length[piece]) >> 3] >> ((at + length[piece]) & 7) & 1):
                    break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at += length[piece]
                if at == n:
                    return out
                before, piece = piece, longest[at]
            else:
                any_dead = True
                dead[at >> 3] |= 1 << (at & 7)
                piece = out.pop()  # by the merges there is a way, so there is a piece before
                before = out[-1] if out else -1
                at -= length[piece]
                piece = shorter[piece]

    def word_ids(self, word: str, key: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers, remembered under the key."""
        ids = self.older.get(key)
        if ids is None:
            packed, found = self.packed, []
            whole = self.ids.get(word)
            if whole is not None and self.compatible(-1, whole):
                found.append(packed[whole])
            else:
                for run in self.runs(word):
                    found += [packed[x] for x in self.encode_run(run)] if run[0] in self.chars else [self.as_bytes(run)]
            ids = b"".join(found)
        if len(word) <= REMEMBER_CHARS:
            if len(self.seen) >= REMEMBER_WORDS:
                self.older, self.seen = self.seen, {}
            self.seen[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, packed."""
        seen, make, out = self.seen.get, self.word_ids, [self.packed[self.begin]]
        if text and (self.crosses or not self.prefix or text[0] == " " or "  " in text or SPACE in text):
            out += [seen(word) or make(word, word) for word in self.cut((self.prefix + text).replace(" ", SPACE))]
        elif text:  # each word but the first of a later line follows one space
            newline = self.ids.get("\n")
            for at, line in enumerate(text.split("\n") if newline is None else [text]):
                words = line.split(" ")
                if at:
                    out.append(self.as_bytes("\n"))
                    if words[0]:
                        out.append(seen(words[0]) or make(words[0], words[0]))
                    del words[0]
                # A key that starts with a space is a word's that follows one.
                out += [seen(" " + word) or make(SPACE + word, " " + word) for word in words]
        out.append(self.packed[self.end])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text that packed ids stand for, as the library's decoder gives it."""
        every = np.frombuffer(ids, dtype="<u4").tolist()
        texts = []
        for control, run in groupby(every, self.controls.__contains__):  # bytes on both sides of a control piece are apart
            if not control:
                texts.append(b"".join(map(self.said.__getitem__, run)).decode("utf-8", "each_byte"))
        first = next((i for i in every if i not in self.controls), None)
        drops = first is not None and self.prefix and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE)
        text = "".join(texts)
        return text[1:] if drops else text


def model(path: str) -> Model:
    """One Model a Python worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, token_ids (binary, little-endian unsigned 32-bit), n_tokens. Null text: begin and end."""
    work.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            ids = [own.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "token_ids", "n_tokens"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, token_ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds decoded (string). Null ids: an empty text."""
    work.arrow_batches(encoded.sparkSession)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            out = [own.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex) of what encode() returns: its ids are decoded again."""
    work.arrow_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            every = [x or b"" for x in batch.column(2).to_pylist()]
            sha = [hashlib.sha256(x).hexdigest() for x in every]
            text_sha = [hashlib.sha256(own.decode(x).encode("utf-8")).hexdigest() for x in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "n_tokens", "token_ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
