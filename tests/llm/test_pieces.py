"""Operator 13 against the library, and against merging by the definition."""

import hashlib
import random
import struct

import pytest

from greffe.llm import pieces

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
ALPHABET = " ▁  ▁abcdeéthе\t\n日本語\U0001f600͸<s></s><0x0A>ßx'’0123門\x00"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def agree(library, text):
    own = pieces.model(PATH)
    want, got = library.encode(text, add_bos=True, add_eos=True), own.encode(text)
    assert unpacked(got) == want
    assert own.decode(got) == library.decode(want)


def test_random_texts(library):
    rng = random.Random(3)
    for _ in range(3000):
        agree(library, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))))
    for _ in range(3000):
        agree(library, "".join(rng.choice(pieces.model(PATH).pieces) for _ in range(rng.randint(1, 12))))


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 50_000, "ab c" * 20_000, "\U0001f600" * 5_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))])
def test_long_texts(library, text):
    agree(library, text)


def test_decoding_any_ids(library):
    """Also ids that no encoder gives: broken bytes, begin and end in the middle, the unknown piece."""
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.randrange(32_000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randint(0, 10))]
        assert pieces.model(PATH).decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_memory_that_is_full_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBER_WORDS", 2)
    monkeypatch.setattr(pieces, "REMEMBER_PAIRS", 2)
    own = pieces.Model(PATH)
    for text in ("the quick brown fox  jumps", "naïve façade über", "a b c a b c a b c"):
        assert unpacked(own.encode(text)) == library.encode(text, add_bos=True, add_eos=True)


def test_merges_where_spaces_are_crossed(tmp_path):
    """A model of few pieces with equal scores, with one across a space, and one character that is no piece."""

    def message(*parts):
        out = b""
        for number, value in parts:
            out += bytes([number << 3 | (0 if isinstance(value, int) else 5 if isinstance(value, float) else 2)])
            out += bytes([value]) if isinstance(value, int) else struct.pack("<f", value) if isinstance(value, float) else bytes([len(value)]) + value
        return out

    normal = [("ab", -1.0), ("bc", -1.0), ("c▁", -2.0), ("abc", -3.0), ("▁a", -3.0), ("a", -9.0), ("b", -9.0), ("▁", -9.0), ("▁ab", -3.0), ("d▁a", -4.0), ("▁d", -4.0)]
    rows = [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)] + [(p, s, pieces.NORMAL) for p, s in normal]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in rows)
    (tmp_path / "m").write_bytes(data + message((2, message((3, pieces.MERGES))), (3, message((1, b"identity"), (3, 1), (4, 0)))))
    own = pieces.Model(str(tmp_path / "m"))
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("abcd x") for _ in range(rng.randint(1, 14)))
        want = b""
        for run in own.runs("▁" + text.replace(" ", "▁")):
            want += b"".join(own.packed[i] for i in own.by_merges(run)) if run[0] in own.ids else own.as_bytes(run)
        assert own.encode(text) == own.packed[1] + want + own.packed[2]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "m"))


def test_tables(spark, library, with_odd_ids, no_docs):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(pieces.encode(with_odd_ids, PATH), PATH).collect()}
    plain = set()
    for r in with_odd_ids.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        plain.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows == plain
    assert pieces.digests(pieces.encode(no_docs, PATH), PATH).collect() == []
    kept = with_odd_ids.where("doc_id = 0 and text is not null")
    assert {library.decode(library.encode(r.text)) for r in kept.collect()} == {r.decoded for r in pieces.decode(pieces.encode(kept, PATH), PATH).collect()}
