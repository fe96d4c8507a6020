"""Byte-level BPE by prefixes against the tiktoken library."""

import random
import struct

import numpy as np
import pytest
import tiktoken
from greenframe.llm import prefixes, queries
from greenframe.llm.common import documents
from greenframe.llm.units import tokenizer_path
from test_tokens import TEXTS

PARTS = ["ab", "a", "aa", "the", " ", "  ", "in", "ing", "tion", "é", "'s", "12", "!!", "\n", "x", "日", "o", "e", ".", "\0", "\1"]


@pytest.fixture(scope="module")
def coder():
    return prefixes.PrefixIds(tokenizer_path("byte_bpe_50k.tiktoken"), most=300)


@pytest.fixture(scope="module")
def library(coder):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.coder.ranks, special_tokens={})


def test_texts(coder, library, spark, folder):
    texts = [t or "" for t in TEXTS] + [r["text"] for r in documents(spark, folder).limit(60).collect()]
    for got, text in zip(coder.each(texts + texts), texts + texts):
        assert got.tolist() == library.encode_ordinary(text)
        assert prefixes.bytes_of(got.tobytes(), coder.coder.content) == text.encode()


def test_random_texts_and_edits(coder, library):
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randrange(40)))
        ids = np.frombuffer(coder.packed(text), "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        start = rng.randrange(len(text) + 1)
        stop, new = min(len(text), start + rng.randrange(4)), rng.choice(["", *PARTS, " then one"])
        after, again = coder.edited(text, ids, start, stop, new)
        assert after == text[:start] + new + text[stop:] and again.tolist() == library.encode_ordinary(after)


def test_one_piece_grows_and_changes(coder):
    rng, held = random.Random(3), prefixes.PrefixText(coder.coder)
    for _ in range(60):
        held.append("".join(rng.choices(["th", "e", "in", "g", "a"], k=50)).encode())
        assert held.last == coder.coder.last_tokens(held.data)
    redone = held.replace(1000, 1003, b"qu")
    assert held.last == coder.coder.last_tokens(held.data) and redone < 600
    assert b"".join(coder.coder.content[t] for t in held.tokens()) == held.data


def test_any_vocabulary_of_bytes():
    # merges that need their neighbours' order: ties go to the left
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"ba": 259, b"xyz": 260}
    coder = prefixes.PrefixCoder(ranks)
    plain = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choices("abxyz", k=rng.randrange(1, 14)))
        assert coder.encode(text.encode()) == plain.encode_ordinary(text)
    with pytest.raises(ValueError):
        prefixes.PrefixCoder({b"a": 0})


def test_operators(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id here", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = prefixes.decoded(prefixes.encoded(df), to="bytes").collect()
    want = sorted((i if i is not None else -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"])), bytes(r["bytes"])) for r in got) == want
    assert prefixes.encoded(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        prefixes.decoded(prefixes.encoded(df), to="ids")


def test_edits_of_a_table(spark, library):
    df = prefixes.encoded(spark.createDataFrame([(1, "one two three four"), (2, "")], "doc_id long, text string"))
    texts = spark.createDataFrame(
        [(1, "one two three four", 4, 7, "TWO and"), (1, "one two three four", None, None, " five"), (1, "one two three four", 99, 100, "!"), (2, None, 0, 3, None)],
        "doc_id long, text string, start int, stop int, replacement string",
    )
    got = sorted((r["text"], list(np.frombuffer(r["ids"], "<u4"))) for r in prefixes.reencoded(texts.join(df, "doc_id")).collect())
    want = ["", "one TWO and three four", "one two three four five", "one two three four!"]
    assert got == [(t, library.encode_ordinary(t)) for t in want]


def test_query(spark, folder, library):
    import hashlib

    got = {r["doc_id"]: r for r in queries.prefix_tokens(spark, folder).collect()}
    for r in documents(spark, folder).collect():
        ids = library.encode_ordinary(r["text"] or "")
        mine = got[r["doc_id"]]
        assert mine["n_tokens"] == len(ids) and mine["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert mine["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_a_pre_token_is_encoded_once_and_frequent_ones_stay(monkeypatch):
    ids, encoded = prefixes.PrefixIds(tokenizer_path("byte_bpe_50k.tiktoken"), most=300), []
    one = ids.coder.encode_sorted
    monkeypatch.setattr(ids.coder, "encode_sorted", lambda strings: one(encoded.extend(strings) or strings))
    monkeypatch.setattr(ids.coder, "encode", None)  # no text of units goes another way
    units = ["\nzqxworth", "\0zqxworth", "zqxworth$$$", "\nzqxworth$$$", "zqxworth***", "é́zqxworth"]
    got = [np.frombuffer(x, "<u4").tolist() for x in ids.packed_units(units)]
    monkeypatch.undo()
    assert got == [np.frombuffer(ids.packed(prefixes.unit_text(u)), "<u4").tolist() for u in units]
    assert sorted(encoded) == sorted({b"\n", b"zqxworth", b" zqxworth", b"$$$", b"***", " é".encode(), "́".encode()}) and len(encoded) == 7
    encoded.clear()
    monkeypatch.setattr(ids.coder, "encode_sorted", lambda strings: one(encoded.extend(strings) or strings))
    for n in range(60):
        list(ids.each(["begin " + " ".join(f"often wq{chr(97 + n % 26)}{chr(97 + k)}{chr(97 + n // 26)}z" for k in range(20))]))
    assert encoded.count(b" often") == 1 and len(ids.known.codes) <= 300


def test_decoding_of_nulls_empties_and_wrong_ids(library):
    import pyarrow as pa

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    texts = ["", None, "one 日本 two", "", "x" * 900, None, "\n\nend"]
    packed = [None if t is None else np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    for some in (slice(None), slice(1, 6), slice(0, 2), slice(3, 4), slice(0, 0)):
        column = pa.array(packed, pa.binary())[some]
        got = prefixes.bytes_of_each(column, path)
        assert got.type == pa.binary() and got.to_pylist() == [None if t is None else t.encode() for t in texts[some]]
        got.validate(full=True)
    for bad in (np.array([5, 60_000], "<u4").tobytes(), np.array([1 << 31], "<u4").tobytes(), b"\0\0\0"):
        with pytest.raises(ValueError):
            prefixes.bytes_of_each(pa.array([packed[2], bad], pa.binary()), path)
