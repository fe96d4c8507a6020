"""Operators on token ids against the library itself."""

import zlib
from functools import cache

import numpy as np
import pytest
from greenframe.llm import counting, packing, records
from greenframe.llm.common import documents
from greenframe.llm.units import LibraryIds, tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "\n", "  a  b ", "It's  we'll\n\nsee 12345 ½ é́ x  y \t\r\n z", "<|endoftext|>", "one <|endoftext|>two  <|endoftext|> <|startoftext|>x", "İstanbul ΣΑΣ ß\x1cq \x00 \x00a",
    "word " * 3000 + "end", "\nstart", "a\nb c\nd", "日本語 テキスト 😀👍🏽 naïve", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "!!!\x1c?? ..", "a ́b", "　x  y", "It's  we'll",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id here", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


@cache
def loaded(name):
    return Tokenizer.from_file(tokenizer_path(name))


def library(name, text):
    return np.array(loaded(name).encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_remembered_units_give_the_same_ids(name, drops, folder, spark):
    ours = LibraryIds(tokenizer_path(name), drops, most=300)
    some = [t or "" for t in TEXTS] + [r["text"] for r in documents(spark, folder).limit(40).collect()]
    for text in some + some:
        assert ours.ids(text).tolist() == library(name, text).tolist()


def test_counts_are_the_librarys(table, spark, folder):
    for df in (table, documents(spark, folder)):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        rows = counting.token_counts(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            text = texts[r["doc_id"]] or ""
            n = len(library("byte_bpe_50k.json", text))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def check_packing(df, rows, capacity):
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, text in texts.items():
        ids = np.append(library("byte_bpe_50k.json", text), 0).astype("<u4")
        pieces = sorted({(p, r["start"], r["length"], r["ids_crc32"]) for (d, p), rs in by_document.items() if d == doc_id for r in rs})
        assert [p for p, *_ in pieces] == list(range(-(-len(ids) // capacity)))
        assert sum(n for _, _, n, _ in pieces) == len(ids) and all(n == capacity for _, _, n, _ in pieces[1:])
        for _, start, n, crc in pieces:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    return len(by_sequence)


def test_packing(table, spark, folder):
    for df in (table, documents(spark, folder)):
        rows = packing.packed_documents(df).collect()
        sequences = check_packing(df, rows, 2048)
        assert sequences <= -(-sum(r["length"] for r in rows) // 2048) + 1  # at most one more than tokens need


def test_bins_are_the_fullest():
    assert packing.fullest({7: 1, 6: 2, 5: 1, 2: 1}, [7, 6, 5, 2], 15, 7) == {7: 1, 6: 1, 2: 1}
    rng = np.random.default_rng(1)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 40, 12), rng.integers(1, 5, 12))}
        patterns = packing.minimum_slack(counts, 40)
        used = {}
        for p in patterns:
            assert sum(k * n for k, n in p.lengths.items()) <= 40
            for k, n in p.lengths.items():
                used[k] = used.get(k, 0) + n * p.bins
        assert used == counts
    assert packing.minimum_slack({}, 8) == []
    with pytest.raises(ValueError):
        packing.minimum_slack({9: 1}, 8)


def test_empty_table(table):
    none = table.filter("false")
    assert packing.packed_documents(none).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.packed_documents(none).count() == records.stored_tokens(none).count() == counting.token_counts(none).count() == 0


def test_records(table, spark, folder):
    for df in (table, documents(spark, folder)):
        rows = sorted(records.stored_tokens(df).collect(), key=lambda r: r["start"])
        given = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
        assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in given]
        start = 0
        for r, g in zip(rows, given):
            ids = np.append(library("word_bpe_49k.json", g["text"]), 1).astype("<u4")
            assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
            start += len(ids)


def test_damage_is_found():
    import io

    whole = records.frame(records.payload_of(7, np.array([1, 70000], "<u4")))
    doc_id, ids = records.content_of(records.read_record(io.BytesIO(whole)))
    assert doc_id == 7 and ids.tolist() == [1, 70000]
    for i in range(len(whole)):
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1 :]))


def test_records_by_their_index(spark, table, tmp_path):
    folder = str(tmp_path / "records")
    rows = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    records.write_records(rows, folder, "word_bpe_49k.json", True, 1, partitions=2)
    in_order = records.read_records(spark, folder).collect()
    drawn = {seed: records.read_records(spark, folder, seed).collect() for seed in (1, 2)}
    key = lambda r: (r["start"], r["doc_id"] or 0, tuple(r["ids"]))
    for seed, got in drawn.items():
        assert sorted(map(key, got)) == sorted(map(key, in_order))
        assert [key(r) for r in got] == [key(r) for r in records.read_records(spark, folder, seed).collect()]
    assert [key(r) for r in drawn[1]] != [key(r) for r in drawn[2]] != [key(r) for r in in_order]
    for index in sorted((tmp_path / "records").glob("*.idx")):
        good = index.read_bytes()
        numbers = np.frombuffer(good, "<u8").reshape(-1, 2)
        for row, column in ((1, 0), (0, 0), (len(numbers) - 1, 0), (1, 1)):
            bad = numbers.copy()
            bad[row, column] += 3
            index.write_bytes(bad.tobytes())
            for seed in (None, 5):
                with pytest.raises(Exception, match="wrong|damaged|does not end"):
                    records.read_records(spark, folder, seed).collect()
        index.write_bytes(good[:-16])
        with pytest.raises(Exception, match="in the index"):
            records.read_records(spark, folder).collect()
        index.write_bytes(good)


def test_new_units_go_to_the_library_together_and_frequent_ones_stay(monkeypatch):
    ours = LibraryIds(tokenizer_path("byte_bpe_50k.json"), False, most=300)
    calls, one = [], ours._encode
    monkeypatch.setattr(ours, "_encode", lambda texts: calls.extend(texts) or one(texts))
    odd = ["<|endoftext|>", "\nx<|endoftext|>y", "'s", "\n'll", "½é́", "\nß,", "12.", "日本.", "a<|b", "\n<|endoftext|>", "z."]
    texts = ["start" + "".join(x if x[0] == "\n" else f" {x}" for n in range(k, k + 200) for x in (f"w{n}q", f"\nv{n}", odd[n % len(odd)])) for k in range(0, 1000, 100)]
    for i, text in enumerate([*texts, texts[0]]):
        assert ours.ids(text).tolist() == library("byte_bpe_50k.json", text).tolist()
        assert len(ours.known.codes) <= 700  # ``most`` or one batch
        if not i:
            assert len(calls) < 40  # about 400 new units
    calls.clear()
    for n in range(40):  # a frequent word is not forgotten when new ones fill the memory
        text = "start " + " ".join(f"often w{n}x{k}" for k in range(20))
        assert ours.ids(text).tolist() == library("byte_bpe_50k.json", text).tolist()
    assert sum("often" in x for x in calls) == 1
