"""Prediction by partial matching against a plain version with dictionaries, and the word baseline."""

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pytest
from greenframe.llm import scoring
from greenframe.llm.common import documents


@dataclass
class Model:
    """A small trie in memory, to compare with. ``follow[node, class]``: the longer context that a byte before ``node`` leads to, 0 if unknown. ``log10[node, class]``."""

    classes: np.ndarray  # class of each symbol
    follow: np.ndarray
    log10: np.ndarray
    order: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        symbols = scoring.sequence(texts, self.order)
        classes = self.classes[symbols]
        width = self.log10.shape[1]
        inner = np.arange(self.order, len(symbols))
        node, alive = np.zeros(len(inner), np.int64), np.ones(len(inner), bool)
        follow = self.follow.ravel()
        for j in range(1, self.order + 1):
            longer = follow[node * width + classes[self.order - j : len(symbols) - j]]
            alive &= longer > 0
            node = np.where(alive, longer, node)
        cost = self.log10.ravel()[node * width + classes[self.order :]].astype(np.float64)
        cost[symbols[self.order :] == scoring.START] = 0.0
        begins = np.cumsum([0, *(len(t) + self.order + 1 for t in texts)])[:-1]
        return np.add.reduceat(cost, begins)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def model_of(levels: list[Level], order: int = scoring.ORDER) -> Model:
    """``levels[k]``: contexts of k symbols, symbols, counts, side by side. Each context's shorter ones must be there too."""
    low = (1 << scoring.BITS) - 1
    seen = np.unique(np.concatenate([s for _, s, _ in levels] + [c & low for c, _, _ in levels[1:]])).astype(np.int64)
    classes = np.full(1 << scoring.BITS, len(seen) + 1)  # all symbols never seen are alike
    classes[seen] = np.arange(len(seen))
    classes[scoring.START] = classes[scoring.START] if scoring.START in seen else len(seen)
    width = len(seen) + 2
    known, offset = np.zeros(1, np.int64), 0  # contexts of the level before, and its first node
    follows, logs = [np.zeros((1, width), np.int32)], []
    before = after = None  # dense counts of the level before; chances after escaping from it
    for k, (context, symbol, n) in enumerate(levels):
        contexts = np.unique(context) if len(context) or k else np.zeros(1, np.int64)
        counts = np.zeros((len(contexts), width))
        counts[np.searchsorted(contexts, context), classes[symbol]] = n
        there = counts > 0
        total, kinds = counts.sum(1), there.sum(1)
        if k == 0:
            escaped = np.full((1, width), 1.0 / max(1, scoring.SYMBOLS - int(kinds[0])))
        else:
            up = np.searchsorted(known, contexts & (1 << scoring.BITS * (k - 1)) - 1)
            n_up = before[up]
            left = (n_up * ~there).sum(1)
            kinds_left = ((n_up > 0) & ~there).sum(1)
            all_ = np.maximum(left + kinds_left, 1e-300)
            onward = np.where(left + kinds_left > 0, kinds_left / all_, 1.0)
            escaped = np.where(n_up > 0, n_up / all_[:, None], onward[:, None] * after[up])
            offset += len(before)
            follows.append(np.zeros((len(contexts), width), np.int32))
            follows[k - 1][up, classes[contexts >> scoring.BITS * (k - 1)]] = offset + np.arange(len(contexts))
            known = contexts
        every = np.maximum(total + kinds, 1)
        escape = np.where(kinds > 0, kinds / every, 1.0)
        chance = np.where(there, counts / every[:, None], escape[:, None] * escaped)
        logs.append(np.log10(np.maximum(chance, 1e-300)).astype(np.float32))
        before, after = counts, escaped
    return Model(classes, np.concatenate(follows), np.concatenate(logs), order)


def plain_ppm(training, order):
    tables = [defaultdict(Counter) for _ in range(order + 1)]
    for text in training:
        s = [scoring.START] * order + [*text.lower()] + [scoring.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                tables[k][tuple(s[i - k : i])][s[i]] += 1

    def chance(context, symbol):
        excluded, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = tables[k].get(tuple(context[order - k :]))
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            if left:
                p *= len(left) / total
            excluded |= set(left)
        return p / (scoring.SYMBOLS - len(excluded))

    def score(text):
        s = [scoring.START] * order + [*text.lower()] + [scoring.END]
        return sum(math.log10(chance(s[i - order : i], s[i])) for i in range(order, len(s)))

    return score, chance


def baseline(training, text):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", t.lower()) + [None]
    counts = Counter(w for t in training for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return len(words(text)), sum(counts[w] > 0 for w in words(text)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(text))


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(df, rows, order, frequent, monkeypatch):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    training = [(t or "").encode() for i, t in rows if not is_held_out(i)]
    score, _ = plain_ppm(training, order)
    got = sorted(([r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]] for r in scoring.scored_documents(df, order=order).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    want = []
    for i, t in rows:
        text = (t or "").encode()
        tokens, known, n, base = baseline(training, text)
        want.append([i, is_held_out(i), tokens, known, n, base, score(text)])
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_against_plain_version(spark, monkeypatch):
    rows = [(i, f"The {i % 3} cat sat on the mat number {i * 7}. É {'z' * (i % 5)}") for i in range(30)]
    rows += [(40, None), (41, ""), (None, "no id"), (42, "abc \t\nDEF"), (42, "abc \t\nDEF"), (43, "unseen ß \x00 bytes 語"), (44, "w" * 3000), (45, "rare" * 40 + " the")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    check(df, rows, 2, 100_000, monkeypatch)
    check(df, rows, 4, 2, monkeypatch)
    assert scoring.scored_documents(df.filter("false")).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    only = scoring.scored_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert only[0]["score"] == pytest.approx(3 * math.log10(1 / 257), rel=1e-5) and only[0]["n_known"] == 0


def test_chances_add_up_to_one():
    levels = [[(0, 97, 3), (0, 98, 2), (0, 256, 1)], [(97, 98, 2), (98, 256, 1)], [(97 << 9 | 97, 98, 1)]]
    model = model_of([tuple(np.array(level).T) for level in levels], 2)
    for node in range(len(model.log10)):
        assert sum(10.0 ** model.log10[node, model.classes[s]] for s in range(scoring.SYMBOLS)) == pytest.approx(1, rel=1e-5)


def test_held_out_texts(spark, folder):
    docs = documents(spark, folder)
    total = lambda **more: sum(r["score"] for r in scoring.scored_documents(docs, **more).filter("held_out").collect())
    longer, shorter = total(), total(order=1)
    assert longer > 0.9 * shorter and longer > 0.7 * total(order=0)


def test_contexts_stay_however_rare(spark):
    # each context of order 3 makes up less than 2^-16 of the text
    rows = [(i, f"{i * 7919 % 100_003:05d}") for i in range(15_000)]
    score, _ = plain_ppm([t.encode() for i, t in rows if not is_held_out(i)], 4)
    got = scoring.scored_documents(spark.createDataFrame(rows, "doc_id long, text string"), order=4).filter("doc_id < 300")
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx({i: score(t.encode()) for i, t in rows[:300]}, rel=1e-5)


def test_places_of_codes():
    rng = np.random.default_rng(4)
    for codes in (np.zeros(0, np.int64), np.array([0]), np.arange(20_000) << scoring.BITS, rng.permutation(np.unique(rng.integers(0, 1 << 54, 50_000)))):
        places = scoring.Places(codes)
        wanted = rng.integers(0, len(codes), 100_000) if len(codes) else np.zeros(0, np.int64)
        assert (places.of(codes[wanted]) == wanted).all()
        with pytest.raises(KeyError):
            places.of(np.array([(1 << 54) + 1]))
