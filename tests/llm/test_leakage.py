"""Items in documents: the search against brute force over all pairs."""

import pickle
import random

import numpy as np
import pytest

from latentspark.llm import leakage

RND = random.Random(7)
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def item(n=40):
    return [RND.choice(WORDS) for _ in range(n)]


def changed(words, every, kind):
    out = []
    for i, w in enumerate(words):
        if i % every == every - 1:
            if kind == "added":
                out += [w, "other"]
            elif kind == "changed":
                out.append("other")
        else:
            out.append(w)
    return out


def test_against_brute_force(spark):
    items = [item() for _ in range(30)]
    noise = lambda n: [RND.choice(WORDS) for _ in range(n)]
    docs = []
    for k, w in enumerate(items):
        docs += [noise(60) + w + noise(60), noise(30) + w[5:17] + noise(30), noise(30) + w[5:16] + noise(30)]
        docs += [noise(20) + changed(w, 9, kind) + noise(20) for kind in ("added", "changed", "left")]
        docs += [noise(20) + changed(w, 3, "changed") + noise(20), noise(200)]
    texts = [" ".join(d) for d in docs] + [None, "", "x " * 200_000]
    d = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id long, text string, ids string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, item_text string")
    got = sorted(tuple(r)[:2] for r in leakage.leaks(d, i, "doc_id", "text", "item_id", "item_text").collect())
    split = sorted(tuple(r)[:2] for r in leakage.leaks(d, i, "doc_id", "text", "item_id", "item_text", group_words=500).collect())
    assert split == got  # more groups of items, the same pairs
    code = {w: k + 1 for k, w in enumerate(WORDS)}
    number = lambda ws: np.array([code.get(w, 0) for w in ws])
    want = sorted((n, k) for n, t in [*enumerate(texts), (0, texts[0])] for k, w in enumerate(items) if leakage.carries(number((t or "").split()[:2000]), number(w)))
    assert got == want and len(got) >= 30 * 5


@pytest.mark.parametrize("n, found", [(11, False), (12, True)])
def test_twelve_words_in_a_row(n, found):
    w = np.arange(1, 41)
    assert leakage.carries(np.concatenate([[0, 0], w[3 : 3 + n], [0]]), w) is found


def test_loose_runs():
    w = np.arange(1, 61)
    assert leakage.carries(np.where(w % 9 == 0, 0, w), w)
    assert not leakage.carries(np.where(w % 4 == 0, 0, w), w)
    assert leakage.carries(np.delete(w, np.arange(8, 60, 10)), w)
    assert not leakage.has_loose_run("M" * 24) and leakage.has_loose_run("M" * 25)


def test_nothing_to_find(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(item()))], "item_id long, item_text string")
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d, i)):
        assert leakage.leaks(docs, items, "doc_id", "text", "item_id", "item_text").count() == 0


def index_of(items, documents=1000):
    vocabulary: dict = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in i], dtype=np.int32) for i in items]
    df = np.random.default_rng(1).integers(1, documents, len(vocabulary) + 1).astype(float)
    return leakage.Index(leakage.Items(list(range(len(items))), words, vocabulary), documents, df), df


@pytest.mark.parametrize("tier, direct", [(4096, 4_000_000), (20, 4_000_000), (4096, 10)])
def test_skipping_loses_no_pair_above_a_threshold(monkeypatch, tier, direct):
    monkeypatch.setattr(leakage, "TIER", tier)
    monkeypatch.setattr(leakage, "DIRECT", direct)
    rng = np.random.default_rng(3)
    common = [[WORDS[int(k)] for k in rng.zipf(1.3, n) % 300] for n in rng.integers(5, 60, 120)]
    index, df = index_of(common)
    idf = np.log(1 + (1000 - df + 0.5) / (df + 0.5)) + 0.01
    mean = np.mean([len(w) for w in index.item_words])
    docs = [rng.integers(0, len(df), 48).astype(np.int32) for _ in range(40)] + [w[:48] for w in index.item_words[:40]]
    want = set()
    for d, words in enumerate(docs):
        for i, w in enumerate(index.item_words):
            terms, tf = np.unique(w, return_counts=True)
            impact = dict(zip(terms.tolist(), idf[terms] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))))
            if sum(impact.get(t, 0.0) for t in set(words[words > 0].tolist())) >= index._threshold(w, impact):
                want.add((d, i))
    assert set(index.search(docs)) == want and len(want) > 40


def test_a_large_index_stays_small():
    rng = np.random.default_rng(4)
    items = [[f"x{k}" for k in rng.integers(0, 50_000, 40)] for _ in range(5_000)]
    index, _ = index_of(items)
    assert len(pickle.dumps(index)) < 100 * 5_000 * 40
    assert {p for p in index.search([index.item_words[7], index.item_words[4321]])} >= {(0, 7), (1, 4321)}


def test_overlap_of_question_and_answer_is_reported(spark):
    w = item(30)
    text = " ".join(w)
    d = spark.createDataFrame([(1, f"{text} the answer is Hash-Tables indeed"), (2, text), (3, " ".join(w[:15]))], "doc_id long, text string")
    i = spark.createDataFrame([(5, text + r"\footnote{" + text + "}", "hashtables"), (6, text, None)], "item_id long, item_text string, answer string")
    got = {(r.doc_id, r.item_id): (r.longest_run, round(r.question_share, 2), r.answer_found) for r in leakage.leaks(d, i, "doc_id", "text", "item_id", "item_text", "answer").collect()}
    assert got == {(1, 5): (30, 1.0, True), (2, 5): (30, 1.0, False), (3, 5): (15, 0.5, False), (1, 6): (30, 1.0, None), (2, 6): (30, 1.0, None), (3, 6): (15, 0.5, None)}


def test_every_stream_of_an_item_counts(spark):
    w, note = item(20), item(20)
    d = spark.createDataFrame([(1, " ".join(note))], "doc_id long, text string")
    i = spark.createDataFrame([(5, " ".join(w) + r"\footnote{" + " ".join(note) + "}")], "item_id long, item_text string")
    assert [r.item_id for r in leakage.leaks(d, i, "doc_id", "text", "item_id", "item_text").collect()] == [5]
