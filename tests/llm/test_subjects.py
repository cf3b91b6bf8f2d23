"""Subjects: held-out documents of planted vocabularies, and the space itself."""

import random

import numpy as np
import pytest

from latentspark.llm import subjects

RND = random.Random(5)
TOPICS = {t: [f"{t}{chr(97 + i)}{chr(98 + i)}" for i in range(20)] for t in ("law", "bio", "phy", "geo", "art")}
GENERAL = [f"gen{chr(97 + i)}x" for i in range(25)]


def sentence(topic):
    words = [RND.choice(TOPICS[topic]) for _ in range(4)] + [RND.choice(GENERAL) for _ in range(6)]
    RND.shuffle(words)
    return " ".join(words) + "."


def test_shares_of_mixed_documents(spark):
    plans = [{"law": 12}, {"bio": 12}, {"phy": 12}, {"law": 6, "bio": 6}, {"phy": 11, "law": 1}, {"geo": 12}, {"art": 12}, {"geo": 8, "art": 4}] * 30
    docs = []
    for i, plan in enumerate(plans):
        parts = [sentence(t) for t, n in plan.items() for _ in range(n)]
        RND.shuffle(parts)
        docs.append((i, "\\documentclass{a}\\begin{document}" + "\n".join(parts) + "\\end{document}", "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "\\documentclass{a} % law", "x"), (903, docs[0][1] * 50, "x"), (0, docs[0][1], "x")]
    labelled = [(t, "en", " ".join(sentence(t) for _ in range(3))) for t in TOPICS for _ in range(3)] + [(None, "en", "none"), ("law", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labelled, "subject string, lang string, passage string")
    got = subjects.subject_shares(d, lab, "doc_id", "text", "subject", "lang", "passage", subjects.MIN_SHARE).collect()
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.subject)
    right = sum(sorted(set(found.get(i, []))) == sorted(t for t, n in plan.items() if n > 2) for i, plan in enumerate(plans))
    assert right >= 0.95 * len(plans)
    assert not {900, 901, 902} & set(found) and found[903] == ["law"] and found[0] == ["law", "law"]


def test_singular_vectors_equal_numpy(spark):
    texts = [" ".join(sentence(t) for _ in range(6)) for t in TOPICS for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = subjects.prose_hashes(d, "doc_id", "text", {})
    space = subjects.fit_space(ids, rank=5)
    x = np.zeros((len(texts), len(space.hashes)))
    for i, t in enumerate(texts):
        for w in t.split():
            k = space.terms(np.array([subjects.word_hash(w.strip("."))]))[0]
            if k >= 0:
                x[i, k] += 1
    x = np.log1p(x) * space.idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    exact = np.linalg.svd(x)[1][:5]
    v = space.vectors / space.idf[:, None]
    np.testing.assert_allclose(np.linalg.norm(x @ v, axis=0), exact, rtol=0.02)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    lab = spark.createDataFrame([("law", "en", "some words")], "subject string, lang string, passage string")
    for docs, known in ((d.limit(0), lab), (d, lab.limit(0)), (d, lab)):
        assert subjects.subject_shares(docs, known, "doc_id", "text", "subject", "lang", "passage").count() == 0


@pytest.mark.parametrize("ids, words", [([0], [0]), ([5, 6, 0, 0, 5, 0], [2, 0, 1])])
def test_embedding_counts_words(ids, words):
    space = subjects.Space(np.array([5, 6], dtype=np.int64), np.ones(2, dtype=np.float32), np.eye(2, dtype=np.float32))
    x, n, length = space.embed(np.array(ids, dtype=np.int64))
    assert n.tolist() == words and len(x) == len(words) and (length[n == 0] == 0).all()
