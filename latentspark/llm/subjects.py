"""Subject areas of documents: term weighting, truncated SVD, seed centroids refined iteratively.

One pass turns the running prose into hashed words by sentence and counts document frequencies over
the whole corpus. The vocabulary is, for each language, the TERMS most frequent words that are neither
rare nor general, so that a rare language keeps its words however large the others are.
The leading right singular vectors of the weighted document-term matrix come from two distributed
passes of subspace iteration (each task sends one vocabulary x rank block, summed by block in steps).
Sentences are embedded by folding in; labelled passages give a seed centroid per subject and language;
each refinement pass assigns all documents and averages their vectors. A document has the subjects
whose sentences make up at least MIN_SHARE of its words.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.latex import prose_sentences
from latentspark.llm.top import smallest
from latentspark.moments import task_group
from latentspark.sources import materialise

TERMS, RANK, EXTRA = 4096, 64, 16
MIN_DF, MAX_DF_SHARE = 3, 0.35
ROUNDS = 2
MIN_COSINE = 0.2
LANGUAGE_PRIOR = 20
MIN_SHARE = 0.18
MAX_LABELLED = 100_000  # labelled passages of which seeds and languages are learnt, chosen by hash
BLOCK_TERMS = 256


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big", signed=True) or 1


class _Hashes(dict):
    def __missing__(self, word):
        value = self[word] = word_hash(word)
        return value


def _is_term(word: str) -> bool:
    return len(word) > 2 and not word.isdigit()


def _some(labelled: DataFrame, text: str) -> DataFrame:
    """At most MAX_LABELLED passages, the same ones whatever the partitioning."""
    return labelled.orderBy(F.xxhash64(text), text).limit(MAX_LABELLED)


def language_words(labelled: DataFrame, lang: str, text: str) -> dict[str, frozenset[str]]:
    """The words of each language's labelled passages (at most MAX_LABELLED), by which a document's
    language is told: stated languages may be missing or wrong."""
    words: dict[str, set[str]] = {}
    for g, t in _some(labelled, text).select(lang, text).collect():
        words.setdefault((g or "").strip().lower(), set()).update(w for s in prose_sentences(t or "") for w in s)
    return {g: frozenset(w) for g, w in sorted(words.items())}


def prose_hashes(docs: DataFrame, doc_id: str, text: str, languages: dict[str, frozenset[str]]) -> DataFrame:
    """(doc, ids, df, lang): the hashed words of each document's prose, 0 after each sentence; and,
    per task and language, one row of document frequencies with df set."""
    doc_type = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages = sent.value
        hashes, seen, count = _Hashes(), {g: Counter() for g in names}, Counter()
        for b in batches:
            out, lang = [], []
            for t in b["text"]:
                ids: list[int] = []
                distinct: set[str] = set()
                for s in prose_sentences(t) if t else ():
                    ids += [hashes[w] for w in s]
                    ids.append(0)
                    distinct.update(s)
                g = max(names, key=lambda g: len(languages[g] & distinct)) if languages else ""
                seen[g].update(distinct)
                count[g] += bool(ids)
                out.append(np.array(ids, dtype=np.int64))
                lang.append(g)
            yield pd.DataFrame({"doc": b["doc"], "ids": out, "df": None, "lang": lang})
        for g in names:
            kept = {hashes[w]: n for w, n in seen[g].items() if _is_term(w)}
            yield pd.DataFrame({"doc": [None], "ids": [np.array([0, *kept], dtype=np.int64)], "df": [np.array([count[g], *kept.values()], dtype=np.int64)], "lang": [g]})

    names = sorted(languages) or [""]
    schema = f"doc {doc_type}, ids array<bigint>, df array<bigint>, lang string"
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(run, schema)


@dataclass
class Space:
    """hashes: sorted word hashes; idf; vectors: words x rank, already times idf."""

    hashes: np.ndarray
    idf: np.ndarray
    vectors: np.ndarray | None = None

    def terms(self, ids: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for other words."""
        if not len(self.hashes):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.hashes, ids), len(self.hashes) - 1)
        return np.where(self.hashes[at] == ids, at, -1)

    def embed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, words, vector lengths) of the sentences in ``ids`` (each ended by 0)."""
        ends = np.flatnonzero(ids == 0)
        words = np.diff(ends, prepend=-1) - 1
        x = np.zeros((len(ends), self.vectors.shape[1]), dtype=np.float32)
        terms = self.terms(ids)
        at = np.flatnonzero(terms >= 0)  # only these words have a vector
        if len(at):
            sentence = np.searchsorted(ends, at)
            first = np.flatnonzero(np.diff(sentence, prepend=-1))
            x[sentence[first]] = np.add.reduceat(self.vectors[terms[at]], first, axis=0)
        length = np.linalg.norm(x, axis=1)
        x /= np.maximum(length, 1e-9)[:, None]
        return x, words, length


def vocabulary(ids: DataFrame, terms: int = TERMS) -> Space:
    """At most ``terms`` words of each language reach the driver: by document frequency, ties by hash. A
    word belongs to the language that has it in the largest share of its documents.

    A word's weight is the inverse of that share, so that general words of a rare language weigh as
    little as those of a frequent one."""
    pairs = ids.filter("df IS NOT NULL").select("lang", F.explode(F.arrays_zip("ids", "df")).alias("p"))
    sums = pairs.groupBy(F.col("p.ids").alias("w"), "lang").agg(F.sum("p.df").alias("n"))
    docs = sums.filter("w = 0").select("lang", F.col("n").alias("docs"))  # one row per language
    share = F.col("n") / (F.col("docs") + LANGUAGE_PRIOR)
    words = sums.filter("w <> 0").join(F.broadcast(docs), "lang").groupBy("w")
    words = words.agg(F.sum("n").alias("n"), F.max(share).alias("share"), F.max_by("lang", F.struct(share, F.col("lang"))).alias("lang"))
    able = words.filter((F.col("n") >= MIN_DF) & (F.col("share") <= MAX_DF_SHARE))
    able = able.select("lang", F.col("w").alias("word"), "share", (-F.col("n")).alias("rare"))
    kept = [(r["word"], r["share"]) for r in smallest(able, "lang", ["rare", "word"], terms).collect()]
    kept.sort()
    idf = -np.log(np.array([share for _, share in kept], dtype=float))
    return Space(np.array([w for w, _ in kept], dtype=np.int64), idf.astype(np.float32))


def _gram_times(ids: DataFrame, space: Space, right: np.ndarray) -> np.ndarray:
    """X'X right over all documents, X their unit log-tf-idf rows; only the words that occur are touched."""
    sent = ids.sparkSession.sparkContext.broadcast(cloudpickle.dumps((space, right.astype(np.float32))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, right = pickle.loads(sent.value)
        total, terms = np.zeros(right.shape, dtype=np.float64), len(space.hashes)
        for b in batches:
            docs = list(b["ids"])
            for at in range(0, len(docs), 256):
                part = docs[at : at + 256]
                flat = space.terms(np.concatenate(part))
                owner = np.repeat(np.arange(len(part)), [len(p) for p in part])
                seen = flat >= 0
                cells, n = np.unique(owner[seen] * terms + flat[seen], return_counts=True)
                if not len(cells):
                    continue
                doc, term = cells // terms, cells % terms
                x = np.log1p(n).astype(np.float32) * space.idf[term]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                rows = np.cumsum(np.diff(doc, prepend=-1) != 0) - 1
                x /= np.maximum(np.sqrt(np.add.reduceat(x * x, first)), 1e-9)[rows]
                y = np.add.reduceat(x[:, None] * right[term], first, axis=0)
                order = np.argsort(term, kind="stable")
                cut = np.flatnonzero(np.diff(term[order], prepend=-1))
                total[term[order][cut]] += np.add.reduceat(x[order, None] * y[rows[order]], cut, axis=0)
        blocks = range(0, len(total), BLOCK_TERMS)
        yield pd.DataFrame(
            {"block": [k // BLOCK_TERMS for k in blocks], "part": task_group(), "data": [total[k : k + BLOCK_TERMS].astype(np.float32).tobytes() for k in blocks]}
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(pdf["data"].iloc[0], dtype=np.float32).astype(np.float64)
        for d in pdf["data"].iloc[1:]:
            data += np.frombuffer(d, dtype=np.float32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "data": [data.astype(np.float32).tobytes()]})

    schema = "block int, part int, data binary"
    parts = ids.filter("df IS NULL").select("ids").mapInPandas(run, schema)
    parts = parts.groupBy("block", "part").applyInPandas(add, schema)
    out = np.zeros(right.shape)
    for r in parts.toLocalIterator():  # vocabulary / BLOCK_TERMS x tasks / FAN_IN blocks
        rows = np.frombuffer(r["data"], dtype=np.float32).reshape(-1, right.shape[1])
        out[r["block"] * BLOCK_TERMS : r["block"] * BLOCK_TERMS + len(rows)] += rows
    return out


def fit_space(ids: DataFrame, rank: int = RANK) -> Space:
    """Vocabulary and truncated SVD (randomised subspace iteration with a Rayleigh-Ritz step)."""
    space = vocabulary(ids)
    v = len(space.hashes)
    k = min(v, rank + EXTRA)
    if not v:
        space.vectors = np.zeros((0, 1), dtype=np.float32)
        return space
    start = np.linalg.qr(np.random.default_rng(0).standard_normal((v, k)))[0]
    q = np.linalg.qr(_gram_times(ids, space, start))[0]
    small = q.T @ _gram_times(ids, space, q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    space.vectors = (q @ turn[:, best] * space.idf[:, None]).astype(np.float32)
    return space


@dataclass
class Centroids:
    names: list[str]  # subject of each centroid
    seeds: np.ndarray
    vectors: np.ndarray

    def assign(self, x: np.ndarray, length: np.ndarray, least: float = MIN_COSINE) -> np.ndarray:
        """Centroid of each unit vector, -1 below the least cosine or without any term."""
        if not len(self.vectors) or not len(x):
            return np.full(len(x), -1)
        cosine = x @ self.vectors.T
        best = cosine.argmax(1)
        return np.where((cosine[np.arange(len(x)), best] >= least) & (length > 0), best, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def seed_centroids(space: Space, labelled: DataFrame, subject: str, lang: str, text: str) -> Centroids:
    """One centroid per subject and language, from at most MAX_LABELLED labelled passages."""
    rows = _some(labelled, text).select(subject, lang, text).collect()
    sums: dict[tuple[str, str], np.ndarray] = {}
    for s, g, t in sorted(rows, key=str):
        ids = [h for sentence in prose_sentences(t or "") for h in [*map(word_hash, sentence), 0]]
        x, _, length = space.embed(np.array(ids, dtype=np.int64))
        if s is not None and len(x):
            key = (s, (g or "").strip().lower())
            sums[key] = sums.get(key, 0) + x[length > 0].sum(0)
    keys = sorted(sums)
    seeds = _unit(np.array([sums[k] for k in keys])) if keys else np.zeros((0, space.vectors.shape[1]), dtype=np.float32)
    return Centroids([k[0] for k in keys], seeds, seeds)


def refine(ids: DataFrame, space: Space, c: Centroids, rounds: int = ROUNDS) -> Centroids:
    """Each round assigns every document to its nearest centroid and moves the centroids to the means
    of their documents, half held by the seeds.

    Whole documents, not sentences: words that only occur beside others of their subject are drawn to
    it, however far their own direction lies from the seeds."""
    rank = space.vectors.shape[1]
    if not len(c.names):
        return c
    for _ in range(rounds):
        sent = ids.sparkSession.sparkContext.broadcast(cloudpickle.dumps((space, c)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            space, c = pickle.loads(sent.value)
            total = np.zeros((len(c.names), rank))
            for b in batches:
                docs = list(b["ids"])
                for at in range(0, len(docs), 256):
                    part = [d for d in docs[at : at + 256] if len(d)]
                    if not part:
                        continue
                    x, _, length = space.embed(np.concatenate(part))
                    first = np.cumsum([0] + [int((d == 0).sum()) for d in part[:-1]])
                    x = np.add.reduceat(x * length[:, None], first, axis=0)
                    length = np.linalg.norm(x, axis=1)
                    x = x / np.maximum(length, 1e-9)[:, None]
                    own = c.assign(x, length)
                    for k in np.unique(own[own >= 0]):
                        total[k] += x[own == k].sum(0)
            yield pd.DataFrame({"k": np.repeat(np.arange(len(total)), rank), "j": np.tile(np.arange(rank), len(total)), "v": total.ravel()})

        sums = ids.filter("df IS NULL").select("ids").mapInPandas(run, "k int, j int, v double").groupBy("k", "j").agg(F.sum("v").alias("v"))
        mean = np.zeros((len(c.names), rank))
        for k, j, v in sums.collect():  # centroids x rank numbers
            mean[k, j] = v
        c = Centroids(c.names, c.seeds, _unit(c.seeds + _unit(mean)))
    return c


def subject_shares(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str, subject: str, lang: str, passage: str, least: float = 0.0) -> DataFrame:
    """(doc_id, subject, share, words): the share of each subject in the words of a document's
    sentences that belong to any subject.

    NULL, empty and prose-less documents have no row, nor do documents without a known word; repeated
    documents come out repeatedly. Without labelled passages the result is empty. Shares below
    ``least`` are left out.
    """
    doc_type = docs.schema[doc_id].dataType.simpleString()
    ids = materialise(prose_hashes(docs, doc_id, text, language_words(labelled, lang, passage)), "prose")
    space = fit_space(ids)
    centroids = refine(ids, space, seed_centroids(space, labelled, subject, lang, passage))
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((space, centroids)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, c = pickle.loads(sent.value)
        subjects = sorted(set(c.names))
        of = np.array([subjects.index(n) for n in c.names] or [0])
        for b in batches:
            docs, out = list(b["ids"]), []
            for at in range(0, len(docs), 256):
                part = docs[at : at + 256]
                x, words, length = space.embed(np.concatenate(part))
                owner = np.repeat(np.arange(len(part)), [int((p == 0).sum()) for p in part])
                own = c.assign(x, length)
                # sentences without any word of a subject speak for none: shares are of the others
                total = np.bincount(owner[own >= 0], words[own >= 0], minlength=len(part))
                mine = own >= 0
                each = np.bincount(owner[mine] * len(subjects) + of[own[mine]], words[mine], minlength=len(part) * len(subjects))
                share = each.reshape(len(part), -1) / np.maximum(total, 1)[:, None]
                for d, s in zip(*np.nonzero((share > 0) & (share >= least))):
                    out.append((b["doc"].iloc[at + d], subjects[s], float(share[d, s]), int(total[d])))
            if out:
                yield pd.DataFrame(out, columns=["doc", "subject", "share", "words"])

    found = ids.filter("df IS NULL").select("doc", "ids").mapInPandas(run, f"doc {doc_type}, subject string, share double, words bigint")
    return found.select(F.col("doc").alias(doc_id), "subject", "share", "words")
