"""Test items inside a training corpus: a BM25 index of the items, block-max WAND, exact verification.

One pass turns each document into the ids of its typeset words that occur in any item (other words
are 0), together with document frequencies over the whole corpus; it is written to the shared folder.
A second pass queries the index with every passage of every document. Posting lists name, per word,
the blocks of items that have it, with the word's largest impact in the block, and the items with
their own. A passage's words are ordered by their largest impact anywhere; those before a
block's pivot, which even together stay below its threshold, are not followed. The blocks that are left
are bounded by the sum of their block maxima, and only what passes is scored item by item. What scores
above an item's threshold is verified word by word; of verified pairs the covered words of the question
and the presence of the answer are told.

The threshold of an item is the smallest score that any stretch which must be found can have, so the
search loses nothing that the verification would accept. Test items are taken in groups of at most
GROUP_WORDS words, which bounds what is sent to all tasks; more items mean more groups, not fewer items.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latentspark.llm.latex import reading_streams
from latentspark.sources import materialise

GROUP_WORDS = 1_000_000  # of items in one index: about 60 bytes each in a task
TIER, BLOCK, STEP = 4096, 4, 8  # items that share posting lists, and a bound; words bounded at a time
K1, B = 1.2, 0.75
PASSAGE, STRIDE = 48, 24
EXACT_RUN, LOOSE_RUN, EDITS_PER_WORD = 12, 25, 1 / 8
STREAM_END = -1
DIRECT = 4_000_000  # cells of a table that is addressed directly; larger ones are searched in sorted order
SURE_RUN = 5


@dataclass
class Items:
    """Streams of test items as word ids 1..V. ids: the caller's item id of each stream (an item with
    notes or comments has several). answers: word ids of the item's answer."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    answers: list[np.ndarray] = field(default_factory=list)


def read_items(items: DataFrame, item_id: str, text: str, answer: str | None = None, group_words: int | None = None) -> Iterator[Items]:
    """The items in groups of at most ``group_words`` words (or of one item), read one group at a time;
    NULL and wordless items have no words."""
    most = group_words or GROUP_WORDS
    now, total = Items([], [], {}), 0
    columns = [F.col(item_id), F.col(text), F.col(answer) if answer else F.lit(None).cast("string")]
    for i, t, a in items.select(*columns).orderBy(item_id).toLocalIterator():
        streams, said = reading_streams(t or ""), [w for s in reading_streams(a or "") for w in s]
        size = sum(map(len, streams))
        if total and total + size > most:
            yield now
            now, total = Items([], [], {}), 0
        total += size
        coded = [np.array([now.vocabulary.setdefault(w, len(now.vocabulary) + 1) for w in s], dtype=np.int32) for s in (*streams, said)]
        for s in coded[:-1]:
            now.ids.append(i)
            now.words.append(s)
            now.answers.append(coded[-1])
    if now.ids:
        yield now


def word_ids(docs: DataFrame, doc_id: str, text: str, items: Items) -> DataFrame:
    """(doc, ids, df): document rows with df NULL, and per task one row of document frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)
    gap = max([len(w) for w in items.words] or [1])
    doc_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        count = 0
        get = sent.value.get
        for b in batches:
            out = []
            for t in b["text"]:
                stream: list[int] = []
                for s in reading_streams(t) if t else ():
                    stream += [get(w, 0) for w in s]
                    stream.append(STREAM_END)
                seen.update(set(stream))
                # foreign stretches longer than any item can bridge are cut to that length
                a = np.array(stream, dtype=np.int32)
                if len(a):
                    zero = a == 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], zero.astype(np.int8), [0]])))
                    drop = np.zeros(len(a), dtype=bool)
                    for x, y in zip(edge[::2], edge[1::2]):
                        if y - x > gap:
                            drop[x + gap : y] = True
                    a = a[~drop]
                out.append(a)
            count += len(b)
            yield pd.DataFrame({"doc": b["doc"], "ids": out, "df": None})
        seen.pop(0, None)
        seen.pop(STREAM_END, None)
        yield pd.DataFrame({"doc": [None], "ids": [np.array([0, *seen.keys()], dtype=np.int32)], "df": [np.array([count, *seen.values()], dtype=np.int64)]})

    schema = f"doc {doc_type}, ids array<int>, df array<bigint>"
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(run, schema)


def document_frequencies(ids: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """(documents, frequency by word id); at most one row per word of the index reaches the driver."""
    pairs = ids.filter("df IS NOT NULL").select(F.explode(F.arrays_zip("ids", "df")).alias("p"))
    sums = pairs.groupBy(F.col("p.ids").alias("w")).agg(F.sum("p.df").alias("n"))
    out, docs = np.zeros(size + 1), 0
    for w, n in sums.collect():
        if w == 0:
            docs = n
        else:
            out[w] = n
    return docs, out


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of every position in the ranges."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; sorting is far faster than hashing here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Tier:
    """Posting lists of up to TIER item streams with similar thresholds.

    A posting is (word, item, impact), sorted by word and item; items are numbered in order of their
    thresholds, so that a block is BLOCK neighbours. ``pairs`` are the (word, block) that occur, with
    the largest impact in each and where their items' postings begin."""

    def __init__(self, streams: np.ndarray, impacts: Sequence[tuple[np.ndarray, np.ndarray]], threshold: np.ndarray, words: int):
        self.streams, self.threshold = streams, threshold
        term = np.concatenate([impacts[i][0] for i in streams]).astype(np.int64)
        item = np.repeat(np.arange(len(streams)), [len(impacts[i][0]) for i in streams])
        impact = np.concatenate([impacts[i][1] for i in streams])
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        blocks = -(-len(streams) // BLOCK)
        key = term * blocks + self.item // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.pair, self.pair_start = key[first], np.append(first, len(key))
        self.pair_max = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, dtype=np.float32)
        self.blocks, self.block = blocks, (self.pair % blocks).astype(np.int64)
        self.word_start = np.searchsorted(self.pair, np.arange(words + 2) * blocks)  # of each word's pairs
        self.word_max = np.zeros(words + 1, dtype=np.float32)
        np.maximum.at(self.word_max, self.pair // blocks, self.pair_max)
        self.block_threshold = np.minimum.reduceat(threshold, np.arange(0, len(streams), BLOCK))
        self.direct = None
        if (words + 1) * blocks <= DIRECT:
            self.direct = np.full((words + 1) * blocks, -1, dtype=np.int32)
            self.direct[self.pair] = np.arange(len(self.pair))

    def _pairs(self, word: np.ndarray, passage: np.ndarray, block: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, pair) of the words lower..upper of each (passage, block) that the block has."""
        which, at = _spread(lower, upper)
        key = word[at] * self.blocks + block[which]
        if self.direct is not None:
            pair = self.direct[key]
            has = pair >= 0
            return which[has], pair[has]
        pair = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        has = self.pair[pair] == key
        return which[has], pair[has]

    def search(self, owner: np.ndarray, word: np.ndarray, passages: int) -> np.ndarray:
        """(passage, stream) of what scores at least the stream's threshold. ``owner`` and ``word``: the
        distinct words of each passage, sorted by passage."""
        most = self.word_max[word]
        order = np.lexsort((most, owner))
        word, most = word[order], most[order]
        upto = np.cumsum(most, dtype=np.float64)
        start = np.searchsorted(owner, np.arange(passages))
        upto -= np.concatenate([[0.0], upto])[start][owner]
        # a block's pivot is the first word that can lift the sum to its threshold; blocks stand in order
        # of their thresholds, so each word is followed through the first of its blocks only
        able = np.searchsorted(self.block_threshold, upto + 1e-4, side="right")
        follow = np.flatnonzero(able)
        if not len(follow):
            return np.zeros((0, 2), dtype=np.int64)
        upper = np.searchsorted(self.pair, word[follow].astype(np.int64) * self.blocks + able[follow])
        which, at = _spread(self.word_start[word[follow]], upper)
        each = owner[follow][which] * self.blocks + self.block[at]
        found = _distinct(each)
        passage, block = found // self.blocks, found % self.blocks
        # the bound of a (passage, block): block maxima of the passage's words from the weightiest down, and
        # what all lighter words can add at most; what falls below the block's threshold is dropped on the way
        end = np.append(start[1:], len(owner))
        upper, got = end[passage], np.zeros(len(found))
        while len(passage) and (upper > start[passage]).any():
            lower = np.maximum(start[passage], upper - STEP)
            which, pair = self._pairs(word, passage, block, lower, upper)
            got += np.bincount(which, self.pair_max[pair], minlength=len(passage))
            rest = np.where(lower > start[passage], upto[lower - 1], 0.0)
            alive = got + rest >= self.block_threshold[block] - 1e-3
            passage, block, got, upper = passage[alive], block[alive], got[alive], lower[alive]
        which, pair = self._pairs(word, passage, block, start[passage], end[passage])
        several, at = _spread(self.pair_start[pair], self.pair_start[pair + 1])
        each = passage[which[several]] * len(self.streams) + self.item[at]
        if passages * len(self.streams) <= DIRECT:
            score = np.bincount(each, self.impact[at], minlength=1)
            cells = np.flatnonzero(score)
            score = score[cells]
        else:
            cells = _distinct(each)
            score = np.bincount(np.searchsorted(cells, each), self.impact[at], minlength=len(cells))
        passage, item = cells // len(self.streams), cells % len(self.streams)
        hit = score >= self.threshold[item] - 1e-4
        return np.stack([passage[hit], self.streams[item[hit]]], axis=1)


class Index:
    """BM25 impacts of every (word, item stream) as posting lists in tiers, with thresholds."""

    def __init__(self, items: Items, documents: int, df: np.ndarray):
        self.item_words, self.ids, self.answers = items.words, items.ids, items.answers or [np.zeros(0, dtype=np.int32)] * len(items.ids)
        codes = [grams(w) for w in items.words]
        of = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        flat = np.concatenate([*codes, np.zeros(0, dtype=np.int64)])
        order = np.argsort(flat, kind="stable")
        self.gram_codes, self.gram_items = flat[order], of[order].astype(np.int32)
        self.words = len(items.vocabulary)
        idf = np.log(1 + (documents - np.minimum(df, documents) + 0.5) / (df + 0.5)) + 0.01
        lengths = np.array([len(w) for w in items.words] or [1], dtype=float)
        mean = max(lengths.mean(), 1.0)
        impacts = []
        for w in items.words:
            terms, tf = np.unique(w, return_counts=True)
            impacts.append((terms, idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))))
        least = np.array([self._threshold(w, dict(zip(*imp))) for w, imp in zip(items.words, impacts)])
        able = np.flatnonzero(np.isfinite(least))
        able = able[np.argsort(least[able], kind="stable")]
        self.tiers = [Tier(some, impacts, least[some], self.words) for some in (able[a : a + TIER] for a in range(0, len(able), TIER))]

    @staticmethod
    def _threshold(words: np.ndarray, impact: dict) -> float:
        """Least score of a passage that holds a stretch to be found: of 12 words in a row, or of the
        part of a loose run that a passage surely holds, without its weightiest words."""
        if len(words) < EXACT_RUN:
            return np.inf

        def score(a, b, lost):
            each = sorted(impact[w] for w in set(words[a:b].tolist()))
            return sum(each[: len(each) - lost] if lost else each)

        least = min(score(a, a + EXACT_RUN, 0) for a in range(len(words) - EXACT_RUN + 1))
        part = STRIDE - 4  # item words in any passage over a loose run, at worst
        if len(words) >= LOOSE_RUN:
            least = min(least, *(score(a, a + part, 4) for a in range(len(words) - part + 1)))
        return 0.99 * least

    def search(self, streams: Sequence[np.ndarray]) -> list[tuple[int, int]]:
        """(document position, item stream) of all pairs with a passage above the threshold."""
        rows, owner = [], []
        for d, s in enumerate(streams):
            kept = s[s > 0]
            starts = range(0, max(1, len(kept) - PASSAGE + STRIDE), STRIDE)
            for a in starts if len(kept) else ():
                rows.append(kept[a : a + PASSAGE])
                owner.append(d)
        found: set[tuple[int, int]] = set()
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            cells = np.repeat(np.arange(len(part), dtype=np.int64), [len(r) for r in part]) * (self.words + 1) + np.concatenate(part)
            cells = _distinct(cells)  # a repeated word counts once
            passage, word = cells // (self.words + 1), cells % (self.words + 1)
            own = np.array(owner[at : at + 4096])
            for tier in self.tiers:
                hits = tier.search(passage, word, len(part))
                found.update(zip(own[hits[:, 0]].tolist(), hits[:, 1].tolist()))
        return sorted(found)

    def carried(self, doc: np.ndarray, streams: Sequence[int]) -> list[int]:
        """Those of the item streams that pass the exact check. Items without SURE_RUN words in a row in
        common with the document cannot (a loose run of c words with c / 8 + 1/2 edits has a piece of
        at least that length), so the alignment is not tried for them."""
        own = grams(doc)
        if not len(own) or not len(self.gram_codes):
            return []
        _, at = _spread(np.searchsorted(self.gram_codes, own), np.searchsorted(self.gram_codes, own, side="right"))
        shared = set(self.gram_items[at].tolist())
        return [i for i in streams if i in shared and carries(doc, self.item_words[i])]

    def report(self, doc: np.ndarray, stream: int) -> tuple[int, float, bool | None]:
        """(longest run of equal words, share of the item's words with a SURE_RUN in common, whether the
        answer's words stand in the document in a row; None without an answer) of a carried stream."""
        item, answer = self.item_words[stream], self.answers[stream]
        covered = np.zeros(len(item), dtype=bool)
        own = set(grams(doc).tolist())
        for a in range(len(item) - SURE_RUN + 1):
            if grams(item[a : a + SURE_RUN])[0] in own:
                covered[a : a + SURE_RUN] = True
        said = None if not len(answer) else longest_run(doc, answer) >= len(answer)
        return longest_run(doc, item), float(covered.mean()), said


def longest_run(doc: np.ndarray, item: np.ndarray) -> int:
    """Longest stretch of equal consecutive words."""
    best = 0
    previous = np.zeros(len(doc) + 1, dtype=np.int32)
    for w in item:
        run = np.zeros(len(doc) + 1, dtype=np.int32)
        run[1:] = np.where(doc == w, previous[:-1] + 1, 0)
        best = max(best, int(run.max()))
        previous = run
    return best


def _seeds(doc: np.ndarray, item: np.ndarray, least: int = 3) -> list[tuple[int, int]]:
    """(doc position, item position) of the ends of equal stretches of ``least`` words."""
    out = []
    previous = np.zeros(len(doc) + 1, dtype=np.int32)
    for q, w in enumerate(item):
        run = np.zeros(len(doc) + 1, dtype=np.int32)
        run[1:] = np.where(doc == w, previous[:-1] + 1, 0)
        out += [(int(p) - 1, q) for p in np.flatnonzero(run >= least)]
        previous = run
    return out


def alignment(doc: Sequence[int], item: Sequence[int]) -> str:
    """Best local alignment (+1 equal, -1 edit) as letters: M equal, S changed, D left out, I added."""
    n, m = len(doc), len(item)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    step = [[""] * (m + 1) for _ in range(n + 1)]
    best, at = 0, (0, 0)
    for i in range(1, n + 1):
        d, above, row, how = doc[i - 1], score[i - 1], score[i], step[i]
        for j in range(1, m + 1):
            equal = d == item[j - 1] and d > 0
            s, h = above[j - 1] + (1 if equal else -1), "M" if equal else "S"
            if row[j - 1] - 1 > s:
                s, h = row[j - 1] - 1, "D"
            if above[j] - 1 > s:
                s, h = above[j] - 1, "I"
            if s > 0:
                row[j], how[j] = s, h
                if s > best:
                    best, at = s, (i, j)
    out, (i, j) = [], at
    while step[i][j]:
        h = step[i][j]
        out.append(h)
        i -= h != "D"
        j -= h != "I"
    return "".join(reversed(out))


def has_loose_run(ops: str, run: int = LOOSE_RUN, rate: float = EDITS_PER_WORD) -> bool:
    """Whether a stretch covers ``run`` item words with at most about ``rate`` edits a word: half an
    edit more than the rate is still 'about'."""
    covered = np.cumsum([0] + [o != "I" for o in ops])
    edits = np.cumsum([0] + [o != "M" for o in ops])
    for a in range(len(ops)):
        c, e = covered[a + 1 :] - covered[a], edits[a + 1 :] - edits[a]
        if np.any((c >= run) & (e <= c * rate + 0.5)):
            return True
    return False


def grams(words: np.ndarray) -> np.ndarray:
    """Codes of all SURE_RUN consecutive words of the index, without repeats, sorted."""
    n = len(words) - SURE_RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(SURE_RUN):
        part = words[k : k + n]
        code = code * 1_000_003 + part
        known &= part > 0
    return _distinct(code[known])


def carries(doc: np.ndarray, item: np.ndarray) -> bool:
    """The exact check: 12 words in a row, or a loose run of 25."""
    if longest_run(doc, item) >= EXACT_RUN:
        return True
    if len(item) < LOOSE_RUN:
        return False
    seeds = sorted(_seeds(doc, item), key=lambda s: s[0] - s[1])
    at = 0
    while at < len(seeds):  # seeds of nearly the same offset belong to one stretch
        end = at + 1
        while end < len(seeds) and (seeds[end][0] - seeds[end][1]) - (seeds[end - 1][0] - seeds[end - 1][1]) <= 4:
            end += 1
        places = [p for p, _ in seeds[at:end]]
        lowest, highest = min(p - q for p, q in seeds[at:end]), max(p - q for p, q in seeds[at:end])
        if end - at >= 3:
            a, b = max(0, lowest - 6), min(len(doc), highest + len(item) + 6)
            if b - a <= 4 * len(item) and has_loose_run(alignment(doc[a:b].tolist(), item.tolist())):
                return True
            if b - a > 4 * len(item):  # several copies: each seed by itself
                for p in places:
                    lo, hi = max(0, p - len(item) - 6), min(len(doc), p + len(item) + 6)
                    if has_loose_run(alignment(doc[lo:hi].tolist(), item.tolist())):
                        return True
        at = end
    return False


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, answer: str | None = None, group_words: int | None = None) -> DataFrame:
    """(doc_id, item_id, longest_run, question_share, answer_found): every document that carries a test
    item, wholly or in part, once per item.

    Carried: 12 consecutive item words, or 25 with at most about one edit in eight words, in the
    running text, a note, a comment or a macro body. longest_run: item words in a row; question_share:
    share of the item's words in stretches of five equal words; answer_found: whether the words of the
    answer stand in the document too, NULL without an answer. NULL or empty texts carry nothing; items
    of fewer than 12 words cannot be carried; repeated documents each come out; copies of an item (same
    text, other id) each come out. Without documents or items the result is empty.
    """
    doc_type = docs.schema[doc_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    schema = f"doc {doc_type}, item {item_type}, longest_run int, question_share double, answer_found boolean"
    spark = docs.sparkSession
    out = None
    for read in read_items(items, item_id, item_text, answer, group_words):
        ids = materialise(word_ids(docs, doc_id, text, read), "words")
        index = Index(read, *document_frequencies(ids, len(read.vocabulary)))
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = pickle.loads(sent.value)
            for b in batches:
                streams = list(b["ids"])
                rows = []
                for d, some in groupby(index.search(streams), key=lambda p: p[0]):
                    best: dict = {}
                    for i in index.carried(streams[d], [i for _, i in some]):
                        told = index.report(streams[d], i)
                        if index.ids[i] not in best or told[0] > best[index.ids[i]][0]:
                            best[index.ids[i]] = told
                    rows += [(b["doc"].iloc[d], i, *told) for i, told in best.items()]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc", "item", "longest_run", "question_share", "answer_found"])

        one = ids.filter("df IS NULL").select("doc", "ids").mapInPandas(run, schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "longest_run", "question_share", "answer_found")
