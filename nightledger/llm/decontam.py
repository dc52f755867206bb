"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Items, ordered by length, are indexed in blocks; every term has a posting list of
its blocks with the largest weight in each, and a block has the postings of its
items. A weight is a term's BM25 contribution divided by the item's score for
itself, so one threshold holds for all items. Every passage (``passage`` words,
half overlapping) of every document is a query. Its lists are put in order, the
longest first; the pivot is the first list at which their largest weights add up
to a third of the threshold. No item that has only terms before the pivot can reach
it, so only the lists from the pivot on, the shorter ones, are walked. A block met
there is skipped if its maxima in them, with all that the lists before the pivot
could add, do not reach the threshold; else if its maxima in all lists do not; and
what is left is scored in full. All passages of a chunk go through these steps together, on arrays of
(passage, term) and (passage, block) pairs; chunks are bounded in words, so long
documents are searched a part at a time. Retrieved items are verified:
the shares of the item's question (all but its last sentence) and of its answer
(the last sentence; halves, if there is one sentence) found in the document as
word 5-grams must both reach ``overlap``. An item of more words than half a
passage is indexed in pieces of at most so many, each of which lies whole in some
passage of a document that holds the item; one retrieved piece has the whole item
verified.

The index goes to the workers in shards of at most ``shard_items`` items and
``shard_bytes`` of text, one pass over the documents for each, so what is
broadcast is bounded; test sets are one shard. Number, mean length and document
frequencies are those of all items in every shard.

Defined results: null or blank texts and items match nothing; an item_id that
repeats is several items; repeated documents match each; an empty table on either
side gives no rows (``clean_documents``: all documents); other columns are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, raw_texts, saved, without

_PLAIN = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256)).lower()
GRAM = 5
K1, B = 1.2, 0.75
#: What share of the threshold the lists before the pivot may reach: it saves the longest lists and leaves few blocks to look at.
PIVOT = 1 / 3
#: How many cells (half passages) are searched at once.
CELLS = 4096


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and controls separate."""
    return text.translate(_PLAIN).split()


def grams(words: list[bytes]) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(GRAM)), strict=False)) if len(words) > GRAM else {tuple(words)} - {()}


def question_and_answer(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words of all sentences but the last, and of the last; halves if there is but one."""
    sentences = [w for s in re.split(rb"(?<=[.!?])\s+", text.strip()) if (w := plain_words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]


def pieces(text: bytes, longest: int) -> list[list[bytes]]:
    """The words of an item in the fewest runs of at most ``longest``, of about equal length."""
    words = plain_words(text)
    n = -(-len(words) // longest)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


def _groups(ids: list[int], texts: list[bytes], most: int = 200_000):
    """Lists of (doc_id, words) of about ``most`` words, or of one longer document."""
    out, n = [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        out.append((doc_id, plain_words(text)))
        n += len(out[-1][1])
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


class Statistics(NamedTuple):
    """Number and mean length of all pieces, and how many have each term."""

    n: int
    mean: float
    frequency: dict[bytes, int]


class Index:
    """The inverted index of some items, their pieces in blocks of ``width``."""

    def __init__(self, items: list[tuple[int, bytes]], width: int = 4, longest: int = 64, statistics: Statistics | None = None):
        words = [(k, w) for k, (_, t) in enumerate(items) for w in pieces(t, longest)]
        words = sorted(words, key=lambda w: len(w[1]))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.parts = [question_and_answer(t) for _, t in items]
        self.item_of = [k for k, _ in words]  # of a piece
        if statistics is None:
            statistics = Statistics(len(words), np.mean([len(w) for _, w in words]) if words else 1, Counter(t for _, w in words for t in set(w)))
        total, mean, frequency = statistics
        n = len(words)
        self.terms = {t: i for i, t in enumerate(sorted({t for _, w in words for t in w}))}
        idf = {t: np.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in self.terms}
        postings = []  # (terms, block, largest weights)
        self.blocks = []  # (sorted term numbers, weights terms x items, first item)
        for first in range(0, n, width):
            own = sorted({self.terms[t] for _, w in words[first : first + width] for t in w})
            weights = np.zeros((len(own), min(width, n - first)))
            at = {t: i for i, t in enumerate(own)}
            for j, (_, w) in enumerate(words[first : first + width]):
                for t, f in Counter(w).items():
                    weights[at[self.terms[t]], j] = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean))
            weights /= weights.sum(axis=0)
            own = np.array(own, np.int64)
            postings.append((own, np.full(len(own), len(self.blocks)), weights.max(axis=1)))
            self.blocks.append((own, weights, first))
        # posting lists, one term after another: blocks in ascending order, their largest weights, and where each list begins
        terms, blocks, largest = (np.concatenate([np.zeros(0, k), *(p[i] for p in postings)]) for i, k in enumerate((np.int64, np.int64, np.float64)))
        order = np.argsort(terms * max(1, len(self.blocks)) + blocks)
        self.posted, self.largest = blocks[order], largest[order]
        self.begins = np.searchsorted(terms[order], np.arange(len(self.terms) + 1))
        self.rank = np.empty(len(self.terms), np.int64)  # the longest list first
        self.rank[np.argsort(-np.diff(self.begins), kind="stable")] = np.arange(len(self.terms))
        self.top = np.zeros(len(self.terms))
        np.maximum.at(self.top, terms, largest)

    def search(self, terms: np.ndarray, cells: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(cell, item, score) of every passage, made of a cell and the one after it, that reaches the threshold for a piece.

        ``terms`` with ``cells`` are the distinct (cell, term) pairs, sorted by cell and term.
        """
        found = []
        if not len(terms):
            return found
        least, n_blocks = threshold - 1e-6, len(self.blocks)  # sums may be off by rounding; the score itself decides
        # (passage, term): a term counts once in a passage, though both of its cells have it
        key = cells * len(self.terms) + terms
        at = np.searchsorted(key, key - len(self.terms))
        again = key[np.minimum(at, len(key) - 1)] == key - len(self.terms)
        # a passage whose first cell has no term is part of the next one
        later = ~again & np.isin(cells - 1, cells)
        passage, term = np.concatenate([cells, cells[later] - 1]), np.concatenate([terms, terms[later]])
        # lists by passage, the longest first, with the sum of the largest weights before each
        order = np.lexsort((self.rank[term], passage))
        passage, term = passage[order], term[order]
        top = self.top[term]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(passage) != 0]))
        sizes = np.diff(np.append(starts, len(passage)))
        before = np.cumsum(top) - top
        before -= np.repeat(before[starts], sizes)
        walked = np.flatnonzero(before + top >= PIVOT * least)  # from the pivot on
        if not len(walked):
            return found
        new = np.concatenate([[True], np.diff(passage[walked]) != 0])
        rest = np.repeat(before[walked][new], np.diff(np.append(np.flatnonzero(new), len(walked))))  # what lists before the pivot may add
        # their postings, as (passage, block)
        n = self.begins[term[walked] + 1] - self.begins[term[walked]]
        where = np.repeat(self.begins[term[walked]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = np.repeat(passage[walked], n) * n_blocks + self.posted[where]
        order = np.argsort(met, kind="stable")
        met, weight, rest = met[order], self.largest[where][order], np.repeat(rest, n)[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(met) != 0]))
        keep = first[np.add.reduceat(weight, first) + rest[first] >= least]
        ends = np.append(starts, len(passage))
        for pair in met[keep].tolist():
            cell, block = divmod(pair, n_blocks)
            i = int(np.searchsorted(passage[starts], cell))
            own, weights, item = self.blocks[block]
            query = term[ends[i] : ends[i + 1]]
            at = np.minimum(np.searchsorted(own, query), len(own) - 1)
            here = weights[at[own[at] == query]]
            if here.max(axis=1, initial=0).sum() < least:
                continue
            scores = here.sum(axis=0)
            found += [(cell, self.item_of[item + j], float(scores[j])) for j in np.flatnonzero(scores >= threshold).tolist()]
        return found


def _statistics(items: DataFrame, longest: int) -> tuple[int, float, DataFrame]:
    """Number and mean length of the pieces of all items, and (term, frequency)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [w for t in raw_texts(batch) for w in pieces(t, longest)]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, found), pa.int64()), pa.array([list(set(w)) for w in found], pa.list_(pa.binary()))], names=["length", "terms"])

    cut = saved(items.select("text").mapInArrow(run, "length long, terms array<binary>"))
    n, words = cut.agg(F.count("*"), F.sum("length")).first()
    return n, words / n if n else 1, saved(cut.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("frequency")))


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, passage: int = 128, shard_items: int = 1000, shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified pair; the score is the best passage's.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    half = passage // 2

    def searcher(index):
        @giving_back
        def run(batches):
            import pyarrow as pa

            own, get = index.value, index.value.terms.get
            size = max(1, len(own.terms))
            for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
                rows = []
                for group in _groups(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                    first = np.cumsum([0, *(len(w) // half + 2 for _, w in group)])  # an empty cell between documents
                    numbers = [np.fromiter((get(w, -1) for w in words), np.int64, len(words)) for _, words in group]
                    cell = np.concatenate([f + np.arange(len(x)) // half for f, x in zip(first, numbers, strict=False)])
                    term = np.concatenate(numbers)
                    key = np.unique((cell * size + term)[term >= 0])
                    best: dict[tuple[int, int], float] = {}
                    for lo in range(0, int(first[-1]), CELLS):  # with the next cell, the other half of the last passage
                        part = key[np.searchsorted(key, lo * size) : np.searchsorted(key, (lo + CELLS + 1) * size)]
                        for at, item, score in own.search(part % size, part // size, threshold):
                            if at < lo + CELLS:
                                d = int(np.searchsorted(first, at, side="right")) - 1
                                best[d, item] = max(score, best.get((d, item), 0.0))
                    wanted: dict[int, list[int]] = {}
                    for d, item in best:
                        wanted.setdefault(d, []).append(item)
                    for d, found in wanted.items():
                        doc_id, words = group[d]
                        asked = [[grams(part) for part in own.parts[item]] for item in found]
                        every = set().union(*(g for x in asked for g in x))
                        held = {g for g in zip(*(words[i:] for i in range(GRAM)), strict=False) if g in every}
                        parts = [own.parts[item] for item in found]
                        line = b" " + b" ".join(words) + b" " if any(len(p) <= GRAM for x in parts for p in x) else b""
                        for item, sets in zip(found, asked, strict=True):
                            # what is no longer than a 5-gram is sought as a run of words
                            shares = [float(b" " + b" ".join(p) + b" " in line) if len(p) <= GRAM else len(g & held) / len(g) for p, g in zip(own.parts[item], sets, strict=True)]
                            if min(shares) >= overlap:
                                rows.append((doc_id, int(own.ids[item]), best[d, item], *shares))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.float64()) for i in range(5)], names=[x.split()[0] for x in schema.split(", ")])

        return run

    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n, size = sized.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // shard_items), -(-size // shard_bytes))
    out, whole = None, _statistics(sized, half) if shards > 1 else None
    for s in range(shards):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s) if shards > 1 else sized
        rows, known = [(r["item_id"], r["text"].encode()) for r in part.orderBy("item_id", "text").collect()], None
        if whole:
            own = spark.createDataFrame([(t,) for t in {t for _, text in rows for t in plain_words(text)}], "term binary")
            known = Statistics(*whole[:2], {bytes(r["term"]): r["frequency"] for r in whole[2].join(own, "term").collect()})
        index = spark.sparkContext.broadcast(Index(rows, longest=half, statistics=known))
        found = docs.mapInArrow(searcher(index), schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a verified match. Rows without a doc_id stay; rows of one doc_id go together."""
    return without(docs, matches(docs, items, **options).select("doc_id"))
