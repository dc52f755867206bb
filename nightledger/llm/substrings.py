"""Substring deduplication by difference-cover anchors.

A difference cover D modulo a period v has, for any two positions i and j, a
shift s < v with both (i + s) mod v and (j + s) mod v in D. So two equal runs of
``window`` words contain, at one common offset, a cover position in both texts;
hashing only the ``window - v + 1`` words that follow a cover position keeps
|D| / v of all positions and still meets every match. Anchors found in two or
more documents mark the windows around them; only these are extended to the full
length, hashed in 96 bits and compared. Every step is a minimum over hashes and a
join, so a passage that thousands of documents share costs one row per occurrence
and no pairs. Repeats within one batch of documents are settled there: only the
occurrence in the smallest document of the batch goes to the other batches under
its hash, all others travel under keys of their own, so that a passage that a third
of all documents share does not meet in one task.

Defined results: null or blank text has no words; texts shorter than a window
lose nothing; rows that share a doc_id are judged alike against smaller ids; a
null doc_id sorts before all others; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, join_labels, mixed, raw_texts, word_hashes

#: Perfect difference sets by period (Singer), each a difference cover.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
LEAST = -(1 << 63)
#: Odd bases of the two window hashes and their inverses modulo 2^64.
BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    """Whether every residue is a difference of two members."""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base & (2**64 - 1)), U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


@dataclass
class Windows:
    """Hashes of word windows in one text: prefix sums of h[i] * B^i, times B^-start."""

    hashes: np.ndarray

    def at(self, starts: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        base, inverse = BASES[which]
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(self.hashes * powers(base, len(self.hashes)), dtype=U64)])
        return mixed((sums[starts + width] - sums[starts]) * powers(inverse, len(self.hashes) + 1)[starts])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and tie, 31 bits of the text's hash, which tell rows of one doc_id apart."""
    text = F.col("text").cast("string")
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 33).cast("int")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), text.alias("text"), tie.alias("tie"))


def _runs(keys: np.ndarray, other: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least and the greatest doc_id among the rows of its key (keys and other)."""
    order = np.argsort(keys, kind="stable")
    k, o, d = keys[order], other[order], doc_ids[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    sizes = np.diff(np.append(new, len(k)))
    lo, hi = np.empty_like(doc_ids), np.empty_like(doc_ids)
    lo[order], hi[order] = np.repeat(np.minimum.reduceat(d, new), sizes), np.repeat(np.maximum.reduceat(d, new), sizes)
    return lo, hi


def _own_key(doc_ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mixed(mixed(doc_ids.view(U64)) + at.astype(U64)).view(np.int64)


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(anchor, doc_id, at, known) for every cover position that a whole window reaches.

    ``known`` is 0, or 1 where the batch has the anchor in two documents: then
    one that does not stand in the smallest of them is 2 and has a key of its own.
    """
    cover, width = np.array(COVERS[period]), window - period + 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, ids, at = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                starts = (np.arange(0, len(words), period)[:, None] + cover).reshape(-1)
                starts = starts[starts + width <= len(words)]
                found.append(Windows(word_hashes(words)).at(starts, width).view(np.int64))
                ids.append(np.full(len(starts), doc_id))
                at.append(starts.astype(np.int32))
            if found:
                anchor, doc, pos = (np.concatenate(x) for x in (found, ids, at))
                lo, hi = _runs(anchor, anchor, doc)
                known = (lo < hi).astype(np.int8) + (doc > lo)
                anchor = np.where(known == 2, _own_key(doc, pos), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, doc, pos, known)], names=["anchor", "doc_id", "at", "known"])

    return docs.mapInArrow(run, "anchor long not null, doc_id long not null, at int not null, known tinyint not null")


def _spread(marked: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Positions below n from ``before`` in front of a marked one to ``after`` behind it (excluded)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(marked - before, 0, n), 1)
    np.add.at(step, np.clip(marked + after, 0, n), -1)
    return np.cumsum(step[:-1]) > 0


def repeated_words(docs: DataFrame, window: int = 50, period: int = 31) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept_text for every row.

    A word goes if some window of ``window`` consecutive words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input.
    Texts, anchors and windows are exchanged once each: one plan, in which both uses
    of each share an exchange.
    """
    if period not in COVERS or period > window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window")
    docs = _texts(docs)
    # a whole text that an earlier document has too loses every word and adds no window that is not there already
    prints = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print"))
    first = prints.groupBy("print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("print", "lo", "n")
    copies = join_labels(prints, first, "print", docs.count()).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
    is_copy = F.coalesce(F.array_contains("prints", F.md5(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(False))
    docs = docs.join(copies, "doc_id", "left").select("doc_id", "text", "tie", is_copy.alias("is_copy"))
    new = docs.where("not is_copy").select("doc_id", "text", "tie")
    # the aggregates also look at the position (never negative): an exchange is shared only if both uses need the same columns
    anchors = _anchors(new, window, period).repartition("anchor")  # once, for the aggregate and for the join
    open_id = F.when(F.col("known") < 2, F.col("doc_id"))
    shared = anchors.groupBy("anchor").agg(F.min(open_id).alias("lo"), F.max(open_id).alias("hi"), F.max("at").alias("last")).where("lo < hi and last >= 0").select("anchor", F.lit(True).alias("hit"))
    marks = anchors.join(shared, "anchor", "left").where("known > 0 or hit").groupBy("doc_id").agg(F.collect_set("at").alias("at"))

    def extend(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [[] for _ in range(5)]
            for doc_id, tie, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tie")), raw_texts(batch), batch.column("at").to_pylist(), strict=True):
                words = text.split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                # windows that hold the anchor's words at a cover position less than a period behind their start
                starts = np.flatnonzero(_spread(np.array(at), period - 1, 1, n))
                hashes = Windows(word_hashes(words))
                for c, v in zip(cols, (hashes.at(starts, window, 0).view(np.int64), (hashes.at(starts, window, 1) >> U64(32)).astype(np.uint32).view(np.int32), np.full(len(starts), doc_id), starts.astype(np.int32), np.full(len(starts), tie, np.int64)), strict=True):
                    c.append(v)
            if cols[0]:
                x, y, doc, start, tie = (np.concatenate(c) for c in cols)
                settled = doc > _runs(x, y, doc)[0]  # a smaller document of this batch has the window
                x = np.where(settled, _own_key(doc, start), x)
                mark = (tie << 1 | settled).astype(np.uint32).view(np.int32)  # the row's tie, and 1 if settled
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x, y, doc, start, mark)], names=["x", "y", "doc_id", "start", "mark"])

    whole = new.join(marks, "doc_id")
    windows = whole.mapInArrow(extend, "x long not null, y int not null, doc_id long not null, start int not null, mark int not null").repartition("x", "y")
    settled = F.col("mark").bitwiseAND(F.lit(1)) == 1
    open_id = F.when(~settled, F.col("doc_id"))
    first = windows.groupBy("x", "y").agg(F.min(open_id).alias("lo"), F.max(open_id).alias("hi"), F.max("start").alias("last")).where("lo < hi and last >= 0").select("x", "y", "lo")
    gone = windows.join(first, ["x", "y"], "left").where(settled | (F.col("doc_id") > F.col("lo")))
    place = F.shiftleft(F.shiftrightunsigned("mark", 1).cast("long"), 32) + F.col("start")  # of a row, for rows that share a doc_id
    gone = gone.groupBy("doc_id").agg(F.collect_set(place).alias("starts"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            total, removed, kept = [], [], []
            for text, tie, starts, is_copy in zip(raw_texts(batch), *(batch.column(c).to_pylist() for c in ("tie", "starts", "is_copy")), strict=True):
                words = text.split()
                starts = [x & 0xFFFFFFFF for x in starts or () if x >> 32 == tie]
                if is_copy:
                    starts = range(max(0, len(words) - window + 1))
                drop = _spread(np.array(starts), 0, window, len(words)) if starts else np.zeros(len(words), bool)
                total.append(len(words))
                removed.append(int(drop.sum()))
                kept.append(b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d] if starts else words))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), text], names=["doc_id", "n_words", "n_removed", "kept_text"])

    out = docs.join(gone, "doc_id", "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LEAST, F.col("doc_id")))
