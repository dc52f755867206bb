"""Order MinHash document fingerprints and their likeness after an edit.

A text's words are hashed as k-mers, each numbered by its occurrence in the text,
so that a repeated k-mer counts as often as it stands there. Each of ``tuples``
hash functions picks the ``depth`` smallest of them and keeps those in text
order; the hash of that tuple is one entry of the signature. Two signatures agree
in an entry only where the same k-mers come in the same order, which follows the
edit distance rather than the set of words.

Defined results: null is empty text; a text of fewer words than k is one k-mer;
equal texts have equal fingerprints; an empty text has a fingerprint of its own;
a null doc_id sorts first; rows that share a doc_id follow one another by their
text's hash; one row alone is its own next document; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_PARTS, U64, longs, mixed, part_of, raw_texts, word_hashes

LEAST = -(1 << 63)


def occurrence_numbers(keys: np.ndarray) -> np.ndarray:
    """For each element, how many equal ones stand before it."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], np.diff(keys[order]) != 0])
    runs = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(runs, np.diff(np.append(runs, len(keys))))
    return out


def order_minhash(words: list[bytes], k: int, depth: int, multipliers: np.ndarray) -> np.ndarray:
    """One 32-bit entry per multiplier."""
    kmers = word_hashes(words) if words else np.zeros(1, U64)
    n = max(1, len(kmers) - k + 1)
    joined = kmers[:n].copy()
    for i in range(1, min(k, len(kmers))):
        joined = mixed(joined * U64(3) + kmers[i : i + n])
    numbered = mixed(joined ^ (occurrence_numbers(joined).astype(U64) * U64(0x9E3779B97F4A7C15)))
    depth = min(depth, n)
    least = np.full((len(multipliers), depth), 2**64 - 1, U64)
    where = np.zeros((len(multipliers), depth), np.int64)
    rows = np.arange(len(multipliers))
    for at in range(0, n, 4096):  # bounded whatever the text's length
        ranks = numbered[None, at : at + 4096] * multipliers[:, None]
        both, places = [least], [where]
        for _ in range(min(depth, ranks.shape[1])):
            i = ranks.argmin(axis=1)
            both.append(ranks[rows, i][:, None])
            places.append(i[:, None] + at)
            ranks[rows, i] = U64(2**64 - 1)
        both, places = np.concatenate(both, axis=1), np.concatenate(places, axis=1)
        keep = np.argsort(both, axis=1, kind="stable")[:, :depth]
        least, where = np.take_along_axis(both, keep, 1), np.take_along_axis(places, keep, 1)
    picked = numbered[np.sort(where, axis=1)]
    out = np.full(len(multipliers), depth, U64)
    for i in range(depth):
        out = mixed(out * U64(5) + picked[:, i] * multipliers)
    return (out >> U64(32)).astype(">u4")


def _ranges(docs: DataFrame, parts: int | None = None, range_bytes: int = 16 << 20) -> DataFrame:
    """part, tail, doc_id and text in ascending order within ranges of ids, each range followed by the row after it.

    The texts are exchanged once. Ranges of about ``range_bytes`` are cut at
    quantiles of the ids; each range's least key is found by an aggregate of one row a
    range, so that the one row whose predecessor lies in an earlier range is
    sent to both (as a tail). A row finds its range by binary search in a constant
    array.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LEAST))).withColumn("tie", F.xxhash64("text"))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, min(MOST_PARTS, -(-size // range_bytes)))
    found = Counter(map(int, docs.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else {}
    # an id at several quantiles has several ranges of text hashes
    cuts = sorted((key, LEAST + (j << 64) // n) for key, n in found.items() for j in range(n))
    docs = docs.withColumn("part", part_of(F.col("key"), F.col("tie"), cuts))
    heads = {r["part"]: r["head"] for r in docs.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("head")).collect()}
    # by range: its least key, and the range with rows before it (-1: none)
    least, before, last = [], [], max(heads, default=-1)
    for p in range(len(cuts) + 1):
        least.append(heads.get(p, (0, 0)))
        before.append(last)
        last = p if p in heads else last
    part = F.col("part")
    is_head = (F.get(longs(x[0] for x in least), part) == F.col("key")) & (F.get(longs(x[1] for x in least), part) == F.col("tie"))
    copies = F.array(F.struct("part", F.lit(False).alias("tail")), F.struct(F.get(longs(before), part).cast("int").alias("part"), F.lit(True).alias("tail")))
    spread = docs.select("doc_id", "text", "key", "tie", F.explode(F.when(is_head, copies).otherwise(F.slice(copies, 1, 1))).alias("to"))
    # a tail row only lends its text to the last row of the range before
    spread = spread.select("doc_id", "text", "key", "tie", F.col("to.part").alias("part"), F.col("to.tail").alias("tail"))
    return spread.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", "key", "tie").select("part", "tail", "doc_id", "text")


def _pairs(batches, most: int = 256):
    """Lists of (doc_id, text, next text), a few rows at a time; a tail row only lends its text."""
    held, rows = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            part = batch.slice(lo, most)
            for now in zip(*(part.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
                if held is not None and held[0] == now[0] and not held[1]:
                    rows.append((held[2], held[3], now[3]))
                held = now
            if rows:
                yield rows
                rows = []


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and next_text, the text of the next row in ascending doc_id (after the last, the first)."""

    def run(batches):
        import pyarrow as pa

        for rows in _pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "next_text"])

    return _ranges(docs, parts).mapInArrow(run, "doc_id long, text string, next_text string")


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame, k: int = 2, depth: int = 2, tuples: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, text, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Fingerprints are hexadecimal, eight digits an entry. near_edited and
    near_next are the shares of equal entries with the edited text's and with the
    next text's fingerprint.
    """
    multipliers = np.random.default_rng(seed).integers(0, 2**63, tuples, dtype=np.uint64) * U64(2) + U64(1)

    def sign(text: str) -> np.ndarray:
        return order_minhash(text.encode().split(), k, depth, multipliers)

    def run(batches):
        import pyarrow as pa

        last, last_sign = None, None  # a row's next text is mostly the following row's own
        for rows in _pairs(batches):
            cols = [[] for _ in range(5)]
            for _, text, following in rows:
                own = last_sign if text == last else sign(text)
                last, last_sign = following, sign(following)
                edited = edited_text(text, following)
                other = sign(edited)
                for c, v in zip(cols, (edited, own.tobytes().hex(), other.tobytes().hex(), float((own == other).mean()), float((own == last_sign).mean())), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(([r[0] for r in rows], [r[1] for r in rows], *cols), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _ranges(docs).mapInArrow(run, "doc_id long, text string, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
