"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes.

Every token points to the token farthest to the right among those of the other
vocabulary that overlap it, if that one ends later (or ends with it and is of the
first vocabulary). Successors are doubled for all tokens at once until nothing
moves; every token has then arrived at the terminal token of its component, which
labels the group. Groups are the components of the overlap graph, so they are cut
where tokens of both vocabularies end.

No token of either vocabulary spans the place before a space or a line break that
follows what is not white space. A text is cut there, and each different piece is
coded and aligned once by a worker, many pieces at a time, laid end to end.

Links are counted over the whole corpus by pair of ids, partially in each task. A
document's sums need the counts of its own pairs only: up to ``most_pairs``
different pairs are broadcast, more are joined by an exchange, with the same rows.

Defined results: a text that is null or empty, or of which either vocabulary does
not give back all bytes, has no tokens: zeros and no groups, and counts for
nothing. Rows that share a doc_id are separate; a null doc_id is carried; repeated
rows count as often as they occur; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_labels, saved
from .vocabularies import Pieces, Ranks

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
#: Pieces begin before a space or a line break that follows what is not white space.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of a, the first and the last token of b whose bytes overlap it; both cover the same bytes."""
    starts = np.concatenate([[0], ends_a[:-1]])
    return np.searchsorted(ends_b, starts, side="right"), np.searchsorted(ends_b, ends_a, side="left")


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token's number for each token of a, then of b; b's are numbered after a's."""
    n = len(ends_a)
    last_b, last_a = overlaps(ends_a, ends_b)[1], overlaps(ends_b, ends_a)[1]
    to_b = np.where(ends_b[last_b] > ends_a, last_b + n, np.arange(n))
    to_a = np.where(ends_a[last_a] >= ends_b, last_a, np.arange(len(ends_b)) + n)
    at = np.concatenate([to_b, to_a])
    while True:
        further = at[at]
        if np.array_equal(further, at):
            return at
        at = further


def link_pairs(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, id pair) of every overlapping pair of occurrences; a pair is a's id times 2^32 plus b's."""
    first, last = overlaps(ends_a, ends_b)
    many = last - first + 1
    which = np.repeat(np.arange(len(ids_a)), many)
    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[which]
    return which, (ids_a[which].astype(np.int64) << 32) | ids_b[other]


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, last: np.ndarray) -> list[str]:
    """'a1,a2|b1;a3|b2' of every piece; the labels are ascending, ``last`` are the numbers of the pieces' last tokens of b."""
    end_a, end_b = (np.append(np.diff(x) != 0, True) for x in (label_a, label_b))
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    cut_a, cut_b = np.append(0, np.flatnonzero(end_a) + 1), np.append(0, np.flatnonzero(end_b) + 1)
    mark_b = np.where(end_b, ";", ",").astype(object)
    mark_b[last] = "\n"
    parts = np.empty(2 * (len(ids_a) + len(ids_b)), object)  # a group's ids of a stand before its ids of b, each with the mark after it
    for ids, at, marks in ((ids_a, np.arange(len(ids_a)) + cut_b[group_a], np.where(end_a, "|", ",")), (ids_b, np.arange(len(ids_b)) + cut_a[group_b + 1], mark_b)):
        parts[2 * at], parts[2 * at + 1] = list(map(str, ids.tolist())), marks
    return "".join(parts.tolist()).split("\n")[:-1]


class Aligner:
    """The pieces that a worker has met, coded and aligned; at most about ``keep`` bytes of them.

    ``totals`` has n_a, n_b, groups and links of each piece, ``sound`` whether its
    bytes came back, ``loose`` whether it ends in white space; ``pairs`` from
    ``begins[i]`` to ``begins[i + 1]`` are piece i's links. Piece 0 is the nothing
    between two spaces, and loose. The groups are written if ``grouped``.
    """

    def __init__(self, ranks: str, pieces: str, keep: int = 224 << 20, grouped: bool = True):
        self.a, self.b, self.keep, self.grouped = Ranks(ranks), Pieces(pieces), keep, grouped
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.held, self._waiting = 0, []
        self.loose = np.ones(1, bool)
        self.totals, self.sound, self.pairs, self.begins = np.zeros((1, 4), np.int64), np.ones(1, bool), np.zeros(0, np.int64), np.zeros(2, np.int64)
        self.sizes, self.met = np.zeros(1, np.int64), np.zeros(1, np.int64)  # about the bytes that each piece takes here; how often it was met
        self.groups: list[str] = [""]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces, after learning what is new in all of them."""
        found, bounds = self.flat(texts)
        return [found[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces, end to end, and where each text begins; a text has at least one.

        A piece is known by its text without the leading space; one that begins
        with a line break or with more white space is known by all of it.
        """
        if not texts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        found = self._lookup(" ".join(texts).replace("\n", " \n").split(" "))
        bounds = np.cumsum([0, *(t.count(" ") + t.count("\n") + 1 for t in texts)])
        # where white space meets white space, or ends the text
        rest = np.flatnonzero(np.logical_or.reduceat(self.loose[found], bounds[:-1]))
        if len(rest):
            cut = [[p[1:] if p[0] == " " and p[1:2] not in ("", " ", "\n") else p for p in _CUT.split(f" {texts[i]}")] for i in rest]
            again, each = self._lookup(list(chain.from_iterable(cut))), [found[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
            for i, f in zip(rest, np.split(again, np.cumsum([len(c) for c in cut])[:-1]), strict=True):
                each[i] = f
            found, bounds = np.concatenate(each), np.cumsum([0, *map(len, each)])
        self.met += np.bincount(found, minlength=len(self.met))
        return found, bounds

    def _lookup(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(map(words.__getitem__, new))))
            found[new] = list(map(self.number.__getitem__, map(words.__getitem__, new)))
        return found

    def forget(self) -> None:
        """Leaves the pieces that were met most often, half of them at most; what was met before counts half from now on."""
        stays = self.met > max(1, np.median(self.met))
        stays[0] = True
        number = np.cumsum(stays) - 1
        self.number = {w: int(number[n]) for w, n in self.number.items() if stays[n]}
        self.groups = [self.groups[i] for i in np.flatnonzero(stays).tolist()]
        self.pairs = self.pairs[np.repeat(stays, self.totals[:, 3])]
        self.loose, self.totals, self.sound, self.sizes, self.met = (x[stays] for x in (self.loose, self.totals, self.sound, self.sizes, self.met // 2))
        self.begins, self.held = np.append(0, np.cumsum(self.totals[:, 3])), int(self.sizes.sum())
        if self.held > self.keep * 3 // 4:
            self.clear()

    def full(self) -> bool:
        return self.held > self.keep

    def _learn(self, words: list[str]) -> None:
        texts = [w if w[0] in " \n" else f" {w}" for w in words]
        # pieces that end in white space do not leave the next one alone
        plain = [i for i, t in enumerate(texts) if not t[-1].isspace()]
        rest = [i for i, t in enumerate(texts) if t[-1].isspace()]
        for some in [plain[i : i + 4000] for i in range(0, len(plain), 4000)] + [[i] for i in rest]:
            self._align([words[i] for i in some], [texts[i] for i in some])
        loose, totals, sound, pairs, begins, sizes = zip(*self._waiting, strict=True)
        self.begins = np.concatenate([self.begins, np.cumsum(np.concatenate(begins)) + len(self.pairs)])
        self.loose, self.totals = np.concatenate([self.loose, *loose]), np.concatenate([self.totals, *totals])
        self.sound, self.pairs, self._waiting = np.concatenate([self.sound, *sound]), np.concatenate([self.pairs, *pairs]), []
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.met = np.append(self.met, np.zeros(len(self.sizes) - len(self.met), np.int64))

    def _align(self, words: list[str], texts: list[str]) -> None:
        """Adds the pieces, laid end to end; where the bytes do not come back, one by one."""
        raw = [t.encode() for t in texts]
        whole = b"".join(raw)
        ids_a, ids_b = self.a.ids("".join(texts)), self.b.ids("".join(texts))
        if self.a.text(ids_a) != whole or self.b.text(ids_b) != whole:
            if len(words) > 1:
                for w, t in zip(words, texts, strict=True):
                    self._align([w], [t])
            else:
                self._add(words, np.zeros((1, 4), np.int64), np.zeros(1, bool), np.zeros(0, np.int64), [""])
            return
        ends_a, ends_b, ends = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b]), np.cumsum([len(r) for r in raw])
        label = terminals(ends_a, ends_b)
        label_a, label_b = label[: len(ids_a)], label[len(ids_a) :]
        at_a, at_b = np.searchsorted(ends_a, ends, side="right"), np.searchsorted(ends_b, ends, side="right")
        at_g = np.cumsum(np.concatenate([[1], np.diff(label_a) != 0]))[at_a - 1]
        which, pairs = link_pairs(ids_a, ids_b, ends_a, ends_b)
        at_l = np.searchsorted(which, at_a)
        totals = np.stack([np.diff(x, prepend=0) for x in (at_a, at_b, at_g, at_l)], axis=1)
        groups = group_strings(ids_a, ids_b, label_a, label_b, at_b - 1) if self.grouped else [""] * len(words)
        self._add(words, totals, np.ones(len(words), bool), pairs, groups)

    def _add(self, words, totals, sound, pairs, groups) -> None:
        first = len(self.groups)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.groups += groups
        sizes = 170 + 2 * np.array(list(map(len, words))) + 8 * totals[:, 3] + (80 + 8 * totals[:, :2].sum(axis=1)) * self.grouped
        self._waiting.append((np.array([w[-1].isspace() for w in words]), totals, sound, pairs, totals[:, 3], sizes))
        self.held += int(sizes.sum())

    def pairs_of(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of these pieces and how many links hold each; ``counts`` are the pieces' own."""
        many = self.totals[numbers, 3]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begins[numbers], many)
        pairs, where = np.unique(self.pairs[at], return_inverse=True)
        return pairs, np.bincount(where, np.repeat(counts, many), len(pairs)).astype(np.int64)


#: This worker's aligner, kept from task to task.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(ranks: str, pieces: str, grouped: bool) -> Aligner:
    if (ranks, pieces) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[ranks, pieces] = Aligner(ranks, pieces)
    aligner = _ALIGNERS[ranks, pieces]
    if grouped and not aligner.grouped:
        aligner.clear()
    aligner.grouped = grouped
    return aligner


def _texts(batches, size: int = 2 << 20):
    """(doc_ids, texts) of about ``size`` bytes or of one row."""
    import pyarrow.compute as pc

    for batch in batches:
        before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(before // size)) + 1):
            if len(rows):
                some = batch.slice(rows[0], len(rows))
                yield some.column("doc_id").to_pylist(), some.column("text").to_pylist()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sums of each text's rows."""
    return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else values[:0]


def pair_counts(docs: DataFrame, ranks: str, pieces: str) -> DataFrame:
    """pair and n: the links of the whole corpus by id pair; a task sends each of its pairs about once."""

    def run(batches):
        import pyarrow as pa

        aligner = _aligner(ranks, pieces, False)
        seen = np.zeros(len(aligner.totals), np.int64)

        def counted():
            used = np.flatnonzero(seen)
            pairs, n = aligner.pairs_of(used, seen[used])
            for lo in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 50_000]), pa.array(n[lo : lo + 50_000])], names=["pair", "n"])

        for _, texts in _texts(batches):
            if aligner.full():
                yield from counted()
                aligner.forget()
                seen = np.zeros(len(aligner.totals), np.int64)
            found, bounds = aligner.flat([t for t in texts if t])
            sound = _sums(~aligner.sound[found], bounds) == 0
            times = np.bincount(found[np.repeat(sound, np.diff(bounds))], minlength=len(aligner.totals))
            times[: len(seen)] += seen
            seen = times
        yield from counted()

    return docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _aligned(docs: DataFrame, ranks: str, pieces: str, counts=None) -> DataFrame:
    """SCHEMA's rows with n_best and count_sum from ``counts`` (a broadcast of pairs, n and best); without it, with each row's pairs instead."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        aligner = _aligner(ranks, pieces, True)
        if counts is not None:
            keys, n, best = (x if len(counts.value[0]) else np.zeros(1, np.int64) for x in counts.value)
        scores, paired = np.zeros((0, 2), np.int64), 0  # best links and count sums of the pieces scored so far

        def score():
            nonlocal scores, paired
            begun = len(scores)
            fresh = aligner.pairs[paired:]
            # pairs of pieces that only unsound texts have were not counted, and are not asked for
            at = np.minimum(np.searchsorted(keys, fresh), len(keys) - 1)
            sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([best[at], n[at]], axis=1), axis=0, dtype=np.int64)])
            ends = aligner.begins[begun:] - paired
            scores, paired = np.concatenate([scores, np.diff(sums[ends], axis=0)]), len(aligner.pairs)

        def joined(found, bounds):
            """The groups of each text; Python sees each different piece once."""
            used, where = np.unique(found, return_inverse=True)
            words = pa.array(list(map(aligner.groups.__getitem__, used.tolist())), pa.string()).take(pa.array(where))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words), ";")

        for ids, texts in _texts(batches):
            if aligner.full():
                aligner.forget()
                scores, paired = np.zeros((0, 2), np.int64), 0
            full = np.array([bool(t) for t in texts])
            found, bounds = aligner.flat([t for t in texts if t])
            sound = _sums(~aligner.sound[found], bounds) == 0
            full[full] = sound
            # only sound texts have tokens
            found, bounds = found[np.repeat(sound, np.diff(bounds))], np.cumsum([0, *np.diff(bounds)[sound]])
            sums = np.zeros((len(texts), 6), np.int64)
            sums[full, :4] = _sums(aligner.totals[found], bounds)
            if counts is not None:
                if len(scores) < len(aligner.totals):
                    score()
                sums[full, 4:] = _sums(scores[found], bounds)
            at = np.where(full, np.cumsum(full) - 1, -1)
            groups = pc.fill_null(joined(found, bounds).take(pa.array(at, mask=at < 0)), "")
            arrays = [pa.array(ids, pa.int64()), *map(pa.array, sums.T.copy()), groups]
            if counts is None:
                own = [aligner.pairs_of(*np.unique(found[i:j], return_counts=True)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                none = np.zeros(0, np.int64), np.zeros(0, np.int64)
                arrays += [pa.array(x, pa.list_(pa.int64())) for x in zip(*(own[i] if i >= 0 else none for i in at), strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")] + ["pairs", "times"]
            yield pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

    schema = SCHEMA if counts is not None else f"{SCHEMA}, pairs array<long>, times array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def align_documents(docs: DataFrame, ranks: str, pieces: str, most_pairs: int = 1 << 22) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``ranks`` and ``pieces`` are the paths of a byte-level BPE file of `tokenizers`
    and a `sentencepiece` model on every worker. n_best are the links whose pair is
    the most frequent one of its b id, count_sum is the sum of the pairs' counts
    over the row's links; groups are 'a1,a2|b1;a3|b2'.
    """
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = saved(pair_counts(docs, ranks, pieces).withColumn("b", b_id))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each id of a vocabulary
    counts = counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("int").alias("best"))
    total = counts.count()
    if total <= most_pairs:
        found = counts.toArrow()
        keys, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(keys)
        return _aligned(docs, ranks, pieces, docs.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int8))))
    rows = saved(_aligned(docs, ranks, pieces).withColumn("row", F.monotonically_increasing_id()))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    held = counts.agg(F.sum("n")).first()[0]  # a pair stands in n rows at most
    met = join_labels(links, counts.select("pair", F.col("n").alias("count"), "best", "n"), "pair", held)
    sums = met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("links_best"), F.sum(F.col("times") * F.col("count")).alias("counts"))
    joined = rows.drop("pairs", "times").join(sums, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("links_best", F.lit(0)).alias("n_best"), F.coalesce("counts", F.lit(0)).alias("count_sum"), "groups")
