"""Language-model scoring with a log-frequency Bloom filter.

Unigram and bigram counts are quantised on a logarithmic scale; an n-gram at
level q is stored as the q keys (n-gram, 1) ... (n-gram, q). A count is read by
probing levels 1, 2, ... until one is missing. Probabilities interpolate the
bigram's relative frequency with the add-one unigram probability.

The filter grows with the corpus, so it is never held whole: it consists of
segments of a fixed size, an n-gram's segment follows from its hash, and each
segment is built and probed in one task, which is sent the n-grams that the texts
ask for. Texts are dealt into blocks of about ``block_bytes`` by a hash. Every
block sends its distinct n-grams, with their counts in its training texts, to
the segments; a segment sums the counts, sets its bits, and answers each block
with the levels that it reads back (and with the words' exact counts, which the
base score needs). N-grams and answers are in the order of the hash, so a block
finds them by position. There is one way at every size: two exchanges of packed
bytes, one of texts that both uses share, and nothing that grows on the driver
or in a broadcast.

Defined results: null or blank text is the end token alone; a null doc_id is
hashed as empty text; repeated rows score alike, once each; with no training row
every count is 0 and N and V are 0; an empty table gives no rows; other columns
are not read. Token counts are keyed by 64-bit hashes of the words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_text, mixed, raw_texts, word_hashes

#: Keys of the end token (no word is empty) and of the start of a text (a history only).
END, START = (int(x) for x in word_hashes([b"", b" "]))
SEGMENT_BITS = 1 << 23
PROBES = 6
#: More tasks than this do not help; each then holds several blocks or segments, one after another.
MOST_TASKS = 1 << 15
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def levels(step: float = 1.15, top: float = 1e16) -> np.ndarray:
    """The least count of each level: 1, 2, 3, ... and then growing by ``step``."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * step)))
    return np.array(out)


LEVELS = levels()
#: What a count of each level is taken for; level 0 is no count.
VALUES = np.concatenate([[0.0], np.sqrt(LEVELS[:-1] * (LEVELS[1:] - 1.0))])


def tokens_of(text: bytes, most: int = 1 << 20) -> np.ndarray:
    """Hashes of the lower-cased words and the end; long texts are split a part at a time."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + most)
        end = cut.start() if cut else len(text)
        parts.append(word_hashes(text[at:end].lower().split()))
        at = end + 1
    return np.concatenate([*parts, np.array([END], U64)])


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it (the start for the first)."""
    before = np.concatenate([[U64(START)], tokens[:-1]])
    return mixed(before * U64(0xD6E8FEB86659FD93) + tokens)


def unigram_key(tokens: np.ndarray) -> np.ndarray:
    """One to one."""
    return mixed(tokens ^ U64(0xA0761D6478BD642F))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """By the upper 24 bits (32, where there are more segments), in order of the key."""
    bits = 24 if segments <= 1 << 24 else 32
    return ((keys >> U64(64 - bits)) * U64(segments) >> U64(bits)).astype(np.int64)


def probe_pair(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the bit positions of (key, level) within a segment, from the key's lower 32 bits."""
    x = mixed((keys & U64((1 << 32) - 1)) + np.asarray(level).astype(U64) * U64(0x9E3779B97F4A7C15))
    return x & U64(SEGMENT_BITS - 1), (x >> U64(23)) | U64(1)


class Segment:
    """One segment of the filter."""

    def __init__(self):
        self.bits = np.zeros(SEGMENT_BITS, bool)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Stores distinct keys at the levels of their counts."""
        top = np.searchsorted(LEVELS, counts, side="right")
        for level in range(1, int(top.max(initial=0)) + 1):
            start, stride = probe_pair(keys[top >= level], level)
            for i in range(PROBES):
                self.bits[((start + U64(i) * stride) & U64(SEGMENT_BITS - 1)).astype(np.int64)] = True

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The levels of the keys, by one membership probe after another."""
        known, alive, level = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 0
        while len(alive):
            level += 1
            start, stride = probe_pair(keys[alive], level)
            for i in range(PROBES):
                hit = self.bits[((start + U64(i) * stride) & U64(SEGMENT_BITS - 1)).astype(np.int64)]
                alive, start, stride = alive[hit], start[hit], stride[hit]
            known[alive] = level
        return known


class Keys:
    """Distinct keys with counts, gathered a part at a time."""

    def __init__(self):
        self.keys, self.counts, self.parts, self.waiting = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, learn: bool) -> None:
        self.parts.append((keys, learn))
        self.waiting += len(keys)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        weights = [self.counts, *(np.full(len(k), int(learn)) for k, learn in self.parts)]
        self.keys, at = np.unique(np.concatenate([self.keys, *(k for k, _ in self.parts)]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate(weights), len(self.keys)).astype(np.int64)
        self.parts, self.waiting = [], 0

    def by_segment(self, segments: int) -> np.ndarray:
        """Where each segment's keys begin."""
        self.settle()
        return np.searchsorted(segment_of(self.keys, segments), np.arange(segments + 1))


def low_bytes(keys: np.ndarray) -> bytes:
    """The lower 32 bits of each key; with its segment they tell n-grams apart but for one in ten thousand."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :4].tobytes()


def from_low_bytes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(U64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each, or in eight where one does not fit."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<i8").tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that narrow() wrote."""
    return np.frombuffer(raw, np.uint8 if len(raw) == n else "<i8").astype(np.int64)


def _binary(names: str, columns: list[list], first: int):
    """A batch whose first ``first`` columns are longs and all others binary."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < first else pa.binary()) for i, c in enumerate(columns)], names=names.split())


def _unigrams(docs: DataFrame) -> DataFrame:
    """(token, n): exact counts; tokens by their 64-bit hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = Keys()
            for text in raw_texts(batch):
                found.add(tokens_of(text), True)
            found.settle()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys.view(np.int64)), pa.array(found.counts)], names=["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _asked(blocks: DataFrame, segments: int) -> DataFrame:
    """For every block and segment: the block's distinct words and bigrams there, with their training counts."""
    names = "segment block words word_counts pairs pair_counts"

    def run(batches):
        now, words, pairs = None, Keys(), Keys()

        def rows():
            a, b = words.by_segment(segments), pairs.by_segment(segments)
            some = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
            for lo in range(0, len(some), 4096):
                cols = [[] for _ in range(6)]
                for s in some[lo : lo + 4096].tolist():
                    w, p = slice(a[s], a[s + 1]), slice(b[s], b[s + 1])
                    row = s, now, words.keys[w].tobytes(), narrow(words.counts[w]), low_bytes(pairs.keys[p]), narrow(pairs.counts[p])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield _binary(names, cols, 2)

        for batch in batches:
            for block, learn, text in zip(batch.column("block").to_pylist(), batch.column("learn").to_pylist(), raw_texts(batch), strict=True):
                if block != now and now is not None:
                    yield from rows()
                    words, pairs = Keys(), Keys()
                now, tokens = block, tokens_of(text)
                words.add(unigram_key(tokens), learn)
                pairs.add(bigrams(tokens), learn)
        if now is not None:
            yield from rows()

    return blocks.sortWithinPartitions("block").mapInArrow(run, "segment long, block long, words binary, word_counts binary, pairs binary, pair_counts binary")


def _answered(asked: DataFrame, segments: int) -> DataFrame:
    """For every block and segment: exact counts of its words, and the levels of its words and bigrams in the filter."""
    names = "segment block counts word_levels pair_levels"

    def run(batches):
        def rows(segment, held):
            blocks, words, word_counts, pairs, pair_counts = zip(*held, strict=True)
            filled = Segment()
            answers = []
            for keys, counted in (
                (np.frombuffer(b"".join(words), U64), [wide(c, len(x) // 8) for c, x in zip(word_counts, words, strict=True)]),
                (from_low_bytes(b"".join(pairs)), [wide(c, len(x) // 4) for c, x in zip(pair_counts, pairs, strict=True)]),
            ):
                keys, at = np.unique(keys, return_inverse=True)
                total = np.bincount(at, np.concatenate(counted), len(keys)).astype(np.int64)
                filled.add(keys[total > 0], total[total > 0])
                answers.append((keys, at, total))
            (w, w_at, w_total), (p, p_at, _) = answers
            counts, w_level, p_level = w_total[w_at], filled.read(w)[w_at], filled.read(p)[p_at]
            w_cut, p_cut = np.cumsum([0, *(len(x) // 8 for x in words)]), np.cumsum([0, *(len(x) // 4 for x in pairs)])
            for lo in range(0, len(blocks), 4096):
                here = range(lo, min(lo + 4096, len(blocks)))
                word, pair = [slice(w_cut[i], w_cut[i + 1]) for i in here], [slice(p_cut[i], p_cut[i + 1]) for i in here]
                yield _binary(names, [[segment] * len(here), list(blocks[lo : lo + 4096]), [narrow(counts[s]) for s in word], [w_level[s].tobytes() for s in word], [p_level[s].tobytes() for s in pair]], 2)

        now, held = None, []
        for batch in batches:
            for segment, *row in zip(*(batch.column(c).to_pylist() for c in ("segment", "block", "words", "word_counts", "pairs", "pair_counts")), strict=True):
                if segment != now and held:
                    yield from rows(now, held)
                    held = []
                now = segment
                held.append(row)
        if held:
            yield from rows(now, held)

    tasks = min(segments, MOST_TASKS)
    dealt = asked.repartitionById(tasks, F.pmod("segment", F.lit(tasks)).cast("int")).sortWithinPartitions("segment")
    return dealt.mapInArrow(run, "segment long, block long, counts binary, word_levels binary, pair_levels binary")


def score_texts(docs: DataFrame, training, block_bytes: int = 4 << 20, bits_per_token: int = 8, weight: float = 0.2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text.

    ``training`` is a condition on the rows of ``docs`` (doc_id, text) from which
    counts are learned. ``weight`` is the bigram's share in the interpolation.
    The score is the log10 probability of the text's words and its end.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), training.alias("learn"))
    size, learned = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)), F.count(F.when(F.col("learn"), 1))).first()
    n_all, distinct = _unigrams(docs.where("learn")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = n_all + distinct + 1.0
    start = VALUES[np.searchsorted(LEVELS, learned, side="right")]  # of the history of a text's first word
    segments, parts = max(1, -(-bits_per_token * n_all // SEGMENT_BITS)), max(1, -(-size // block_bytes))
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"

    def score(texts, answers):
        import pyarrow as pa

        answers = answers.sort_by("segment")
        joined = lambda c, kind: np.frombuffer(b"".join(answers.column(c).to_pylist()), kind)
        word_level, pair_level = joined("word_levels", np.uint8), joined("pair_levels", np.uint8)
        counts = np.concatenate([wide(c, len(x)) for c, x in zip(answers.column("counts").to_pylist(), answers.column("word_levels").to_pylist(), strict=True)])
        lists = [tokens_of(t) for t in raw_texts(texts)]
        cuts = np.cumsum([0, *map(len, lists)])
        words, pairs = unigram_key(np.concatenate(lists)), np.concatenate([bigrams(t) for t in lists])
        del lists
        own, own_pairs = np.unique(words), np.unique(pairs)
        first = np.zeros(len(words), bool)
        first[cuts[:-1]] = True
        logs, base, known = np.empty(len(words)), np.empty(len(words)), np.empty(len(words), np.int64)
        history = 0.0
        for lo in range(0, len(words), 1 << 18):
            at = np.searchsorted(own, words[lo : lo + (1 << 18)])
            here = slice(lo, lo + len(at))
            one, two = VALUES[word_level[at]], VALUES[pair_level[np.searchsorted(own_pairs, pairs[here])]]
            before = np.where(first[here], start, np.concatenate([[history], one[:-1]]))
            history = one[-1]
            joint = np.minimum(two, np.minimum(before, one))
            single = (one + 1) / floor
            logs[here] = np.log10(np.where(before > 0, weight * joint / np.maximum(before, 1) + (1 - weight) * single, single))
            base[here] = np.log10((counts[at] + 1) / floor)
            known[here] = counts[at] > 0
        sums = [np.add.reduceat(x, cuts[:-1]) for x in (known, base, logs)]
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(cuts)), *map(pa.array, sums)], names=names)

    # two uses of one exchange of the texts
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).repartition(min(parts, MOST_TASKS), "block")
    answers = _answered(_asked(blocks, segments), segments)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def seventh(doc_id, remainder: int = 2):
    """Whether crc32(doc_id as text) mod 7 is the remainder."""
    return crc_text(doc_id) % 7 == remainder
