"""Packing: minimum bin slack over token counts.

Documents are tokenised where they are read and packed in the same task, a
bounded buffer of tokens at a time, so nothing is shuffled and no task sees more
than its own input split. For each window of ``capacity`` tokens the largest
remaining item is taken and a subset-sum over the other remaining lengths, kept
as one bitset (bit ``s`` set: some multiset of lengths sums to ``s``), finds the
fill closest to the capacity; the bitsets after each length give the counts back.
Where no multiset fills the window exactly, the smallest item that remains is cut
to fill it. What is left when the input ends goes into sequences whose lengths
are powers of two, which need no padding.

Defined results: a null or empty text is a document of one token (the end id);
a null ``doc_id`` is carried as it is; repeated rows are packed as often as they
occur; an empty table gives no rows; other columns are not read, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack
from unicodedata import is_normalized

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, raw_texts

#: Byte-level vocabularies write a byte as a letter: printable Latin-1 as itself, all others from 256 on in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def closest_multiset(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Counts by length of the multiset of at most ``counts`` whose sum is closest to ``room`` from below.

    ``lengths`` are distinct. The sums that can be reached are the bits of one
    integer; a length with count c is added as blocks of 1, 2, 4, ... copies.
    The search ends at the first exact fill.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for length, count in zip(lengths, counts, strict=True):
        block = 1
        while count > 0 and length * min(block, count) <= room:
            n = min(block, count)
            grown = (reached | (reached << (length * n))) & mask
            if grown != reached:
                steps.append((length, n, reached))
                reached = grown
            count, block = count - n, block * 2
        if reached >> room & 1:
            break
    total, taken = reached.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return taken


class Packer:
    """Packs the items of one task; ``emit`` receives (item, sequence, offset, length) in order."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.sequence = capacity, first
        self.waiting: dict[int, list] = {}  # remaining items by length; an item: [document, start]
        self.tokens = 0
        self.out: list[tuple] = []

    def add(self, doc, n: int) -> None:
        """A document of n tokens: whole windows at once, the rest waits."""
        start = 0
        while n - start >= self.capacity:
            self._place([(doc, start, self.capacity)])
            start += self.capacity
        if n > start:
            self._wait(doc, start, n - start)

    def _wait(self, doc, start: int, length: int) -> None:
        self.waiting.setdefault(length, []).append((doc, start))
        self.tokens += length

    def _take(self, length: int) -> tuple:
        items = self.waiting[length]
        doc, start = items.pop()
        if not items:
            del self.waiting[length]
        self.tokens -= length
        return doc, start, length

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def window(self) -> None:
        """Fills one sequence to the brim; call while at least ``capacity`` tokens wait."""
        lengths = sorted(self.waiting, reverse=True)
        pieces = [self._take(lengths[0])]
        room = self.capacity - pieces[0][2]
        lengths = [x for x in lengths if x in self.waiting]
        if room:
            for length, n in closest_multiset(lengths, [len(self.waiting[x]) for x in lengths], room).items():
                pieces += [self._take(length) for _ in range(n)]
                room -= length * n
        while room:  # no exact fill: cut the smallest item, which leaves the larger ones whole
            doc, start, length = self._take(min(self.waiting))
            used = min(room, length)
            pieces.append((doc, start, used))
            if length > used:
                self._wait(doc, start + used, length - used)
            room -= used
        self._place(pieces)

    def finish(self) -> None:
        """The rest, under one window: sequences of 2^k tokens, largest first."""
        while self.tokens >= self.capacity:
            self.window()
        rest = [self._take(length) for length in sorted(self.waiting, reverse=True) for _ in range(len(self.waiting[length]))]
        rest.reverse()
        left = sum(x[2] for x in rest)
        while left:
            size, pieces = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, length = rest.pop()
                used = min(size, length)
                pieces.append((doc, start, used))
                if length > used:
                    rest.append((doc, start + used, length - used))
                size -= used
            self._place(pieces)


class WordCoder:
    """Ids of a text by word: the vocabulary drops white space and no token spans it, so words repeat exactly.

    At most about ``keep`` words are remembered.
    """

    def __init__(self, vocabulary: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.keep = Tokenizer.from_file(vocabulary), {}, keep
        self.model = self.tokenizer.model

    def learn(self, words: set[bytes]) -> None:
        """Codes new words; those that differ only in ASCII case or in one final comma or stop share their code."""
        plain = {w: self._plain(w) for w in words}
        for stop in (b",", b"."):
            if stop not in self.known:
                self._code([stop])
        self._code([p for p in {p for p, _ in plain.values()} if p not in self.known])
        for w, (p, stop) in plain.items():
            self.known[w] = self.known[p] + self.known[stop] if stop else self.known[p]

    @staticmethod
    def _plain(word: bytes) -> tuple[bytes, bytes]:
        if b"<|" in word:  # may hold a special token, whose case counts
            return word, b""
        stop = word[-1:] if word[-1:] in (b",", b".") and word[-2:-1].isalnum() else b""
        return (word[:-1] if stop else word).lower(), stop

    def _code(self, words: list[bytes]) -> None:
        """Lower-case words of letters alone are one piece, which goes to the BPE model as it is; all others as one text."""
        rest = []
        for w in words:
            t = w.decode()
            if t.isalpha() and t.lower() == t and (t.isascii() or is_normalized("NFC", t)):
                letters = t if t.isascii() else w.decode("latin-1").translate(BYTE_LETTERS)
                self.known[w] = pack(f"<{len(found := self.model.tokenize(letters))}I", *[x.id for x in found])
            else:
                rest.append(w)
        if rest:
            self._code_text(rest)

    def _code_text(self, words: list[bytes]) -> None:
        """Codes the words as one text and cuts the ids where the next word begins."""
        texts = [w.decode() for w in words]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        cuts = np.searchsorted([a for a, _ in coded.offsets], begins).tolist() if coded.ids else [0] * len(begins)
        ids = np.asarray(coded.ids, "<u4").tobytes()
        for w, a, b in zip(words, cuts, cuts[1:], strict=False):
            self.known[w] = ids[4 * a : 4 * b]

    def ids(self, texts: list[bytes], end: bytes) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, with the end id."""
        for text in texts:
            words = text.split()
            new = set(words).difference(self.known)
            if new:
                if len(self.known) > self.keep:
                    self.known, new = {}, set(words)
                self.learn(new)
            out = b"".join(map(self.known.__getitem__, words))
            yield out + end


#: Coders of this worker process by vocabulary; tasks that follow one another share what they learned.
CODERS: dict[str, WordCoder] = {}


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, buffer_tokens: int = 1 << 20, keep: int = 600_000, forget: bool = False) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most ``capacity`` tokens (a power of two).

    ``docs`` has doc_id and text; ``vocabulary`` is the path of a `tokenizers`
    file on every worker. A task packs ``buffer_tokens`` tokens at a time; a worker
    remembers the codes of about ``keep`` words, with ``forget`` for one task only. Every
    sequence is full, but for those of 2^k tokens that end a task's input.
    Returns doc_id, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset. sequence_id is the task's number times 2^32 plus a
    counter, so a task that runs again gives the same ids.
    """
    end = int(end_id).to_bytes(4, "little")

    @giving_back
    def run(batches):
        import pyarrow as pa

        if vocabulary not in CODERS:
            CODERS[vocabulary] = WordCoder(vocabulary)
        coder = CODERS[vocabulary]
        coder.keep = keep
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)
        waiting: dict[int, tuple] = {}  # documents by number: id, ids, tokens not yet placed
        number = 0

        def flush():
            rows, packer.out = packer.out, []
            cols = [[] for _ in range(7)]
            for n, start, length, sequence, offset in rows:
                doc_id, ids, left = waiting[n]
                for c, v in zip(cols, (doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset), strict=True):
                    c.append(v)
                if left == length:
                    del waiting[n]
                else:
                    waiting[n] = (doc_id, ids, left - length)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.ids(raw_texts(part), end), strict=False):
                    number += 1
                    waiting[number] = (doc_id, ids, len(ids) // 4)
                    packer.add(number, len(ids) // 4)
                    if packer.tokens >= buffer_tokens:
                        while packer.tokens >= capacity + buffer_tokens // 4:  # a good choice stays for the next windows
                            packer.window()
                    if len(packer.out) >= 500:
                        yield flush()
        packer.finish()
        if packer.out:
            yield flush()
        if forget:
            CODERS.pop(vocabulary, None)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
