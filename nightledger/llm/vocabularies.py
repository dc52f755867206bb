"""Vocabulary files of public tokenizers, loaded once in each worker process."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


def path(name: str) -> str:
    """The place of a vocabulary file on this machine (the same on every worker)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def byte_pairs(ranks: str):
    """A `tiktoken` encoding of a rank file without special tokens: their strings are plain text."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


class Ranks:
    """A byte-level BPE file of `tokenizers`: ids of a text and the bytes of each id."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        # a byte is written as a letter: printable Latin-1 as itself, all others from 256 on in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.bytes = [b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in name) for name, _ in names]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)  # without offsets

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Pieces:
    """A `sentencepiece` model with byte fallback: ids of a text that begins with white space, and the bytes of each id."""

    #: Codes a text after a word, so that its own white space is not taken for the one that the model adds.
    BEFORE = "x"

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.before = self.model.encode(self.BEFORE)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(self.BEFORE + text)[len(self.before) :], np.int64)

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))
