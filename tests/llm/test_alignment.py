"""Alignments of two vocabularies against whole texts, token by token."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nightledger.llm import alignment, queries
from nightledger.llm.common import table
from nightledger.llm.vocabularies import path

FILES = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, groups string, pair string, n string"


@lru_cache(None)
def coders():
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, letters


def plain(text):
    """(a ids, b ids, groups, links) of one text, encoded whole; links are (a id, b id) by comparing byte ranges."""
    a, b, letters = coders()
    if not text:
        return [], [], [], []
    coded = a.encode(f" {text}", add_special_tokens=False)
    size_a = [len(bytes(letters[c] for c in t)) for t in coded.tokens]
    ids_b = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    raw = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
    if b"".join(raw) != f" {text}".encode() or sum(size_a) != len(f" {text}".encode()):
        return [], [], [], []
    ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum([len(r) for r in raw]).tolist()
    cuts, groups, links, i, j = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
    for cut in cuts:
        p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((coded.ids[i:p], ids_b[j:q]))
        links += [(coded.ids[x], ids_b[y]) for x in range(i, p) for y in range(j, q) if ends_a[x] - size_a[x] < ends_b[y] and ends_b[y] - len(raw[y]) < ends_a[x]]
        i, j = p, q
    return coded.ids, ids_b, groups, links


def expected(texts):
    found = {k: plain(t) for k, t in texts.items()}
    count = Counter(x for v in found.values() for x in v[3])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return {k: (len(a), len(b), len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)) for k, (a, b, g, x) in found.items()}


def texts():
    """Texts of awkward pieces, in which white space of all kinds meets."""
    rnd = random.Random(4)
    bits = ["word", "Étion", "  ", " ", " ", " ", "\n", "\n\n", "\t", "\r\n", " ", "　", "\u0085", "\x1c", "<|endoftext|>", "<s>", "<0x41>", "▁", "漢字", "𝔘", "é", "́", "​", "ﬁ", "ﬀ", "'s", "don't", "12345", "!!!", "a", "b" * 40, "\x00", "½", "Ⅷ", "…"]
    out = {k: "".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for k in range(400)}
    out |= {1000: None, 1001: "", 1002: " ", 1003: "\n", 1004: "x", 1005: " x", 1006: "x ", 1007: "word " * 4000, 1008: "z" * 1500, 1009: "漢" * 500, 1010: "a\n b\n\nc \nd"}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    t = texts()
    rows = [(k, v, "clash", "clash", "clash") for k, v in t.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(7), t


@pytest.mark.parametrize("most_pairs", [1 << 22, 0])  # by broadcast and by an exchange
def test_against_whole_texts(corpus, most_pairs):
    df, t = corpus
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align_documents(df, *FILES, most_pairs=most_pairs).collect()}
    want = expected(t)
    assert got == want
    assert sum(w[0] == 0 for w in want.values()) > 3 and sum(w[0] > 0 for w in want.values()) > 100


def test_cache_of_pieces_is_bounded(corpus, monkeypatch):
    df, t = corpus
    small = alignment.Aligner(*FILES, keep=2000)
    monkeypatch.setattr(alignment, "_aligner", lambda *_: small)
    for text in [x for x in t.values() if x][:300]:
        if small.full():
            small.clear()
        found = small.numbers([text])[0]
        a, _, g, links = plain(text)
        if small.sound[found].all():
            assert small.totals[found].sum(axis=0).tolist() == [len(a), len(plain(text)[1]), len(g), len(links)]
        else:
            assert not a


def test_pointer_jumping_labels_components():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(1, 60))
        ends_a = np.append(np.flatnonzero(rnd.random(n) < 0.3) + 1, n + 1)
        ends_b = np.append(np.flatnonzero(rnd.random(n) < rnd.random()) + 1, n + 1)
        label = alignment.terminals(ends_a, ends_b)
        both = np.intersect1d(ends_a, ends_b)
        group = lambda ends: np.searchsorted(both, ends)
        own = np.concatenate([group(ends_a), group(ends_b)])
        assert len(set(zip(label.tolist(), own.tolist(), strict=True))) == len(set(label.tolist())) == len(both)
        assert (ends_a[label] == both[own]).all()


def test_query(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.queries()["op11_token_alignment"](spark, sf_dir).collect()}
    want = expected({r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()})
    assert got == {k: (*v[:6], hashlib.sha256(v[6].encode()).hexdigest() if v[6] else "") for k, v in want.items()}


def test_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, "same words", "", "", ""), (1, "same words", "", "", ""), (None, "same", "", "", ""), (2, None, "", "", "")], SCHEMA)
    got = sorted(map(tuple, alignment.align_documents(df, *FILES).collect()), key=str)
    want = expected(dict(enumerate(["same words", "same words", "same", None])))
    assert got == sorted([(1, *want[0]), (1, *want[1]), (None, *want[2]), (2, *want[3])], key=str)
    assert alignment.align_documents(df.where("false"), *FILES).count() == 0


def test_full_cache_keeps_what_is_met_often(corpus):
    """Pieces of one text go, those of many stay with their numbers' figures, and texts after that come out the same."""
    _, t = corpus
    small, forgot = alignment.Aligner(*FILES, keep=12_000), 0
    for text in [x for x in t.values() if x][:300]:
        if small.full():
            small.numbers(["often and often again"] * 50)
            small.forget()
            assert small.held <= small.keep and "often" in small.number and len(small.totals) == len(small.groups) == len(small.begins) - 1
            forgot += 1
        found = small.numbers([text])[0]
        a, b, g, links = plain(text)
        if small.sound[found].all():
            assert small.totals[found].sum(axis=0).tolist() == [len(a), len(b), len(g), len(links)]
            assert ";".join(small.groups[i] for i in found) == ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
            pairs, n = small.pairs_of(*np.unique(found, return_counts=True))
            assert dict(zip(pairs.tolist(), n.tolist(), strict=True)) == Counter((x << 32) | y for x, y in links)
        else:
            assert not a
    assert forgot > 3


def test_many_texts_at_once_are_cut_as_one_by_one(corpus):
    some = [x for x in corpus[1].values() if x]
    together, alone = alignment.Aligner(*FILES), alignment.Aligner(*FILES)
    for f, text in zip(together.numbers(some), some, strict=True):
        assert [together.groups[i] for i in f] == [alone.groups[i] for i in alone.numbers([text])[0]]
    assert together.numbers([]) == []
