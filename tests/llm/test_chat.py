"""Chat windows against a plain reading of the rules, and an exact round trip."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nightledger.llm import chat, queries
from nightledger.llm.common import table
from nightledger.llm.vocabularies import byte_pairs, path

SCHEMA = "conv_id long, turn long, role string, text string, window string, tokens string"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = ["<|turn|>", "<|end|>", "\\", "<", "|", "|>", "\n", "n", "\\n", "assistant", "<|end|>\n<|turn|>assistant\n", "é", "𝔘", " ", "\r", " ", "<\\|"]


@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from(PIECES)).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    assert chat.parsed("".join(chat.formatted(*t) for t in turns)) == turns


def plain_windows(turns, budget, history, chapter):
    """One window after another, by adding up; turns: (role, text) in order. Returns texts, masks and token counts."""
    code = byte_pairs(path(RANKS))
    tokens = [len(code.encode_ordinary(chat.formatted(r, t))) for r, t in turns]
    system = bool(turns) and turns[0][0] == "system"
    out, at = [], 0
    while at < len(turns):
        number = sum(tokens[:at]) // (budget * chapter)
        room = budget - (tokens[0] if system and at else 0)
        begin = at
        while begin - 1 >= system and sum(tokens[begin - 1 : at]) <= min(history, room - tokens[at]):
            begin -= 1
        end = at + 1
        while end < len(turns) and sum(tokens[begin : end + 1]) <= room and sum(tokens[:end]) // (budget * chapter) == number:
            end += 1
        context = (turns[:1] if system and at else []) + turns[begin:at]
        new = turns[at:end]
        out.append(("".join(chat.formatted(*t) for t in context + new), len(context), [t for r, t in new if r == "assistant"]))
        at = end
    return out


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def conversation(rnd, n, words=40):
    roles = ["system"] * (rnd.random() < 0.6) + ["user", "assistant"] * n
    return [(r, " ".join(rnd.choice(["alpha", "beta", "<|end|>", "\\", "gamma\n", "δ"]) for _ in range(rnd.randrange(words)))) for r in roles[:n]]


@pytest.fixture(scope="module")
def said(spark):
    rnd = random.Random(5)
    convs = {i: conversation(rnd, rnd.choice([1, 2, 5, 9])) for i in range(40)}
    convs[100] = [("system", "be brief " * 9)] + conversation(rnd, 700)  # many chapters over many ranges
    convs[101] = conversation(rnd, 5) + [("user", "long " * 3000)] + conversation(rnd, 300)  # a turn over several chapters
    convs[102] = [("user", "same")] * 500
    rows = [(i, 3 * k - 7, r, t, "clash", "clash") for i, c in convs.items() for k, (r, t) in enumerate(c)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5), convs


@pytest.mark.parametrize(("budget", "history", "chapter", "range_bytes"), [(120, 30, 4, 5000), (300, 0, 64, 1 << 20), (64, 60, 2, 3000)])
def test_windows(said, budget, history, chapter, range_bytes):
    df, convs = said
    got = chat.format_conversations(df, path(RANKS), budget, history, chapter, range_bytes).collect()
    assert {w["conv_id"] for w in got} == {i for i, c in convs.items() if c}
    for i, turns in convs.items():
        own = sorted((w for w in got if w["conv_id"] == i), key=lambda w: w["window"])
        want = plain_windows(turns, budget, history, chapter)
        assert [w["text"] for w in own] == [w[0] for w in want]
        assert [w["n_repeated"] for w in own] == [w[1] for w in want]
        assert [[chat.unescaped(w["text"][s["start"] : s["stop"]]) for s in w["loss"]] for w in own] == [w[2] for w in want]
        assert all(w["n_tokens"] <= budget or w["n_new"] == 1 for w in own)
    assert len({len(w["text"]) for w in got}) > 5


def test_layout_does_not_matter(said):
    df, _ = said
    a = chat.format_conversations(df, path(RANKS), 120, 30, 4, 5000)
    b = chat.format_conversations(df.repartition(2), path(RANKS), 120, 30, 4, 1 << 20)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.queries()["op13_chat_format"](spark, sf_dir).collect()}
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    assert len(got) == len({r[0] for r in rows})
    for i, r in got.items():
        turns = [(x[2], x[3] or "") for x in sorted(x for x in rows if x[0] == i)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == digest(loss)
        assert r["formatted_chars"] == sum(len(w[0]) for w in plain_windows(turns, 2048, 256, 64))


def test_awkward(spark):
    rows = [(1, None, None, None, "", ""), (1, 0, "assistant", None, "", ""), (None, 1, "user", "x", "", ""), (None, 2, "assistant", "y", "", ""), (2, 1, "assistant", "same", "", ""), (2, 1, "assistant", "same", "", ""), (3, 1, "a\nb", "<|", "", ""), (4, 1, "assistant", "w " * 200_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, path(RANKS))).collect()}
    assert {i: (r["n_turns"], r["loss_chars"]) for i, r in got.items()} == {1: (2, 0), None: (2, 1), 2: (2, 8), 3: (1, 0), 4: (1, 400_000)}
    assert got[1]["turns_sha256"] == digest("\n\nassistant\n\n") and got[3]["turns_sha256"] == digest("a\nb\n<|\n") and got[None]["loss_sha256"] == digest("y")
    assert chat.format_conversations(df.where("false"), path(RANKS)).count() == 0
