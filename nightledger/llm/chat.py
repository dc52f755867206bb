"""Chat formatting: conversations as budgeted, turn-aligned windows with a loss mask.

A turn is written as its role and its text between control strings; the same
strings inside a role or a text are escaped, so the turns can be read back
exactly. Prefix sums of the turns' tokens choose the windows: each takes as many
whole turns as fit its budget, after the conversation's system turn and a limited
run of the turns just before, which are repeated for context and masked. Only
assistant turns that are new in a window count for the loss, so each counts once.

A conversation of more than ``chapter`` windows is cut into chapters at multiples
of its own prefix sum, which no layout of the rows changes. Prefix sums of such
conversations run over ranges of turns, with what the ranges before hold carried
over, so that no task sees more than a chapter of any conversation.

Defined results: a null text or role is empty; turns follow one another by turn,
then by the hash of role and text (a null turn first); repeated rows are repeated
turns; a null conv_id is one conversation; a turn over the budget has a window of
its own and is not cut; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, MOST_PARTS, saved
from .vocabularies import byte_pairs

#: The template's control strings; both begin with what ``escaped`` breaks up.
OPEN, CLOSE = "<|turn|>", "<|end|>"
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)
_MARK = re.compile(r"\\(.)", re.S)

WINDOW = "conv_id long, window long, text string, loss array<struct<start: int, stop: int>>, n_repeated int, n_new int, n_tokens long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    """``text`` without any control string; ``unescaped`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def header(role: str) -> str:
    return OPEN + escaped(role).replace("\n", "\\n") + "\n"


def formatted(role: str, text: str) -> str:
    return f"{header(role)}{escaped(text)}{CLOSE}\n"


def parsed(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a window, repeated ones included."""
    return [(unescaped(role), unescaped(text)) for role, text in _TURN.findall(window)]


def spans(tokens: np.ndarray, first: int, system: int, budget: int, history: int):
    """(repeated from, new from, new to) of each window over a run of turns.

    ``tokens`` are the turns' counts, of which those before ``first`` only serve
    as history; ``system`` is what the system turn takes in every window.
    """
    upto = np.concatenate([[0], np.cumsum(tokens)])
    at = first
    while at < len(tokens):
        room = budget - system
        back = min(history, room - int(tokens[at]))
        begin = int(np.searchsorted(upto, upto[at] - back)) if back > 0 else at
        end = int(np.searchsorted(upto, upto[begin] + room, side="right")) - 1
        end = max(end, at + 1)
        yield begin, at, end
        at = end


def _chapter_windows(conv_id, chapter: int, rows: list[tuple], budget: int, history: int):
    """Window rows of one chapter; a row: kind (0 the system turn, 1 history, 2 own), role, text, tokens."""
    system = rows[0] if rows[0][0] == 0 else None
    turns = [r for r in rows if r[0] > 0]
    first = sum(r[0] == 1 for r in turns)
    if first == len(turns):
        return
    held = 0  # the window that has the system turn as its own does not repeat it
    if chapter == 0 and turns[0][1] == "system":
        system, held = turns[0], 1
    tokens = np.array([r[3] for r in turns], np.int64)
    found = []
    if held:  # the first window begins with the system turn; later ones repeat it
        _, _, end = next(spans(tokens, 0, 0, budget, 0))
        found.append((0, 0, end))
        found += [(b + 1, a + 1, e + 1) for b, a, e in spans(tokens[1:], end - 1, int(tokens[0]), budget, history)]
    else:
        found = list(spans(tokens, first, int(system[3]) if system else 0, budget, history))
    for k, (begin, new, end) in enumerate(found):
        context = ([system] if system and not (held and new == 0) else []) + turns[begin:new]
        parts, loss = [formatted(r[1], r[2]) for r in context], []
        at = sum(map(len, parts))
        for r in turns[new:end]:
            head, body = header(r[1]), escaped(r[2])
            parts.append(f"{head}{body}{CLOSE}\n")
            if r[1] == "assistant":
                loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
            at += len(parts[-1])
        yield conv_id, (chapter << 32) + k, "".join(parts), loss, len(context), end - new, int(sum(r[3] for r in context) + tokens[new:end].sum())


def _batches(rows, schema, most: int = 500):
    """Record batches of ``most`` rows."""
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches, most: int = 1000):
    """Rows as tuples, a few at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, most).columns), strict=True)


def _arrow(ddl: str):
    """The Arrow schema of a DDL string (made on the driver: it asks the session)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _ranged(turns: DataFrame, vocabulary: str, range_bytes: int) -> DataFrame:
    """The turns of long conversations with ``tokens`` and ``before``, the tokens of all turns before.

    They are sorted over ranges and saved; a row a range tells what of the last
    conversation in it the next ranges have to add.
    """
    size = turns.agg(F.sum("weight")).first()[0] or 0
    parts = max(1, min(MOST_PARTS, -(-size // range_bytes)))
    keys = ["conv_id", "turn", "tie", "row"]
    ordered = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ddl = "part int, conv_id long, turn long, tie long, role string, text string, tokens long"
    ends = "part int, first long, last long, tokens long, whole boolean"
    schema, end_schema, out_schema = _arrow(ddl), _arrow(ends), _arrow(f"{ddl}, before long")

    def count(batches):
        import pyarrow as pa

        code, part = byte_pairs(vocabulary).encode_ordinary, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                tokens = [len(code(formatted(r, t))) for r, t in zip(some.column("role").to_pylist(), some.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(tokens), pa.int32()), *some.columns, pa.array(tokens, pa.int64())], schema=schema)

    counted = saved(ordered.select("conv_id", "turn", "tie", "role", "text").mapInArrow(count, ddl))

    def edges(batches):
        first = last = None
        part, tokens, whole = None, 0, True
        for p, conv, n in _rows(batches):
            if part is None:
                part, first, last = p, conv, conv
            elif conv != last:
                last, tokens, whole = conv, 0, False
            tokens += n
        if part is not None:
            yield from _batches([(part, first, last, tokens, whole)], end_schema)

    carry, open_conv, open_tokens = {}, (), 0
    for e in sorted(counted.select("part", "conv_id", "tokens").mapInArrow(edges, ends).collect()):  # a row a range
        start = open_tokens if open_conv == (e["first"],) else 0
        carry[e["part"]] = start
        open_conv, open_tokens = (e["last"],), e["tokens"] + (start if e["whole"] else 0)

    def run(batches):
        import pyarrow as pa

        last, before = (), 0
        for batch in batches:
            out = []
            for p, conv, n in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "tokens")), strict=True):
                if last != (conv,):
                    before, last = carry[p] if not last else 0, (conv,)
                out.append(before)
                before += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=out_schema)

    return counted.mapInArrow(run, f"{ddl}, before long")


def format_conversations(turns: DataFrame, vocabulary: str, budget: int = 2048, history: int = 256, chapter: int = 64, range_bytes: int = 16 << 20) -> DataFrame:
    """Windows of all conversations: conv_id, window (in order), text, loss, n_repeated, n_new, n_tokens.

    ``turns`` has conv_id, turn, role and text; ``vocabulary`` is the path of a
    byte-pair rank file on every worker. ``loss`` are the code points of the
    window's text that the loss counts; its first n_repeated turns are context.
    A window holds at most ``budget`` tokens (the sum of its turns' own counts),
    of which at most ``history`` are of the turns before it.
    """
    size = budget * chapter
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text).withColumn("tie", F.xxhash64("role", "text"))
    # a turn has no more tokens than its formatted text has bytes
    t = t.withColumn("weight", 2 * (F.octet_length("role") + F.octet_length("text")).cast("long") + len(OPEN) + len(CLOSE) + 2)
    long_ids = saved(t.groupBy("conv_id").agg(F.sum("weight").alias("w")).where(F.col("w") > size).select(F.col("conv_id").alias("id"), F.lit(True).alias("long")))
    n = long_ids.count()
    columns = ("conv_id", "chapter", "kind", "turn", "tie", "role", "text", "tokens")
    plain = lambda df: df.select("conv_id", F.lit(0).cast("long").alias("chapter"), F.lit(2).alias("kind"), "turn", "tie", "role", "text", F.lit(None).cast("long").alias("tokens"))
    if n == 0:
        rows = plain(t)
    else:
        marked = t.join(F.broadcast(long_ids) if n <= FEW else long_ids, t["conv_id"].eqNullSafe(long_ids["id"]), "left")
        own = _ranged(marked.where("long"), vocabulary, range_bytes).withColumn("chapter", F.expr(f"before div {size}")).withColumn("kind", F.lit(2))
        # what may be history of the next chapter; a turn that is too long for it only ends the run
        late = own.where(F.col("before") >= (F.col("chapter") + 1) * size - history).withColumn("chapter", F.col("chapter") + 1).withColumn("kind", F.lit(1)).withColumn("text", F.when(F.col("tokens") <= history, F.col("text")).otherwise(""))
        head = own.where("before = 0 and role = 'system'").drop("chapter", "kind")
        last = own.groupBy("conv_id").agg(F.max("chapter").alias("last")).where("last > 0").withColumnRenamed("conv_id", "id")
        heads = head.join(last, head["conv_id"].eqNullSafe(last["id"])).withColumn("chapter", F.explode(F.sequence(F.lit(1).cast("long"), "last"))).withColumn("kind", F.lit(0))
        rows = plain(marked.where("long is null"))
        for part in (own, late, heads):
            rows = rows.unionByName(part.select(*columns))

    schema = _arrow(WINDOW)

    def run(batches):
        code = byte_pairs(vocabulary).encode_ordinary

        def windows():
            key, held = (), []
            for conv_id, number, kind, _, _, role, body, tokens in _rows(batches):
                if key != (conv_id, number):
                    if held:
                        yield from _chapter_windows(*key, held, budget, history)
                    key, held = (conv_id, number), []
                held.append((kind, role, body, len(code(formatted(role, body))) if tokens is None else tokens))
            if held:
                yield from _chapter_windows(*key, held, budget, history)

        yield from _batches(windows(), schema)

    return rows.repartition("conv_id", "chapter").sortWithinPartitions("conv_id", "chapter", "kind", "turn", "tie").mapInArrow(run, WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns and the text under its loss mask, as counts and digests.

    Windows are read in order, one at a time; digests are sequential, so a
    conversation is read by one task, which holds one window of it.
    """

    schema = _arrow(DIGEST)

    def run(batches):
        def digests():
            key, turns, loss, counts = (), None, None, [0, 0, 0]
            for conv_id, _, text, mask, repeated in _rows(batches, 200):
                if key != (conv_id,):
                    if key:
                        yield key[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]
                    key, turns, loss, counts = (conv_id,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, body in parsed(text)[repeated:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    counts[0] += 1
                for span in mask:
                    body = unescaped(text[span["start"] : span["stop"]])
                    loss.update(body.encode())
                    counts[1] += len(body)
                counts[2] += len(text)
            if key:
                yield key[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        yield from _batches(digests(), schema)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").select("conv_id", "window", "text", "loss", "n_repeated").mapInArrow(run, DIGEST)
