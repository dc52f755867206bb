"""Secret scans with DataFrame functions only: fixed patterns and sliding-window entropy.

Spans come from two array functions: ``regexp_extract_all`` gives the matches
from left to right and ``split`` the text between them, so a running sum of
lengths gives every match's code points. Candidate strings (20 or more letters,
digits or +/_-, one digit at least) are walked once per character class: the
counts of the characters in a window are kept in an array, one is raised and one
lowered at each step, and the sum of c * log2(c) changes by those two terms only,
which gives the window's Shannon entropy. A candidate's span reaches from its
first to its last window over the class's threshold. Candidates that match the
allow-list, and those that lie within the span of a pattern, add nothing; one that
reaches beyond a pattern's span adds its own, which may overlap it.

Defined results: null or empty text has no spans; long texts are scanned whole;
repeated rows are scanned each; an empty table gives no rows. ``redacted`` keeps
all columns and rows; its own columns begin with "__" and are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns by kind, in order, and the least length of each match (assign: of its second group).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # 20 characters or more; a shorter match holds no longer one
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Character classes, first match wins: name, pattern, bits of entropy that a window of WINDOW characters must reach.
CLASSES = (("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0), ("upper", r"^[A-Z0-9]+$", 3.5), ("base64", r".", 3.75))
WINDOW = 20
#: Texts with more matches of a pattern are gone through in runs of so many.
CHUNK = 256
#: Counts of characters up to WINDOW are kept in fields of so many bits, and so many fields are kept in a long.
FIELD, FIELDS = 5, 12
#: Texts that look random and are not secret.
ALLOWED = r"(?i)example|sample|dummy|placeholder|^[0-9_/+-]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|0123456789|abcdefghij"
KINDS = ("assign", "access", "hex", "entropy")


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _pairs(text: Column, hits: Column, pattern: str) -> Column:
    """array<struct<gap, hit>>: the matches ``hits`` of ``pattern`` in ``text``, each with the text before it."""
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    return F.when(F.size(hits) > 0, F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))


def _located(pairs: Column, kind: int) -> Column:
    """array<struct<hit, span>> of the matches in ``pairs``, a column, so that it is made once and not at every step."""
    kind_of = "array<struct<hit:string,span:struct<start:int,kind:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("found"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.array(F.struct(x["hit"].alias("hit"), _span(begin, kind, end).alias("span")))
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))

    few = F.aggregate(pairs, start, step, lambda acc: acc["found"])

    # many matches: located within runs of CHUNK first, which keeps the folded arrays short, and then moved by the run's start
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda b: F.aggregate(F.slice(pairs, b * CHUNK + 1, F.lit(CHUNK)), start, step))
    ends = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + run["at"])))
    moved = lambda x, by: F.struct(x["hit"].alias("hit"), _span(x["span"]["start"] + by, kind, x["span"]["end"] + by).alias("span"))
    many = F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(ends, F.lit(1), F.size(runs)).alias("by")), lambda z: F.transform(z["run"]["found"], lambda x: moved(x, z["by"]))))
    return F.when(F.size(pairs) > CHUNK, many).when(F.size(pairs) > 0, few).otherwise(F.array().cast(kind_of))


def _entropy_range(s: Column, threshold: Column) -> Column:
    """struct<lo, hi>: from the first to the last window over the threshold, 0-based; hi is -1 if there is none.

    The fold runs over (character that enters, character that leaves), so a step
    looks at its element alone. The counts are fields of FIELD bits in longs.
    """
    units = F.array(*[F.lit(1 << (FIELD * i)).cast("long") for i in range(FIELDS)])
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])

    def place(ch):
        code = F.instr(F.lit(ALPHABET), ch) - 1
        return F.struct((code / FIELDS).cast("int").alias("word"), F.get(units, code % FIELDS).alias("unit"))

    nothing = F.struct(F.lit(-1).alias("word"), F.lit(0).cast("long").alias("unit"))
    codes = F.transform(F.split(s, "", F.length(s)), place)
    steps = F.arrays_zip(codes.alias("new"), F.slice(F.concat(F.array_repeat(nothing, WINDOW), codes), F.lit(1), F.length(s)).alias("old"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // FIELDS)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"),
        (F.lit(WINDOW).cast("double") * (F.lit(math.log2(WINDOW)) - threshold) + 1e-9).alias("most"),
    )

    def step(acc, x):
        new, old, i = x["new"], x["old"], acc["i"]
        count = lambda c: (F.call_function("div", F.get(acc["n"], c["word"]), c["unit"]) % (1 << FIELD)).cast("int")
        term = lambda c: F.get(terms, c)
        lowered = F.when(old["unit"] > 0, term(count(old) - 1) - term(count(old))).otherwise(0.0)
        total = acc["sum"] + F.when(new == old, 0.0).otherwise(term(count(new) + 1) - term(count(new)) + lowered)
        n = F.transform(acc["n"], lambda c, k: c + F.when(k == new["word"], new["unit"]).otherwise(0) - F.when(k == old["word"], old["unit"]).otherwise(0))
        over = (i >= WINDOW - 1) & (total <= acc["most"])
        return F.struct(
            n.alias("n"), total.alias("sum"), (i + 1).alias("i"),
            F.when(over & (acc["lo"] < 0), i - WINDOW + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(over, i + 1).otherwise(acc["hi"]).alias("hi"), acc["most"].alias("most"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _within(span: Column, spans: Column) -> Column:
    """Whether ``span`` lies within one of ``spans``, which are sorted and do not overlap: a binary search for the last that starts no later."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))  # spans before lo start no later, those from hi on later

    def step(acc, _):
        middle = F.call_function("div", acc["lo"] + acc["hi"], F.lit(2)).cast("int")
        earlier = F.get(spans, middle)["start"] <= span["start"]
        going = acc["lo"] < acc["hi"]
        return F.struct(F.when(going & earlier, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(going & ~earlier, middle).otherwise(acc["hi"]).alias("hi"))

    halvings = F.sequence(F.lit(0), F.floor(F.log2(F.size(spans))).cast("int"))
    last = F.aggregate(halvings, start, step, lambda acc: F.get(spans, acc["lo"] - 1)["end"])
    return F.when(F.size(spans) > 0, F.coalesce(last >= span["end"], F.lit(False))).otherwise(False)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with __base and __all: arrays of spans (start, kind, end), sorted; kind is an index of KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("__text", text)
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("entropy", CANDIDATE)):
        out = out.withColumn(f"__{name}", F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)))
        if name == "entropy":  # candidates only where one has a digit
            out = out.withColumn("__entropy", F.when(F.exists("__entropy", lambda s: s.rlike("[0-9]")), F.col("__entropy")).otherwise(F.array().cast("array<string>")))
        out = out.withColumn(f"__{name}", _pairs(F.col("__text"), F.col(f"__{name}"), pattern))
    for kind, name in enumerate(KINDS[:3]):
        found = _located(F.col(f"__{name}"), kind)
        if name == "assign":
            found = F.filter(found, lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6)
        out = out.withColumn(f"__{name}", F.transform(found, lambda x: x["span"]))
    out = out.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))

    def secret(x):
        s = x["hit"]
        threshold = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            threshold = F.when(s.rlike(pattern), F.lit(bits)).otherwise(threshold)
        r = _entropy_range(s, threshold)
        return F.struct(x["span"]["start"].alias("at"), r.alias("r"))

    found = F.filter(_located(F.col("__entropy"), 3), lambda x: x["hit"].rlike("[0-9]") & ~x["hit"].rlike(ALLOWED))
    new = lambda spans, of: F.filter(spans, lambda x: ~(_within(of(x), F.col("__assign")) | _within(of(x), F.col("__access")) | _within(of(x), F.col("__hex"))))
    out = out.withColumn("__entropy", F.transform(new(found, lambda x: x["span"]), secret))
    added = F.transform(F.filter("__entropy", lambda x: x["r"]["hi"] > 0), lambda x: _span(x["at"] + x["r"]["lo"], 3, x["at"] + x["r"]["hi"]))
    added = new(added, lambda x: x)
    return out.withColumn("__all", F.when(F.size("__entropy") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base")))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in text replaced by [kind], and n_chars, if there, counted anew."""
    columns = docs.columns
    kind = lambda x: F.concat(F.lit("["), F.get(F.array(*map(F.lit, KINDS)), x["kind"]), F.lit("]"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        gap = F.substring(F.col("__text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        parts = F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, kind(x)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), parts.alias("parts"))

    found = with_spans(docs)
    whole = F.aggregate("__all", start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("__text"), acc["at"] + 1, F.length("__text"))))
    out = found.withColumn("text", F.when(F.size("__all") > 0, whole).otherwise(F.col("text")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("__all") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in columns])
