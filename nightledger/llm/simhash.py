"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance.

A fingerprint's 64 bits are split into ``distance`` + 2 blocks; two fingerprints
that differ in at most ``distance`` bits agree in at least two blocks, so each
pair of blocks is a key. Equal fingerprints are one class first. Keys shared by a
few classes are joined and the pairs verified. Keys that many classes share
(a large group of near copies) would give a square of pairs; there every class
lists the points one bit flip (or none) away, and classes at a distance of two or
less are exactly those that list a common point, so a minimum over each point
links them with no pair enumerated. Nothing is capped or dropped.

Defined results: null or blank text has fingerprint 0 and links like any other;
a null ``doc_id`` keeps its fingerprint and counts as no smallest id; repeated
rows are one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, SEED, U64, giving_back, join_labels, raw_texts, saved, without
from .components import components


def simhash(words: list[bytes], size: int) -> int:
    """The fingerprint of a word list's shingles (repeats included)."""
    n = max(1, len(words) - size + 1)
    if not words:
        return 0
    if len(words) <= size:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit integer."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounded whatever the text's length
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of every text's lower-cased word shingles."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [simhash(t.lower().split(), size) for t in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp, lo: int, width: int):
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))


def close_pairs(classes: DataFrame, distance: int = 2, most: int = 64) -> DataFrame:
    """Links (a, b) that connect all ``fp`` of ``classes`` (distinct) within ``distance`` bits.

    Keys of at most ``most`` classes are joined and every link verified. For a
    distance of two, larger keys go by shared one-flip points; for other
    distances they raise an error.
    """
    n = distance + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [_bits(F.col("fp"), a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [F.xxhash64(F.lit(i), blocks[x], blocks[y]) for i, (x, y) in enumerate(combinations(range(n), 2))]
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key")
    small, large = keyed.where(F.col("n") <= most), keyed.where(F.col("n") > most)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, (left["key"] == right["key"]) & (left["a"] < right["b"]) & near).select("a", "b")
    return pairs.unionByName(_crowded(large, distance)).distinct()


def _crowded(keyed: DataFrame, distance: int) -> DataFrame:
    """Links among the classes of crowded keys, through the points within one flip of each.

    Fingerprints at distance 1 or 2 have a common point that is at most one flip
    from both, and any two that list a point are at a distance of at most 2.
    """
    if distance != 2:
        raise ValueError("crowded keys are resolved for a distance of 2")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    points = keyed.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("point", "a")
    return points.join(least, "point").where("fp > a").select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most ``distance`` bits.

    The checkpointed fingerprints are read several times, the texts once.
    """
    return linked(saved(fingerprints(docs, size)), distance)


def linked(prints: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id of given fingerprints (doc_id, fp)."""
    classes = prints.select("fp").distinct()
    found = components(close_pairs(classes, distance))
    counted = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    rooted = counted.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    roots = join_labels(rooted.withColumnRenamed("n", "rows"), least, "root", classes.count()).select("fp", F.col("rows").alias("n"), "component_id")
    return join_labels(prints, roots, "fp", prints.count()).select("doc_id", "fp", "component_id")


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The sorted distinct hashes of a word list's shingles; a list of at most ``size`` words is one shingle."""
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], U64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), U64, len(words) - size + 1))


def _hash_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hashes): the distinct shingle hashes of every text."""

    @giving_back
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_hashes(t.lower().split(), size).view("<i8") for t in raw_texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "hashes"])

    return docs.mapInArrow(run, "doc_id long, hashes array<long>")


def _frequent(docs: DataFrame, size: int, share: int = 16, at_most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, sorted, that several documents have, with how many of every ``share`` have them.

    Only the order of the prefixes follows from this; any order gives the same result.
    """
    some = _hash_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), size)
    counts = some.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "hash").limit(at_most).toArrow()
    hashes, n = top.column("hash").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


#: Ranges of a sketch, and from how many filled ranges on it may rule a pair out.
RANGES, ENOUGH = 128, 96


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of ``RANGES`` equal ranges of hashes: of the least hash there, 0 where there is none."""
    edges = np.searchsorted(hashes, np.arange(RANGES, dtype=U64) << U64(57))
    filled = edges < np.append(edges[1:], len(hashes))
    out = np.zeros(RANGES, np.uint8)
    out[filled] = (hashes[edges[filled]] & U64(127)).astype(np.uint8) | 128
    return out.tobytes()


def _prefixes(docs: DataFrame, size: int, part: Fraction, frequent) -> DataFrame:
    """(doc_id, class, size, fp, sketch, prefix): a digest of the shingle set, its size, fingerprint, and its first hashes, rarest first.

    Two sets of a Jaccard similarity of at least ``part`` have a common hash in their prefixes.
    """

    @giving_back
    def run(batches):
        import pyarrow as pa

        known, counts = frequent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                digests, sizes, fps, sketches, prefixes = [], [], [], [], []
                for text in raw_texts(batch):
                    hashes = shingle_hashes(text.lower().split(), size)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    fps.append(majority(hashes))
                    sketches.append(sketch(hashes))
                    if len(known):
                        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
                    prefixes.append(hashes[: len(hashes) - -(-len(hashes) * part.numerator // part.denominator) + 1].view("<i8"))
                arrays = [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "class", "size", "fp", "sketch", "prefix"])

    return docs.mapInArrow(run, "doc_id long, class binary, size int, fp long, sketch binary, prefix array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, part: Fraction) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out.

    Equal bytes in the filled ranges estimate the similarity; with ``ENOUGH``
    ranges, a pair whose estimate is 0.3 below ``part`` is over seven standard
    deviations away from it. Pairs with fewer filled ranges all stay.
    """
    least = float(part) - 0.3

    @giving_back
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("x", "y"))
            filled, equal = ((x | y) > 0).sum(axis=1), ((x == y) & (x > 0)).sum(axis=1)
            keep = pa.array((filled < ENOUGH) | (equal >= least * filled))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = (classes.select(F.col("rep").alias(end), F.col("sketch").alias(s)) for end, s in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, size: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose distinct shingles have a Jaccard similarity of at least ``share``, on whole texts."""

    @giving_back
    def run(batches):
        import pyarrow as pa

        known = {}  # the last few sets: pairs of one text follow one another
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, keep = batch.slice(lo, 256), []
                for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), raw_texts(part, "x"), raw_texts(part, "y"), strict=True):
                    sets = []
                    for end, text in ((a, x), (b, y)):
                        held = known.get(end)
                        if held is None or held[0] != text:
                            if len(known) >= 16:
                                known.clear()
                            held = known[end] = text, shingle_hashes(text.lower().split(), size)
                        sets.append(held[1])
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    keep.append(both * (share.numerator + share.denominator) >= sum(map(len, sets)) * share.numerator)
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids  # few: only their texts are exchanged
    texts = docs.join(ids, "doc_id", "left_semi").repartition("doc_id").dropDuplicates()
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, most: int = 8, hubs: int = 2) -> DataFrame:
    """(doc_id, component_id) over all links of a Jaccard similarity of at least ``similarity``.

    Texts are compared by the hashes of their distinct word shingles, exactly,
    and copies are one class first. SimHash fingerprints of the sets, joined by
    pigeonhole blocks and verified by Hamming distance, group the nearest copies;
    each is verified against the first of its group on the whole sets. Pairs near
    the threshold differ in more bits than any blocks could bear, so the rest is
    found exactly: candidates between the components so far come from a prefix
    filter and each is verified likewise. A hash in the prefixes of at most
    ``most`` classes joins all of them. Where more share one, they are compared
    with ``hubs`` members first, which makes one component of a group of near
    copies; then all pairs of a key that are in different components still are
    compared, so no link that matters is left out and a group gives no square of
    pairs. Shares of sizes and positions in the prefix rule pairs out beforehand.
    """
    part = Fraction(similarity).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = saved(_prefixes(docs, size, part, docs.sparkSession.sparkContext.broadcast(_frequent(docs, size))))
    everything = prints.count()
    classes = prints.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("prefix").alias("prefix")).where("rep is not null")
    alike = linked(saved(classes.select(F.col("rep").alias("doc_id"), "fp"))).where("doc_id <> component_id")
    first = saved(_verified(saved(alike.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))), docs, size, part))
    grouped = first.select(F.col("b").alias("rep"), F.col("a").alias("group"))
    grouped = F.broadcast(grouped) if first.count() <= FEW else grouped
    # one exchange of the keys; a window holds a key's rows spillably, and the crowded keys are joined by hot ones below
    keyed = classes.select("rep", "size", F.posexplode("prefix").alias("at", "key")).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    keyed = saved(keyed.where("n > 1").join(grouped, "rep", "left").withColumn("group", F.coalesce("group", "rep")))
    small, large = keyed.where(F.col("n") <= most), keyed.where(F.col("n") > most)

    def sides(x, y):
        return tuple(d.select(*(F.col(c).alias(c if c in ("key", "salt") else c + end) for c in d.columns)) for d, end in ((x, "_a"), (y, "_b")))

    def may_be():
        # no more is in common than this hash and what follows it in the shorter rest, at the first common hash
        rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
        return rest * (part.numerator + part.denominator) >= (F.col("size_a") + F.col("size_b")) * part.numerator

    ends = [F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")]
    left, right = sides(small, small)
    pairs = left.join(right, "key").where((F.col("rep_a") < F.col("rep_b")) & (F.col("group_a") != F.col("group_b")) & may_be()).select(*ends)
    crowd = large.count()
    hub = large.groupBy("key", F.pmod(F.xxhash64("rep"), F.lit(hubs)).alias("of")).agg(F.min(F.struct("rep", "size", "at", "group")).alias("hub"), F.count("*").alias("n"))
    chosen = hub.groupBy("key").agg(F.collect_list("hub").alias("hubs"), F.sum("n").alias("n"))  # at most ``hubs`` of them
    starred = join_labels(large.select("key", F.col("rep").alias("rep_b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"), F.col("group").alias("group_b")), chosen, "key", crowd)
    starred = starred.select("*", F.explode("hubs").alias("h")).select(F.col("h.rep").alias("rep_a"), F.col("h.size").alias("size_a"), F.col("h.at").alias("at_a"), F.col("h.group").alias("group_a"), "rep_b", "size_b", "at_b", "group_b")
    starred = starred.where((F.col("group_a") != F.col("group_b")) & may_be()).select(*ends)
    verified = _verified(saved(_likely(pairs.unionByName(starred).distinct(), classes, part)), docs, size, part)
    found = components(verified.unionByName(first))

    # what is left of the crowded keys: pairs across components, the larger keys dealt over several tasks
    held = large.drop("group").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n", "lo")
    held = saved(join_labels(held, apart, "key", crowd).drop("lo"))
    salts = F.ceil(F.col("n") / 512).cast("int")
    left, right = sides(held.withColumn("salt", F.pmod(F.hash("rep"), salts)), held.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))))
    across = left.join(right, ["key", "salt"]).where((F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b")) & may_be()).select(*ends).distinct()
    across = saved(_likely(across, classes, part))
    if not across.isEmpty():
        found = components(_verified(across, docs, size, part).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    reps = prints.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("rep is not null")
    reps = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("class", "n", F.coalesce("component", "rep").alias("component_id"))
    return join_labels(prints.select("doc_id", "class"), reps, "class", everything).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents that stay: of every component the one with the smallest doc_id, and rows without a doc_id.

    Rows that share a doc_id are one document and stay or go together.
    """
    return without(docs, similar_documents(docs, size, similarity).where("doc_id <> component_id").select("doc_id"))
