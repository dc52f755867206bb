"""Decontamination with test items longer than a passage, and with more items than a shard holds."""

import random

import numpy as np
import pytest

from nightledger.llm import decontam


def fresh(rnd, n):
    return " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))


def found(spark, docs, items, **options):
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.matches(docs, items, **options).collect()}


@pytest.mark.parametrize("length", [60, 65, 128, 250, 1000])
def test_a_verbatim_item_is_found_at_any_length_and_place(spark, length):
    rnd = random.Random(length)
    items = [(i, f"{fresh(rnd, length - 20)}. {fresh(rnd, 20)}") for i in range(6)] + [(9, fresh(rnd, 30))]
    docs = [(i, f"{fresh(rnd, rnd.randrange(200))} {items[i][1]} {fresh(rnd, 100)}") for i in range(4)] + [(7, fresh(rnd, 2000))]
    # a piece alone is retrieved, and the whole item is not verified
    docs.append((8, " ".join(items[5][1].split()[: length // 3])))
    assert set(found(spark, docs, items)) == {(i, i) for i in range(4)}


def test_scores_do_not_change_with_the_shards(spark):
    rnd = random.Random(1)
    words = [f"c{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words) if rnd.random() < 0.5 else f"r{rnd.randrange(10**6)}" for _ in range(rnd.randrange(10, 90)))) for i in range(40)]
    docs = [(i, " ".join(w for w in t.split() if rnd.random() < 0.95)) for i, t in items]
    whole = found(spark, docs, items, overlap=0.2)
    assert len(whole) >= 20
    assert found(spark, docs, items, overlap=0.2, shard_items=7) == pytest.approx(whole, abs=1e-9)


def test_rows_that_share_a_doc_id_keep_their_own_words(spark):
    """Words go from the row whose window stands in a smaller document, not from others of its doc_id."""
    from nightledger.llm import substrings

    text = lambda name, n=120: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, text("a")), (2, f"{text('a')} x {text('a')}"), (2, text("b")), (3, text("b")), (None, text("c")), (None, text("d")), (4, f"{text('d')} {text('e')}"), (2, text("b"))]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 1, 120, 0), (False, 2, 120, 0), (False, 2, 120, 0), (False, 2, 241, 240), (False, 3, 120, 120), (False, 4, 240, 120), (True, 0, 120, 0), (True, 0, 120, 0)]


def test_languages_are_learned_whatever_the_ids(spark):
    """Null or shared doc_ids, and one row that is repeated, neither empty nor swell the sample."""
    from pyspark.sql import functions as F

    from nightledger.llm import language

    words = {"en": "the cat and the other thing with which they have been", "fr": "le chat et la chose que nous avons dans une maison", "de": "die katze und das haus mit dem wir nicht gehen"}
    texts = [(lang, f"{w} {i} {w[i % 20 :]}") for lang, w in words.items() for i in range(300)]
    for ids in ([None] * 900, [7] * 900):
        docs = spark.createDataFrame([(d, lang, t) for d, (lang, t) in zip(ids, texts, strict=True)], "doc_id long, lang string, text string")
        docs = docs.unionByName(docs.where("lang = 'fr'").limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2000)))).drop("n"))
        model = language.fit(docs, F.lit(True), sample=50)
        assert len(model.pairs) == 2
        found = language.predict(docs, model).where("lang = lang_pred").count()
        assert found > 0.98 * 2900
    assert language.Model(["en", "fr"], {}).predict(np.zeros(language.SIZE)) == ("en", 0.5)  # a pair without a fit is a tie
