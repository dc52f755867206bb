"""The pipeline stage by stage on the smallest table, against brute force."""

import shutil

import numpy as np
import pytest

import corpus_pipeline
from nightledger.llm import decontam, queries
from nightledger.llm.common import table

from .test_operators import brute_spans


def shingles(text):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(5)))) if len(w) > 5 else {tuple(w)}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """{name: rows by doc_id} of what each stage leaves, and the packed pieces."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf_dir, "documents"), {}
    columns = docs.columns
    out["input"] = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        if name != "packing":
            assert docs.columns == columns
            out[name] = {r["doc_id"]: r for r in docs.collect()}
        else:
            out[name] = docs.collect()
    return out


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_language_keeps_clean_documents(stages):
    kept = stages["language"]
    assert len(kept) >= 0.99 * len(stages["input"])
    assert np.mean([r["lang"] == stages["input"][d]["lang"] for d, r in kept.items()]) > 0.9


def test_one_of_each_group_stays(stages):
    before, kept = stages["language"], stages["near_duplicates"]
    sets = {d: shingles(r["text"]) for d, r in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(before)
    for d in set(before) - set(kept):
        assert max(alike(d, x) for x in ids if x != d) > 0.7
    left = sorted(kept)
    assert not [(a, b) for i, a in enumerate(left) for b in left[i + 1 :] if alike(a, b) > 0.9]


def test_leaks_go_and_nothing_else(spark, sf_dir, stages):
    before, kept = stages["near_duplicates"], stages["decontamination"]
    items = [b" ".join(decontam.plain_words(r["text"].encode())) for r in table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, r in before.items() if any(b" " + i + b" " in b" " + b" ".join(decontam.plain_words((r["text"] or "").encode())) + b" " for i in items)}
    assert leaked and leaked == set(before) - set(kept)


def test_secrets_are_gone(stages):
    before, kept = stages["decontamination"], stages["secrets"]
    assert set(before) == set(kept)
    for d, r in kept.items():
        assert not brute_spans(r["text"] or "") and r["n_chars"] == len(r["text"])
        if not brute_spans(before[d]["text"]) and "entropy" not in r["text"]:
            assert r["text"] == before[d]["text"]


def test_every_token_is_packed_once(stages):
    from tokenizers import Tokenizer

    coder, by = Tokenizer.from_file(queries.vocabulary()), {}
    for p in sorted(stages["packing"], key=lambda p: p["start"]):
        by[p["doc_id"]] = by.get(p["doc_id"], b"") + p["ids"]
    assert set(by) == set(stages["secrets"])
    for d, ids in by.items():
        assert np.frombuffer(ids, "<u4").tolist() == [*coder.encode(stages["secrets"][d]["text"], add_special_tokens=False).ids, 2]


def test_stages_bound_their_batches(spark, sf_dir):
    """A stage's Arrow batches are bounded by bytes, whatever the texts' length."""
    corpus_pipeline.pack(spark, table(spark, sf_dir, "documents"), sf_dir)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('some text ', 2000) text")
    assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) < 2 * corpus_pipeline.BATCH_BYTES


def test_packing_forgets_its_vocabulary(spark, sf_dir, tmp_path):
    """Workers keep no coder of a task that is to forget it, and its rows are those of one that does not."""
    from nightledger.llm import packing

    shutil.copy(queries.vocabulary(), path := str(tmp_path / "words.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(4)

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([path in packing.CODERS] * batch.num_rows)], names=["held"])

    got = packing.pack_documents(docs, path, forget=True).collect()
    assert not docs.mapInArrow(held, "held boolean").where("held").count()
    assert sorted(got) == sorted(packing.pack_documents(docs, path).collect())
