"""The pipeline's near-duplicate stage against all pairs by Jaccard similarity."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest

from tallyspark.llm import exact_dedup, simhash
from tests.llm.brute import similar_roots as roots_of


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(3)
    texts = {}
    for k in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts[k * 10] = " ".join(words)
        for c in range(1, 8):
            new = list(words)
            for at in rng.choice(300, c if k % 2 else 3, replace=False):
                new[at] = f"x{rng.integers(0, 10**6)}"
            texts[k * 10 + c] = " ".join(new)
    return texts | {900: "a few words", 901: "A  few words", 902: "", 903: None, 904: "a few other words"}


def test_stage_drops_what_is_similar(spark, planted):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in planted.items()], "doc_id long, text string, lang string, source string, n_chars long")
    roots = roots_of(planted)
    assert len(set(roots.values())) < len(roots) / 3
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == roots
    assert simhash.similar_documents(docs.limit(0)).count() == 0


def test_similarity_is_a_parameter(spark, planted):
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    for similarity in (0.6,):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, similarity=similarity).collect()} == roots_of(planted, similarity)


def test_anchors_over_many_exact_bits(spark, planted, monkeypatch):
    """More exact bits and tables, as for many texts, and anchors split over salts find the same links."""
    monkeypatch.setattr(simhash, "MEAN_HOMES", 0.01)
    monkeypatch.setattr(simhash, "SPLIT_HOMES", 2)
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    assert simhash.Cover.of(0.8, len(planted)).exact_bits > 0
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == roots_of(planted)


def test_components_that_the_check_breaks_up(spark):
    """A chain of texts, each similar to the next but not to the one after, and texts just below the similarity of its links."""
    words = [f"w{k}" for k in range(400)]
    chain = {k: " ".join(words[8 * k : 8 * k + 160]) for k in range(12)}
    near = {100 + k: " ".join([f"a{k}{x}" if x % 30 == 7 else w for x, w in enumerate(words[:160])]) for k in range(6)}
    docs = spark.createDataFrame(list((chain | near).items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == roots_of(chain | near)


def test_pairs_of_a_large_group_grow_with_its_size(spark):
    """Many tasks that each see a part of one large group don't each hand over a forest of it."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(60)], {}
    for k in range(600):
        new = list(base)
        for at in rng.choice(60, 1 + k % 3, replace=False):
            new[at] = f"x{rng.integers(0, 10**6)}"
        texts[k] = " ".join(new)
    cover = simhash.Cover.of(0.8, len(texts))
    sets = [(k, simhash.shingle_set(t.encode(), 5)) for k, t in texts.items()]
    nodes = spark.createDataFrame([(k, len(s), bytearray(simhash.long_fingerprint(s, cover.lanes).tobytes())) for k, s in sets], "node long, size int, print binary")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pairs = simhash.candidates(nodes, cover, 0.8).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(pairs) == len({tuple(p) for p in pairs}) < 4 * len(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == roots_of(texts)


def test_stages_decide_by_row(spark):
    rows = [(None, "the same text of seven words here", "a"), (None, "the same text of seven words here", "b"), (7, "one two three four five six", "a"), (7, "one two three four five six", "a"), (7, "quite another text of some words", "a"), (8, "", "a"), (9, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Row_Number_ string")
    for stage, last in ((simhash.drop_near_duplicates, 8), (exact_dedup.drop_exact_duplicates, 9)):
        kept = stage(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert sorted((r["text"] or "") for r in rows) == ["", "one two three four five six", "quite another text of some words", "the same text of seven words here"]
        assert [r["doc_id"] for r in rows if not r["text"]] == [last] and sum(r["doc_id"] is None for r in rows) == 1
        assert stage(docs.limit(0)).count() == 0
