"""The pipeline, stage by stage and as a whole."""

import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, odd_documents
from tests.llm.test_documents import base_spans, smallest_of_copies
from tidemark.llm import packing, ppm_language


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(odd_documents(), SCHEMA).drop("fp", "key", "text_sha256").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_dedup", "personal_data", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)

    docs = stages["language_id"](spark, docs, folder)
    kept = [(i, t) for i, t in texts if t and any(c.isalpha() for c in t)]
    assert docs.columns == columns and sorted(map(str, docs.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in kept)

    docs = stages["exact_dedup"](spark, docs, folder).cache()
    largest = {}
    for i, t in kept:
        largest[t] = max((x for x in (i, largest.get(t)) if x is not None), default=None)
    assert docs.columns == columns and sorted((r["text"], str(r["doc_id"])) for r in docs.collect()) == sorted((t, str(i)) for t, i in largest.items())

    docs = stages["simhash_dedup"](spark, docs, folder).cache()
    want = smallest_of_copies([(i, t) for t, i in largest.items()])
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == want

    masked = stages["personal_data"](spark, docs, folder)
    assert masked.columns == columns and masked.count() == docs.count()
    assert not any(base_spans(r["text"]) for r in masked.collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert packing.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 1


def test_language_stage_uses_its_prediction(spark):
    """The predicted language replaces the column, and unwanted languages and doubtful texts go though they have letters."""
    rows = [(k, "the cat and the other thing with this " * 3, "en") for k in range(30)] + [(100 + k, "der und die nicht ein sich auf mit " * 3, "de") for k in range(30)]
    rows += [(900, "the other cat with that", None), (901, "nicht mit der und die", "en"), (902, "12 3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = {r["doc_id"]: r["lang"] for r in ppm_language.keep_identified(docs).collect()}
    assert named[900] == "en" and named[901] == "de" and 902 not in named and len(named) == 62
    assert {r["lang"] for r in ppm_language.keep_identified(docs, ["de"]).collect()} == {"de"}
    assert ppm_language.keep_identified(docs, least=1.5).count() == 0
