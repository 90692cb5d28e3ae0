import hashlib

import corpus_pipeline
from loomspan.llm import bpe
from loomspan.llm.common import Scratch
from loomspan.llm.ngram_join import ngram_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark, sf):
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "t")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS, name
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
        sizes.append(docs.count())
        if name == "ngram_jaccard_join":
            assert ngram_components(docs, scratch).where("doc_id <> component_id").count() == 0
    assert sizes[0] > sizes[1] > sizes[3]
    own = bpe.codec(*bpe.default_vocabulary())
    text = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.tokens(spark, docs, sf).collect()
    assert len(out) == docs.count()
    assert all(r.ids_sha256 == hashlib.sha256(own.encode(text[r.doc_id])).hexdigest() and len(r.ids) == r.n_tokens for r in out)


def test_odd_rows_pass_all_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, "Some text without an id.", None, "s", 5)], docs.schema)
    for table in ("documents", "labels"):
        (docs.union(odd) if table == "documents" else spark.read.parquet(f"{sf}/labels.parquet")).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and "ids" in rows[0].asDict()


def test_empty_documents(spark, sf, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
