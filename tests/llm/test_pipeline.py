import corpus_pipeline
from vouchlake.llm import quality, toxicity
from vouchlake.llm.neardup import near_duplicates
from vouchlake.llm.tokens import ByteBpe, vocabulary_bytes


def test_run_equals_the_stages_by_hand(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    good = quality.fit(docs, labels)
    rows = [r for r in docs.collect() if good.scores([r.text])[0] >= 0.7]
    left = spark.createDataFrame(rows, docs.schema)
    tox = toxicity.fit(left, labels)
    rows = [r for r in rows if tox.scores([r.text])[0] < 0.5]
    left = spark.createDataFrame(rows, docs.schema)
    stays = {r.doc_id for r in near_duplicates(left, 5).where("kept").collect()}
    bpe = ByteBpe(vocabulary_bytes())
    assert len(rows) > 0.4 * docs.count()  # also on 200 documents, most are kept
    expected = {r.doc_id: len(bpe.encode(r.text)) + 1 for r in rows if r.doc_id in stays}
    got = corpus_pipeline.run(spark, sf_small).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == expected
    assert sum(r.length for r in got) == sum(expected.values())


def test_final_rows_hold_the_token_ids(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    bpe, found = ByteBpe(vocabulary_bytes()), {}
    for r in corpus_pipeline.run(spark, sf_small).orderBy("doc_id", "start").collect():
        found[r.doc_id] = found.get(r.doc_id, b"") + r.ids
    assert found and all(x == b"".join(int(i).to_bytes(4, "little") for i in [*bpe.encode(texts[k]), 0]) for k, x in found.items())


def test_stages_take_odd_rows(spark, sf_small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_small)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() >= (docs.count() > 0)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "packing"]


def test_near_dedup_is_a_small_plan(spark, sf_small):
    """What the stage writes nests no joins of its steps; such plans filled the driver's memory."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_small)
    assert len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 100
