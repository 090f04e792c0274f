import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, prose, rows, table
from tidemark.llm import fingerprints, langid, licenses, line_dedup, ngram_join, packing, queries, sentencepieces, suffix_dedup, toxicity


def test_stages_follow_each_other(spark, tmp_path):
    data = [r for r in rows() if r[1] is None or len(r[1]) < 20_000]
    data = [(r[0], r[1], "en", r[3], r[4]) for r in data]
    table(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.ORACLE_SQL is None and len(queries.QUERIES) == 10


CLASHES = ("score", "rejected", "lang_pred", "fingerprint", "ids", "n_words", "labels", "kept", "n_bytes", "n_removed", "n_spans", "d", "h", "spans", "_spans", "_gone", "gone_lines", "places", "of_doc", "place", "rest", "gone_bytes", "kept_text", "_n", "_id", "_line", "base", "words", "sig", "doc", "predicted")


def clashing(spark):
    passage = prose(2, 140)
    data = [(None, "a text without an id", "en", "s", 20), (7, None, "en", "s", None), (8, "", None, "s", 0), (9, prose(9, 60), "en", "s", 1), (9, prose(9, 60), "en", "s", 1), (9, prose(10, 60), "en", "s", 1), (10, f"{prose(11, 90)} {passage}", "en", "s", 1), (11, f"{passage} {prose(12, 90)}", "en", "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES})


def test_stages_stand_clashing_names_null_ids_and_repeated_rows(spark):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
    kept = corpus_pipeline.ngram_join_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.doc_id == 9) == sorted([(9, prose(9, 60)), (9, prose(10, 60))])
    assert len(kept) == 7
    cut = {r.doc_id: r for r in corpus_pipeline.suffix_dedup_stage(spark, docs, "").collect()}
    assert prose(2, 140) not in cut[10].text and cut[10].text.startswith(prose(11, 90)) and cut[10].n_chars == len(cut[10].text) and cut[7].text is None
    assert corpus_pipeline.packing_stage(spark, docs, "").where("start = 0").count() == 8


def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), "").count() == 0


def test_operators_stand_clashing_names(spark):
    docs = clashing(spark)
    model = P.path("piece_bpe_32k.model")
    found = {
        "encode": (sentencepieces.encode(docs, model), {"ids"}),
        "decode": (sentencepieces.decode(sentencepieces.encode(docs, model), model, text="score"), {"ids", "score"}),
        "fingerprint": (fingerprints.fingerprint(docs), {"fingerprint"}),
        "predict": (langid.predict(docs, langid.train(docs, F.lit(True))), {"lang_pred", "score", "rejected"}),
        "toxicity": (toxicity.score(docs, toxicity.fit(["a b", "c d"], [0, 0])), {"score", "predicted"}),
        "licenses": (licenses.scan(docs), {"n_words", "labels", "score"}),
        "lines": (line_dedup.dedup_lines(docs, count="kept"), {"kept"}),
        "repeats": (suffix_dedup.remove_repeats(docs), {"kept", "n_bytes", "n_removed", "n_spans"}),
    }
    for name, (out, new) in found.items():
        got = out.collect()
        assert len(got) == 8 and len(set(out.columns)) == len(out.columns), name
        for r in got:
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES if c not in new), name
            assert not any(r[c] == f"{c} of {r.doc_id}" for c in new & set(CLASHES)), name
    assert ngram_join.near_duplicates(docs).count() == packing.packed(docs).where("start = 0").count() == 8


def test_stages_begin_with_small_heaps(spark, monkeypatch):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(0, 3_000_000, 1, 4).selectExpr("repeat(cast(id as string), 30) as x", "id").repartition(4).sortWithinPartitions("x").write.format("noop").mode("overwrite").save()
    before = runtime.totalMemory()
    corpus_pipeline.C.shrink_heaps(spark)
    assert runtime.totalMemory() < before
    begun = []
    monkeypatch.setattr(corpus_pipeline.C, "shrink_heaps", begun.append)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table(spark, []), "")
        assert len(begun) == i + 1
