"""The pipeline's stages by brute force, on a small corpus."""

import corpus_pipeline
from loomseek.llm import common, mixing, registry
from test_operators import DOCS, corpus, frame, linked, shingles


def test_stages_keep_what_they_should(spark, tmp_path):
    rows = corpus()
    item = " ".join(f"leak{i}" for i in range(20))
    rows += [(1000, "before " + item + " after", "en", "a", 3), (1001, "stupid idiot you are a moron", "en", "a", 3), (None, "a null id with a few words", None, None, None)]
    d = f"file://{tmp_path}"
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = common.table(spark, d, "documents")
    kept = corpus_pipeline.drop_toxic(spark, docs, d)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in rows} - {1001} and kept.columns == docs.columns
    one = corpus_pipeline.drop_near_duplicates(spark, kept, d).collect()
    groups = linked([r for r in rows if r[0] not in (1001, None)])
    assert {r["doc_id"] for r in one} == {c for _, c in groups.values()} | {None} and len(one) == len({c for _, c in groups.values()}) + 1
    clean = corpus_pipeline.drop_benchmark(spark, frame(spark, [tuple(r) for r in one]), d)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one if not shingles(item) <= shingles(r["text"])}
    mixed = corpus_pipeline.mix_sources(spark, clean, d)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.mix(clean).collect())
    out = corpus_pipeline.shard(spark, mixed, d)
    assert out.count() == mixed.count() and {r["shard"] for r in out.select("shard").distinct().collect()} <= set(range(40))
    assert corpus_pipeline.run(spark, d).count() == out.count()


def test_clean_rows_stay_beside_contaminated_rows_of_their_id(spark, tmp_path):
    d = f"file://{tmp_path}"
    item = " ".join(f"leak{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    clean = [(None, "a clean text with a null id", "en", "a", 1), (None, None, "en", "a", 2), (4, "a clean text of id four", "en", "a", 3), (4, "a clean text of id four", "en", "a", 4), (5, "alone", "en", "a", 5)]
    rows = clean + [(None, "before " + item, "en", "a", 6), (4, item + " after", "en", "a", 7), (4, item + " after", "en", "a", 8)]
    frame(spark, rows).repartition(3).write.parquet(f"{d}/documents.parquet")
    for docs in (common.table(spark, d, "documents"), frame(spark, rows)):
        kept = corpus_pipeline.drop_benchmark(spark, docs, d)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)


def test_stages_of_an_empty_table(spark, tmp_path):
    d = f"file://{tmp_path}"
    frame(spark, []).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_every_query_is_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[10] == "pipeline"
    assert set(registry.oracle_sql()) <= set(names) and DOCS
