import corpus_pipeline
from paperloom.llm import exact_dedup, mixing, ngram_join

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, given = docs.columns, docs.count()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "best-fit packing"]
    good = stages["quality classifier"](spark, docs, FOLDER).cache()
    bad = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0").collect()}
    assert good.columns == names and good.count() < given and len(bad & {r["doc_id"] for r in good.collect()}) <= len(bad) // 3
    single = stages["exact dedup"](spark, good, FOLDER).cache()
    assert single.count() == good.select("text").distinct().count() and exact_dedup.exact_groups(single).filter("group_size > 1").isEmpty()
    apart = stages["n-gram Jaccard join"](spark, single, FOLDER).cache()
    assert ngram_join.linked(apart, 5, 80, 100).filter("component_id <> doc_id").isEmpty()
    mixed = stages["mixing sources"](spark, apart, FOLDER).cache()
    assert mixed.columns == names and mixed.count() == sum(r["copies"] for r in mixing.drawn(apart).collect())
    packed = stages["best-fit packing"](spark, mixed, FOLDER).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert (packed["piece"] == 0).sum() == mixed.count()


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
