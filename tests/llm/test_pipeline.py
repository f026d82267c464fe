import random

import corpus_pipeline
from simloom.llm import decontaminate, exact_dedup, near_dedup, toxicity
from simloom.llm.queries import ORACLES, QUERIES


def words(rnd, n):
    return [rnd.choice(["apple", "river", "stone", "cloud", "paper", "green"]) + str(rnd.randrange(50)) for _ in range(n)]


def test_stages_take_effect(spark, tmp_path):
    """Planted cases against what each stage must do, worked out by hand."""
    rnd = random.Random(8)
    texts = {k: " ".join(words(rnd, 60)) for k in range(1, 401)}
    toxic = {k for k in texts if k % 4 == 0}
    for k in toxic:
        texts[k] = f"vile {texts[k]} rotten"
    item = " ".join(words(rnd, 20))
    texts[1001] = texts[1].upper()
    texts[1002] = texts[2] + " tail"
    texts[1003] = f"{' '.join(words(rnd, 40))} {item} {' '.join(words(rnd, 40))}"
    texts[1004] = ""
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in texts], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == set(texts) - toxic - {1, 1002, 1003}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_handle_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None, None), (1, None, "en", None, 0, True), (2, "x y", None, "s", 3, None), (2, "x y", None, "s", 3, None), (3, "w " * 40_000, "en", "s", 1, False)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.exact_copies(spark, spark.createDataFrame(odd, schema), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert all((decontaminate, exact_dedup, near_dedup, toxicity))
