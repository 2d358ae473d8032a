"""The pipeline's stages one after another, on planted documents."""

import corpus_pipeline
from loomgraph.llm import decontaminate, near_dedup, sentencepiece


def test_pipeline(spark, tmp_path):
    text = lambda i, n=60: "\n".join(" ".join(f"d{i}l{m}w{j}" for j in range(12)) for m in range(n // 12))
    item = " ".join(f"q{j}" for j in range(20))
    rows = [(i, text(i)) for i in range(30)]
    rows += [(100, text(3)), (101, text(50) + "\n" + item), (102, "short"), (103, None), (104, "### " * 80)]
    near = text(60, 120).split("\n")
    rows += [(110, " ".join(near)), (111, " ".join([*near[:-1], "another end"]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted(r["doc_id"] for r in out) == [*range(30), 110]
    model = sentencepiece.Model.load()
    texts = dict(rows)
    assert all(r["round_trip"] and model.decode(r["token_ids"]) == texts[r["doc_id"]] for r in out)
    kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet").where("doc_id < 100")
    assert near_dedup.near_duplicates(kept).where("not kept").isEmpty() and decontaminate.report(kept, spark.createDataFrame([(1, item)], "item_id long, text string")).where("contaminated").isEmpty()
