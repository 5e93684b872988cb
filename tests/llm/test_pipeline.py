"""The pipeline, each stage against its plain version on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from llm_corpus import ITEMS, components, hits, kept_lines, rows


def test_stages(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mix"]
    stage = dict(corpus_pipeline.STAGES)
    data = lambda df: [tuple(r) for r in df.select("doc_id", "text").collect()]
    known = docs.withColumn("lang", __import__("pyspark").sql.functions.lit("xx"))
    one = stage["language_id"](spark, known, str(tmp_path)).persist()
    assert one.columns == docs.columns
    assert {d for d, _ in data(one)} == {d[0] for d in rows()} - {40, 41, 42, 43, 44}
    two = stage["line_dedup"](spark, one, str(tmp_path)).persist()
    assert Counter(data(two)) == Counter((d, t[2]) for (d, _), t in zip(data(one), kept_lines(data(one)), strict=True)) and two.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stage["near_dedup"](spark, two, str(tmp_path)).persist()
    comp = components(data(two))
    assert Counter(data(three)) == Counter((d, t) for d, t in data(two) if comp[d] == d) and three.columns == docs.columns
    four = stage["decontamination"](spark, three, str(tmp_path)).persist()
    assert Counter(data(four)) == Counter((d, t) for d, t in data(three) if not hits(t, ITEMS)[1]) and four.columns == docs.columns
    five = stage["mix"](spark, four, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in five) == Counter((d, len(t.split())) for d, t in data(four))


def test_near_dedup_links_at_80_percent(spark, tmp_path):
    w = [f"w{i}" for i in range(100)]
    other = [f"v{i}" if i in (30, 60) else x for i, x in enumerate(w)]  # 86 of 106 shingles in common
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other)), (3, "something else altogether")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()) == [1, 3]


def test_run(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < out.count() < len(rows())
