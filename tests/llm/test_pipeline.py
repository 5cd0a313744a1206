import corpus_pipeline
from corpus_pipeline import STAGES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEST_ITEM = "Which of the seven old bridges over the river was closed first? The northern one was closed."


def test_each_stage_on_what_was_kept(spark, folder):
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(f"{words[j * 7]}x{i}" if j % 3 else words[j] for j in range(40)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[5][1], "en", "s1"), (101, rows[6][1] + " tail", "en", "s1"), (102, f"start {TEST_ITEM} end", "en", "s2")]
    rows += [(103, None, None, None), (104, "", None, None), (105, rows[7][1], "en", "s0"), (105, rows[7][1], "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    docs.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, TEST_ITEM)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    now = spark.read.parquet(folder + "/documents.parquet")
    seen = []
    for name, stage in STAGES:
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen.append(now)
    ids = [sorted(r.doc_id for r in x.collect()) for x in seen]
    assert all(x.columns == docs.columns for x in seen[:4])
    assert set(range(60)) <= set(ids[0]) and not {103, 104} & set(ids[0])
    assert ids[1] == [*range(60), 102]
    assert ids[2] == list(range(60))
    assert set(ids[3]) <= set(range(60)) and max(ids[3].count(i) for i in ids[3]) <= 3
    assert ids[4] == ids[3]
    total = sum(len(r.text.split()) for r in seen[2].collect())
    assert abs(sum(len(r.text.split()) for r in seen[3].collect()) - total) < 0.15 * total
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[4].collect()))
