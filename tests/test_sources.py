"""Review files in and stored tables out."""

import gzip
import io
import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revuelens.operators.vectors import attach_embeddings, attach_latents
from revuelens.schema import RAW
from revuelens.session import drop_stored, materialize
from revuelens.sources import lines, reviews, tables
from revuelens.streaming import clean_stream

HEADER = "review_id\tproduct_category\tstar_rating\treview_headline\treview_body\thelpful_votes\ttotal_votes"
LINES = [
    "r1\tBooks\t5\tgood\tfine book\t1\t2",
    "r2\tBooks\t4",
    "r3\tBooks\t3\tlong\tline\t1\t2\textra",
    "r4\tBooks\tbad\tint\tbody\t1\t2",
    'r5\tBooks\t2\t"say ""hi"""\tquoted\t0\t1',
    "r6\tBooks\t1\tlast\tgood line\t3\t4",
]


@pytest.fixture()
def tsv(folder):
    path = Path(folder) / "books.tsv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n", encoding="utf-8")
    return str(path)


def test_scan_drops_long_lines_and_pads_short_ones(spark, tsv):
    rows = {r["review_id"]: r for r in reviews.scan_reviews(spark, [tsv]).collect()}
    assert sorted(rows) == ["r1", "r2", "r4", "r5", "r6"]
    assert rows["r2"]["review_body"] is None and rows["r4"]["star_rating"] is None
    assert rows["r5"]["review_headline"] == 'say "hi"' and rows["r1"]["vine"] is None
    assert rows["r6"]["total_votes"] == 4


def test_long_lines_stay_dropped_when_columns_are_pruned(spark, tsv):
    table = reviews.scan_reviews(spark, [tsv], ["review_id"])
    assert table.count() == 5 and table.columns == ["review_id"]


def test_scan_by_name_over_files_with_a_cap(spark, tsv, folder):
    other = Path(folder) / "camera.tsv"
    other.write_text("star_rating\treview_id\n1\tc1\n2\tc2\n3\tc3\n", encoding="utf-8")
    wanted = ["review_id", "star_rating"]
    both = reviews.scan_reviews(spark, [tsv, str(other), folder + "/missing.tsv"], wanted)
    assert both.count() == 8 and both.filter("review_id = 'c3'").first()["star_rating"] == 3
    capped = reviews.scan_reviews(spark, [tsv, str(other)], wanted, max_rows_per_file=2)
    assert sorted(r["review_id"] for r in capped.collect()) == ["c1", "c2", "r1", "r2"]
    assert reviews.scan_reviews(spark, [folder + "/none.tsv"], wanted).count() == 0


def test_declared_layout_scans_files_together(spark, tsv):
    table = reviews.scan_reviews(spark, [tsv, tsv], ["review_id"], layout=HEADER.split("\t"))
    assert table.count() == 10


def test_splits_are_pruned_on_read(spark, folder):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("val"))
    tables.write_splits(rows, folder + "/splits")
    val = tables.read_split(spark, folder + "/splits", "val")
    assert val.count() == 2
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_vector_csv_text_and_report_sinks(spark, folder):
    vectors = spark.createDataFrame(
        [("a", [1.0, 2.0], [0.5, 0.5])], "review_id string, body_emb array<float>, head_emb array<float>"
    )
    tables.write_embeddings(vectors, folder + "/emb")
    assert tables.read_embeddings(spark, folder + "/emb").first()["body_emb"] == [1.0, 2.0]

    rows = spark.createDataFrame(
        [("Books", 5, 0.5, 0.987, 'Headline: "x", y')],
        "category string, star_rating int, helpfulness double, gan_quality double, text string",
    )
    tables.write_csv(rows, folder + "/csv")
    back = spark.read.options(header=True, escape='"').csv(folder + "/csv").first()
    assert back["text"] == 'Headline: "x", y'
    tables.write_text(rows, folder + "/txt")
    block = "".join(p.read_text() for p in Path(folder, "txt").glob("part-*"))
    assert block == '[Books, 5, Q:0.99]\nHeadline: "x", y\n\n'
    tables.write_report(rows.agg(F.count("*").alias("generated")), folder + "/json")
    line = "".join(p.read_text() for p in Path(folder, "json").glob("part-*"))
    assert json.loads(line) == {"generated": 1}


def test_materialized_table_is_pruned(spark):
    stored = materialize(spark.range(5).withColumn("wide", F.lit("x")))
    plan = stored.select("id")._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 5 and "ReadSchema: struct<id:bigint>" in plan


def test_many_files_are_one_scan(spark, folder):
    for i in range(12):
        names = "review_id\tstar_rating" if i % 2 else "star_rating\treview_id"
        Path(folder, f"f{i}.tsv").write_text(names + "\n" + ("r\t1\n" if i % 2 else "1\tr\n"), encoding="utf-8")
    table = reviews.scan_reviews(spark, [folder + "/f*.tsv"], ["review_id", "star_rating"])
    assert [tuple(r) for r in table.distinct().collect()] == [("r", 1)] and table.count() == 12
    assert table._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    assert table.rdd.getNumPartitions() < 12


def _pandas(text, columns, **options):
    frame = pd.read_csv(io.StringIO(text), sep="\t", on_bad_lines="skip", dtype=str, **options)[columns]
    return frame.astype(object).where(frame.notna(), None).values.tolist()


RAGGED = [
    "1\t2\t3\t4", "5\t6", "7\t8\t9\t10\textra", "11\t12\t13\t14\t", '15\t"q\tt"\t17\t18', '19\t"un"x\t3\t4',
    '20\tmid"quote\t3\t4', "", "  ", '22\t"say ""hi"""\t3\t4', "23\tNA\tnull\t4", "24\tx\t\t", "\t y\tü\t漢字", " \t \t \t ",
    "  lead\ttail  \t'a'\tN/A", "\t\t\t", "25\tcr\t1\t2\r", "26\t#N/A\tNone\tnan",
]


@pytest.mark.parametrize("range_bytes", [5, 37, 1 << 20])
@pytest.mark.parametrize("end", ["\n", ""])
def test_ragged_lines_as_pandas_reads_them(spark, folder, monkeypatch, range_bytes, end):
    text = "\n".join(["a\tb\tc\td", *RAGGED * 3]) + end
    path = Path(folder, "r.tsv")
    path.write_bytes(text.encode())
    monkeypatch.setattr(reviews, "_range_bytes", lambda *_: range_bytes)
    monkeypatch.setattr(lines, "BLOCK", 16)
    names = ["a", "b", "c", "d"]
    for columns, long_lines, options in (
        (names, "drop", {}),
        (names, "cut", {"usecols": lambda c: True}),
        (["d", "a"], "cut", {"usecols": lambda c: c in ("a", "d")}),
        (["d", "a"], "drop", {}),
    ):
        rows = reviews.scan_reviews(spark, [str(path)], columns, long_lines=long_lines).collect()
        assert [list(r) for r in rows] == _pandas(text, columns, **options)


def test_line_breaks_in_quotes_compression_and_ends_of_line(spark, folder):
    text = 'a\tb\r\n1\t"two\r\nlines"\r\n\r\n2\t"tab\there"\textra\r\n3\tplain\r\n'
    Path(folder, "m.tsv").write_bytes(text.encode())
    rows = reviews.scan_reviews(spark, [folder + "/m.tsv"], ["a", "b"], multi_line=True)
    assert [list(r) for r in rows.collect()] == _pandas(text, ["a", "b"])
    plain = "a\tb\r\n1\tx\r\n2\ty\r3\tz"
    Path(folder, "p.tsv.gz").write_bytes(gzip.compress(plain.encode()))
    Path(folder, "p.tsv").write_bytes(plain.encode())
    for name in ("p.tsv", "p.tsv.gz"):
        rows = reviews.scan_reviews(spark, [f"{folder}/{name}"], ["b", "a", "none"])
        assert [tuple(r) for r in rows.collect()] == [("x", "1", None), ("y", "2", None), ("z", "3", None)]
    for name, text in (("e.tsv", ""), ("h.tsv", "a\tb"), ("b.tsv", "a\tb\n\n \n")):
        Path(folder, name).write_text(text, encoding="utf-8")
        assert reviews.scan_reviews(spark, [f"{folder}/{name}"], ["a"]).count() == 0


def test_numbers_are_whole_or_null(spark, folder):
    cells = ["4", "4.0", " 4 ", "+4", "4e1", "4.5", "x", "1,000", "99999999999", "-7", "", "NA", "٣", "--1"]
    Path(folder, "n.tsv").write_text("star_rating\treview_id\n" + "".join(f"{c}\t{i}\n" for i, c in enumerate(cells)), encoding="utf-8")
    rows = reviews.scan_reviews(spark, [folder + "/n.tsv"], ["review_id", "star_rating"]).collect()
    assert [r.star_rating for r in rows] == [4, 4, 4, 4, 40, None, None, None, None, -7, None, None, None, None]


def test_a_cap_reads_the_head_only(folder, monkeypatch):
    path = Path(folder, "large.tsv")
    path.write_text("a\tb\n" + "".join(f"{i}\t{'x' * 90}\n" for i in range(50_000)), encoding="utf-8")
    read, opened = [], lines._open

    class Counted:
        def __init__(self, source):
            self.source = source

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

        def read(self, n):
            read.append(len(raw := self.source.read(n)))
            return raw

    monkeypatch.setattr(lines, "_open", lambda p: Counted(opened(p)))
    settings = {"files": [(str(path), path.stat().st_size, ["a", "b"])], "max_rows": 300, "multi_line": False,
                "drop_long": True, "missing": [""], "range_bytes": 1 << 20}
    reader = lines.LineReader(StructType.fromDDL("b string, a int"), settings)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert sum(b.num_rows for b in batches) == 300 and batches[-1].column(1)[-1].as_py() == 299
    assert sum(read) <= 1 << 16


def test_stored_tables_can_be_dropped(spark):
    stored = materialize(spark.range(3))
    place = Path(stored.inputFiles()[0].removeprefix("file://")).parent
    assert place.exists() and drop_stored(spark) > 0 and not place.exists()


def test_row_stage_runs_on_a_stream(spark, folder):
    batch = spark.createDataFrame(
        [("s1", "Books", 5, "Fine", "A <b>nice</b> book", 1, 2, "N", "Y", "2015-01-01"),
         ("s2", "Books", 5, "Fine", "unverified", 1, 2, "N", "N", "2015-01-01")], RAW,
    )
    batch.write.parquet(folder + "/in")
    stream = spark.readStream.schema(RAW).parquet(folder + "/in")
    cleaned = clean_stream(stream, 1)
    query = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("cleaned").collect()
    assert [(r["review_id"], r["clean_body"], r["review_body_words"]) for r in rows] == [("s1", "a nice book", 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


VECTORS = "review_id long, body_emb array<float>, head_emb array<float>"


def test_bucketed_tables_join_without_an_exchange(spark, folder, no_broadcast):
    rows = spark.range(500).selectExpr("id as review_id", "if(id % 5 = 0, 'val', 'train') as split", "id % 7 as v")
    vectors = spark.createDataFrame([(i, [float(i)], [0.5]) for i in range(0, 600, 3)], VECTORS)
    tables.write_splits(rows, folder + "/splits", buckets=6)
    tables.write_embeddings(vectors, folder + "/emb", buckets=6)
    tables.write_latents(vectors.select("review_id", F.col("body_emb").alias("latent")), folder + "/latents", buckets=6)
    train = tables.read_split(spark, folder + "/splits", "train")
    joined = attach_latents(
        attach_embeddings(train, tables.read_embeddings(spark, folder + "/emb")), tables.read_latents(spark, folder + "/latents")
    )
    assert "Exchange" not in _plan(joined) and "PartitionFilters: [isnotnull(split" in _plan(joined)
    got = {(r.review_id, r.v, r.body_emb[0], r.latent[0]) for r in joined.collect()}
    assert got == {(i, i % 7, float(i), float(i)) for i in range(0, 500, 3) if i % 5}
    # The same tables as plain folders are moved.
    assert "Exchange" in _plan(spark.read.parquet(folder + "/splits").join(spark.read.parquet(folder + "/emb"), "review_id"))


def test_another_number_of_buckets_still_joins_right(spark, folder, no_broadcast):
    rows = spark.range(50).selectExpr("id as review_id", "id * 2 as v")
    tables.write_bucketed(rows, folder + "/a", "review_id", 3)
    tables.write_bucketed(rows.filter("review_id > 9"), folder + "/b", "review_id", 4)
    both = tables.read_bucketed(spark, folder + "/a").join(tables.read_bucketed(spark, folder + "/b"), "review_id")
    assert both.count() == 40


def test_bucketed_tables_grow_and_are_replaced(spark, folder, no_broadcast):
    path = folder + "/it's"
    first = spark.createDataFrame([("a", 1), (None, 2)], "review_id string, v int")
    tables.write_bucketed(first, path, "review_id", 4)
    tables.write_bucketed(spark.createDataFrame([("a", 3)], "review_id string, v int"), path, "review_id", mode="append")
    table = tables.read_bucketed(spark, path)
    assert sorted(r.v for r in table.collect()) == [1, 2, 3]
    assert "Exchange" not in _plan(table.join(tables.read_bucketed(spark, path).withColumnRenamed("v", "w"), "review_id"))
    with pytest.raises(Exception):
        tables.write_bucketed(first, path, "review_id", 4)
    tables.write_bucketed(first.limit(0), path, "review_id", 2, mode="overwrite")
    assert tables.read_bucketed(spark, path).count() == 0
    with pytest.raises(ValueError):
        tables.read_bucketed(spark, folder + "/none")
