"""Tables written by the sinks and read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from revuelens.functions.vectors import cosine
from revuelens.operators.vectors import attach_embeddings, attach_latents
from revuelens.plans import fixtures as fx
from revuelens.plans.catalog import query
from revuelens.schema import RAW
from revuelens.session import work_dir
from revuelens.sources.reviews import scan_reviews
from revuelens.sources.tables import (
    read_bucketed,
    read_embeddings,
    read_latents,
    read_split,
    read_table,
    write_bucketed,
    write_csv,
    write_embeddings,
    write_latents,
    write_report,
    write_splits,
    write_table,
    write_text,
)


def _new_path(spark) -> str:
    return f"{work_dir(spark)}/stored-{uuid.uuid4().hex}"


@query(
    "scan_reviews",
    """select cast(review_id as varchar) as review_id, product_category, star_rating, helpful_votes, total_votes,
    vine, verified_purchase, review_date, coalesce(length(review_headline), -1) as headline_len,
    coalesce(length(review_body), -1) as body_len from reviews""",
    ("reviews",),
)
def _(spark, sf):
    path = _new_path(spark)
    options = dict(sep="\t", header=True, quote='"', escape='"', quoteAll=True, emptyValue="")
    fx.reviews(spark, sf).select(RAW.fieldNames()).write.options(**options).csv(path)
    # Texts hold line breaks, which only a scan that keeps files whole can read.
    scanned = scan_reviews(spark, [path], layout=RAW.fieldNames(), multi_line=True)
    return scanned.select(
        "review_id",
        "product_category",
        "star_rating",
        "helpful_votes",
        "total_votes",
        "vine",
        "verified_purchase",
        "review_date",
        F.coalesce(F.length("review_headline"), F.lit(-1)).alias("headline_len"),
        F.coalesce(F.length("review_body"), F.lit(-1)).alias("body_len"),
    )


@query(
    "read_table",
    "select review_id, product_category, star_rating, round(helpfulness_ratio, 6) as helpfulness_ratio from filtered",
    ("filtered",),
)
def _(spark, sf):
    path = _new_path(spark)
    write_table(fx.filtered(spark, sf), path)
    columns = ["review_id", "product_category", "star_rating", "helpfulness_ratio"]
    return read_table(spark, path).select(columns)


@query(
    "read_split",
    "select review_id, split, product_category, star_rating from prepared where split = 'val'",
    ("prepared",),
)
def _(spark, sf):
    from revuelens.plans.queries_prepare import prepared

    path = _new_path(spark)
    write_splits(prepared(spark, sf), path)
    return read_split(spark, path, "val").select("review_id", "split", "product_category", "star_rating")


@query(
    "read_embeddings",
    """select review_id, len(body_emb) as width, round(list_sum(body_emb), 6) as body_sum,
    round(list_sum(head_emb), 6) as head_sum from vectors""",
    ("vectors",),
)
def _(spark, sf):
    path = _new_path(spark)
    write_embeddings(fx.review_vectors(spark, sf), path)

    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda t, x: t + x)

    return read_embeddings(spark, path, "bigint").select(
        "review_id",
        F.size("body_emb").cast("bigint").alias("width"),
        total("body_emb").alias("body_sum"),
        total("head_emb").alias("head_sum"),
    )


@query(
    "bucketed_embeddings",
    """select review_id, r.product_category, r.star_rating, round(list_cosine_similarity(body_emb, head_emb), 6) as cosine
    from reviews r join vectors v using (review_id)""",
    ("reviews", "vectors"),
)
def _(spark, sf):
    """Reviews and vectors stored in buckets of their id, joined where they lie."""
    stored, vectors_at = _new_path(spark), _new_path(spark)
    write_bucketed(fx.reviews(spark, sf), stored, "review_id")
    write_embeddings(fx.review_vectors(spark, sf), vectors_at)
    joined = attach_embeddings(read_bucketed(spark, stored), read_embeddings(spark, vectors_at))
    return joined.select(
        "review_id", "product_category", "star_rating", cosine(F.col("body_emb"), F.col("head_emb")).alias("cosine")
    )


@query(
    "bucketed_split",
    """select review_id, p.split, p.star_rating, round(list_sum(body_emb), 6) as body_sum
    from prepared p join vectors v using (review_id) where p.split = 'train'""",
    ("prepared", "vectors"),
)
def _(spark, sf):
    """One split of the prepared table with its vectors; only the folders of that split are read."""
    from revuelens.plans.queries_prepare import prepared

    splits_at, vectors_at = _new_path(spark), _new_path(spark)
    write_splits(prepared(spark, sf), splits_at)
    write_embeddings(fx.review_vectors(spark, sf), vectors_at)
    joined = attach_embeddings(read_split(spark, splits_at, "train"), read_embeddings(spark, vectors_at))
    total = F.aggregate("body_emb", F.lit(0.0), lambda t, x: t + x)
    return joined.select("review_id", "split", "star_rating", total.alias("body_sum"))


@query(
    "bucketed_latents",
    """select review_id, r.star_rating, round(list_sum(v.latent), 6) as latent_sum
    from reviews r join (select review_id, body_emb[1:8] as latent from vectors) v using (review_id)""",
    ("reviews", "vectors"),
)
def _(spark, sf):
    """Latents, here the first eight elements, stored and joined in the same way."""
    stored, latents_at = _new_path(spark), _new_path(spark)
    write_bucketed(fx.reviews(spark, sf).select("review_id", "star_rating"), stored, "review_id")
    write_latents(fx.review_vectors(spark, sf).select("review_id", F.slice("body_emb", 1, 8).alias("latent")), latents_at)
    joined = attach_latents(read_bucketed(spark, stored), read_latents(spark, latents_at))
    total = F.aggregate("latent", F.lit(0.0), lambda t, x: t + x)
    return joined.select("review_id", "star_rating", total.alias("latent_sum"))


_LINE_COLUMNS = ["review_id", "product_category", "star_rating", "helpful_votes"]


def _line_files(spark, sf) -> list[str]:
    """Review lines in files of two layouts: even ids with all columns, odd ids with two."""
    rows = fx.reviews(spark, sf)
    i = F.col("review_id")
    rating = F.coalesce(F.col("star_rating").cast("string"), F.lit(""))
    first = F.concat(i.cast("string"), F.lit("\t"), F.col("product_category"), F.lit("\t"), rating, F.lit("\t"), votes())
    second = F.concat(votes(), F.lit("\t"), i.cast("string"))
    out = []
    for part, header, line in ((0, "\t".join(_LINE_COLUMNS), first), (1, "helpful_votes\treview_id", second)):
        out.append(_write_lines(rows.filter(i % 2 == part).select(line.alias(header))))
    return out


def _write_lines(lines) -> str:
    """Lines as they are, in as many files as there are tasks, the column's name on top of each."""
    path = _new_path(lines.sparkSession)
    raw = dict(sep="\x01", quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    lines.write.options(header=True, **raw).csv(path)
    return path


def votes():
    return F.coalesce(F.col("helpful_votes").cast("string"), F.lit(""))


@query(
    "scan_line_files",
    """select cast(review_id as varchar) as review_id,
    case when review_id % 2 = 1 then null else product_category end as product_category,
    case when review_id % 2 = 1 then null else star_rating end as star_rating, helpful_votes from reviews""",
    ("reviews",),
)
def _(spark, sf):
    """Files of two layouts, joined by column name; absent columns are null."""
    return scan_reviews(spark, [*_line_files(spark, sf), _new_path(spark)], _LINE_COLUMNS)


def _ragged(spark, sf, too_long=None):
    """Keys and lines: short ones, ones with a field too many, quoted ones, ones with a word for a number."""
    i = F.col("review_id")
    too_long = F.concat(F.lit("\t"), votes(), F.lit("\tmore")) if too_long is None else too_long
    last = F.when(i % 5 == 1, "").when(i % 5 == 2, too_long).otherwise(F.concat(F.lit("\t"), votes()))
    quoted = F.when(i % 5 == 3, F.concat(F.lit('"'), F.col("product_category"), F.lit(' ""q"""'))).otherwise(F.col("product_category"))
    rating = F.when(i % 5 == 4, "five").otherwise(F.coalesce(F.col("star_rating").cast("string"), F.lit("")))
    line = F.concat(i.cast("string"), F.lit("\t"), quoted, F.lit("\t"), rating, last)
    return fx.reviews(spark, sf).select(i.alias("k"), line.alias("\t".join(_LINE_COLUMNS)))


def _ragged_files(spark, sf, too_long=None) -> str:
    return _write_lines(_ragged(spark, sf, too_long).drop("k"))


_RAGGED_SQL = """select cast(review_id as varchar) as review_id,
    case when review_id % 5 = 3 then product_category || ' "q"' else product_category end as product_category,
    case when review_id % 5 = 4 then null else star_rating end as star_rating,
    case when review_id % 5 = 1 then null else helpful_votes end as helpful_votes
    from reviews where review_id % 5 <> 2"""


@query("scan_malformed_lines", _RAGGED_SQL, ("reviews",))
def _(spark, sf):
    """Long lines go, short ones are padded, quotes are undone, a word in a number column is null."""
    return scan_reviews(spark, [_ragged_files(spark, sf)], _LINE_COLUMNS)


@query("scan_trailing_tab", _RAGGED_SQL, ("reviews",))
def _(spark, sf):
    """A line whose only extra field is empty is too long as well."""
    return scan_reviews(spark, [_ragged_files(spark, sf, F.concat(F.lit("\t"), votes(), F.lit("\t")))], _LINE_COLUMNS)


@query(
    "scan_cut_lines",
    _RAGGED_SQL.replace(" where review_id % 5 <> 2", ""),
    ("reviews",),
)
def _(spark, sf):
    """Long lines kept to the width of the header."""
    return scan_reviews(spark, [_ragged_files(spark, sf)], _LINE_COLUMNS, long_lines="cut")


@query(
    "scan_row_cap",
    """select cast(review_id as varchar) as review_id from reviews where review_id % 5 <> 2
    order by reviews.review_id limit 50""",
    ("reviews",),
)
def _(spark, sf):
    """The cap per file is the feature: the first 50 good lines of one file in the order of ids, which one task writes."""
    path, rows = _new_path(spark), _ragged(spark, sf)
    header = spark.createDataFrame([(-1, rows.columns[1])], "k long, value string")
    ordered = header.unionByName(rows.toDF("k", "value")).coalesce(1).sortWithinPartitions("k")
    ordered.select("value").write.text(path)
    return scan_reviews(spark, [path], ["review_id"], max_rows_per_file=50)


@query(
    "write_csv",
    "select id, category, star_rating, round(gan_quality, 6) as gan_quality, text from generated",
    ("generated",),
)
def _(spark, sf):
    path = _new_path(spark)
    write_csv(fx.generated(spark, sf), path)
    schema = "id string, category string, star_rating int, gan_quality double, text string"
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)


@query(
    "write_text",
    """select "block", cast(count(*) as bigint) as n from (select '[' || category || ', ' || star_rating || ', Q:'
        || format('{:.2f}', gan_quality) || ']' as "block" from generated) group by 1""",
    ("generated",),
)
def _(spark, sf):
    """First lines of the blocks of a text sink."""
    path = _new_path(spark)
    write_text(fx.generated(spark, sf), path)
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\[\w+, \d, Q:\d\.\d\d\]$"))
    return lines.groupBy(F.col("value").alias("block")).agg(F.count("*").alias("n"))


@query(
    "write_report",
    """select cast(count(*) as bigint) as generated, round(avg(gan_quality), 6) as mean_quality,
    cast(count(distinct category) as bigint) as categories from generated""",
    ("generated",),
)
def _(spark, sf):
    path = _new_path(spark)
    rows = fx.generated(spark, sf)
    write_report(
        rows.agg(
            F.count("*").alias("generated"),
            F.avg("gan_quality").alias("mean_quality"),
            F.count_distinct("category").alias("categories"),
        ),
        path,
    )
    return spark.read.schema("generated long, mean_quality double, categories long").json(path)


@query(
    "head_rows",
    "select review_id, product_category, star_rating from filtered order by review_id limit 5",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf).select("review_id", "product_category", "star_rating")
    return rows.orderBy("review_id").limit(5)
