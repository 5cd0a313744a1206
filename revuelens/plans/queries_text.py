"""Term counts, sequences, sentiment and character models."""

from __future__ import annotations

from pyspark.sql import functions as F

from revuelens.functions.text import clean_words
from revuelens.functions.text import prompt as prompt_text
from revuelens.operators import char_lm, heavy, kneser_ney, metrics, profile, text
from revuelens.plans import fixtures as fx
from revuelens.plans import oracle as o
from revuelens.plans.catalog import query


@query(
    "clean_words",
    f"select doc_id, array_to_string({o.clean_words('text')}, ' ') as words from documents",
)
def _(spark, sf):
    words = F.array_join(clean_words(F.col("text"), fx.STOP_WORDS), " ")
    return fx.table(spark, sf, "documents").select("doc_id", words.alias("words"))


def _top_sql(terms: str, by: str, k: int) -> str:
    return f""", t as ({terms}),
    c as (select {by}, term, count(*) as n from t group by 1, 2)
    select * from c qualify row_number() over (partition by {by} order by n desc, term) <= {k}"""


def _grams_sql(n: int) -> str:
    found = o.grams("filtered", "review_id", "star_rating", o.tokens("review_body"), n)
    return f"select star_rating, gram as term from ({found})"


def _words_sql(source: str, by: str) -> str:
    return f"select {by}, unnest({o.clean_words('review_body')}) as term from {source}"


@query(
    "top_bigrams_by_rating",
    _top_sql(_grams_sql(2), "star_rating", 20),
    ("filtered",),
)
def _(spark, sf):
    return text.top_ngrams(
        fx.filtered(spark, sf), "review_body", 2, 20, ["star_rating"], fx.STOP_WORDS
    )


@query(
    "top_trigrams_by_rating",
    _top_sql(_grams_sql(3), "star_rating", 15),
    ("filtered",),
)
def _(spark, sf):
    return text.top_ngrams(
        fx.filtered(spark, sf), "review_body", 3, 15, ["star_rating"], fx.STOP_WORDS
    )


@query(
    "frequent_bigrams_by_rating",
    _top_sql(_grams_sql(2), "star_rating", 20),
    ("filtered",),
)
def _(spark, sf):
    """The same rows from merged summaries and an exact count of what may be among them."""
    return heavy.frequent_ngrams(fx.filtered(spark, sf), "review_body", 2, 20, ["star_rating"], fx.STOP_WORDS)


@query(
    "frequent_vocabulary",
    f"""select term as word, cast(row_number() over (order by n desc, term) + 1 as int) as word_id, n from (
        select term, count(*) as n from (select unnest({o.words("lower(review_body)")}) as term from filtered) group by 1)
    qualify word_id <= 5001""",
    ("filtered",),
)
def _(spark, sf):
    """The 5,000 most frequent words."""
    return heavy.frequent_vocabulary(fx.filtered(spark, sf), "review_body", 5000)


@query(
    "top_words_by_rating",
    _top_sql(
        _words_sql("filtered", "star_rating") + " where star_rating in (1, 5)", "star_rating", 150
    ),
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf).filter(F.col("star_rating").isin(1, 5))
    return text.top_words(rows, "review_body", 150, ["star_rating"], fx.STOP_WORDS)


@query(
    "top_words_by_category",
    _top_sql(_words_sql("filtered", "product_category"), "product_category", 80),
    ("filtered",),
)
def _(spark, sf):
    return text.top_words(fx.filtered(spark, sf), "review_body", 80, ["product_category"], fx.STOP_WORDS)


@query(
    "bigram_diversity",
    f""", numbered as (select *, row_number() over () as id from texts),
    b as ({o.grams("numbered", "id", "label", o.words("lower(text)"), 2)}),
    d as (select label, count(*) as total_bigrams, count(distinct gram) as unique_bigrams from b group by 1),
    w as (select label, avg(len({o.words("text")})) as mean_words from texts group by 1)
    select label, coalesce(total_bigrams, 0) as total_bigrams, coalesce(unique_bigrams, 0) as unique_bigrams,
    round(coalesce(unique_bigrams, 0) / cast(greatest(coalesce(total_bigrams, 0), 1) as double), 6) as diversity,
    round(mean_words, 6) as mean_words from w left join d using (label)""",
    ("texts",),
)
def _(spark, sf):
    return text.bigram_diversity(fx.texts(spark, sf), "text", ["label"])


@query(
    "bigram_diversity_overall",
    f""", b as ({o.grams("generated", "id", "category", o.words("lower(text)"), 2)})
    select (select count(*) from b) as total_bigrams, (select count(distinct gram) from b) as unique_bigrams,
    round((select count(distinct gram) / cast(count(*) as double) from b), 6) as diversity,
    round(avg(len({o.words("text")})), 6) as mean_words from generated""",
    ("generated",),
)
def _(spark, sf):
    return text.bigram_diversity(fx.generated(spark, sf), "text")


@query(
    "label_union",
    "select label, count(*) as n, cast(sum(length(text)) as bigint) as n_chars from texts group by 1",
    ("texts",),
)
def _(spark, sf):
    return fx.texts(spark, sf).groupBy("label").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "seq2seq_pairs",
    """select review_id, 'generate review: category ' || product_category || ' rating ' || star_rating as source,
    'Headline: ' || substring(review_headline, 1, 50) || ' Body: ' || substring(review_body, 1, 200) as target
    from filtered""",
    ("filtered",),
)
def _(spark, sf):
    return text.seq2seq_pairs(fx.filtered(spark, sf))


@query(
    "conversation_pairs",
    """select u.conv_id, u.turn, 'generate review: category user rating ' || (1 + u.conv_id % 5) as prompt,
    'Headline: ' || substring(u.text, 1, 50) || ' Body: ' || substring(a.text, 1, 200) as target
    from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
    where u.role = 'user' and a.role = 'assistant'""",
)
def _(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    users = turns.filter(F.col("role") == "user").select(
        "conv_id",
        "turn",
        F.col("role").alias("product_category"),
        (1 + F.col("conv_id") % 5).alias("star_rating"),
        F.col("text").alias("review_headline"),
    )
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("review_body")
    )
    pairs = users.join(replies, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", prompt_text().alias("prompt"), text.target().alias("target"))


_VOCAB = f""", wv as (select term as word, row_number() over (order by n desc, term) + 1 as word_id from (
        select term, count(*) as n from (select unnest({o.words("lower(review_body)")}) as term from filtered)
        group by 1 order by n desc, term limit 400))"""


@query("word_vocabulary", _VOCAB + " select word, cast(word_id as int) as word_id from wv", ("filtered",))
def _(spark, sf):
    return text.word_vocabulary(fx.filtered(spark, sf), "review_body", 400)


@query(
    "token_ids",
    _VOCAB
    + f""", w as (select review_id, {o.words("lower(review_body)")}[1:32] as ws from filtered),
    i as (select review_id, list(coalesce(word_id, 1) order by pos) as ids from (
        select review_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w) left join wv using (word)
        group by 1),
    f as (select review_id, coalesce(ids, []) as ids, len(coalesce(ids, [])) as used
        from filtered left join i using (review_id))
    select review_id,
    rtrim(array_to_string(ids, ',') || ',' || repeat('0,', 32 - used), ',') as input_ids,
    rtrim(repeat('1,', used) || repeat('0,', 32 - used), ',') as attention_mask,
    rtrim(array_to_string(ids, ',') || ',' || repeat('-100,', 32 - used), ',') as labels from f""",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf)
    vocabulary = text.word_vocabulary(rows, "review_body", 400)
    ids = text.token_ids(rows, "review_body", vocabulary, 32)
    return ids.select(
        "review_id",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


_CHARS = """, chars as (select distinct unnest(string_split(review_body, '')) as char from filtered),
    cv as (select char, row_number() over (order by char) - 1 as char_id from chars where length(char) > 0),
    alphabet as (select string_agg(char, '' order by char) as alphabet from cv)"""


@query("char_vocab", _CHARS + " select char, cast(char_id as int) as char_id from cv", ("filtered",))
def _(spark, sf):
    return text.char_vocab(fx.filtered(spark, sf), "review_body")


@query(
    "encode_chars",
    _CHARS
    + """, e as (select review_id, list_filter(list_transform(string_split(coalesce(review_body, ''), ''),
        lambda c: case when length(c) > 0 then strpos(alphabet, c) - 1 else -1 end), lambda i: i >= 0) as ids
        from reviews cross join alphabet where review_body is not null)
    select review_id, len(ids) as n_ids, cast(coalesce(list_sum(ids), 0) as bigint) as sum_ids from e""",
    ("filtered",),
)
def _(spark, sf):
    vocab = text.char_vocab(fx.filtered(spark, sf), "review_body")
    rows = fx.reviews(spark, sf).filter(F.col("review_body").isNotNull())
    encoded = text.encode_chars(rows, "review_body", vocab)
    total = F.aggregate("encoded", F.lit(0).cast("bigint"), lambda t, x: t + x)
    return encoded.select(
        "review_id", F.size("encoded").cast("bigint").alias("n_ids"), total.alias("sum_ids")
    )


@query(
    "char_windows",
    _CHARS
    + f""", e as (select review_id, star_rating, list_transform(string_split(review_body, ''),
        lambda c: strpos(alphabet, c) - 1) as ids from filtered cross join alphabet),
    p as (select *, cast(floor({o.uniform(o.digest("review_id"))} * (len(ids) - 100)) as int) as "offset"
        from e where len(ids) > 100)
    select review_id, star_rating, "offset", array_to_string(ids["offset" + 1:"offset" + 100], ',') as x,
    array_to_string(ids["offset" + 2:"offset" + 101], ',') as y from p""",
    ("filtered",),
)
def _(spark, sf):
    rows = fx.filtered(spark, sf)
    encoded = text.encode_chars(rows, "review_body", text.char_vocab(rows, "review_body"))
    windows = text.char_windows(encoded, 100, fx.SEED)
    return windows.select(
        "review_id",
        "star_rating",
        "offset",
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("x", "y")],
    )


_SENTIMENT = f""", s as (select review_id, star_rating, coalesce(sum(valence), 0) as valence from (
        select review_id, star_rating, unnest(case when len(ws) = 0 then [null] else ws end) as word from (
            select review_id, star_rating, coalesce(regexp_extract_all(lower(review_body),
            '[^{o.SPACE}.,!?;:"()]+'), []) as ws from reviews)) left join lexicon using (word) group by 1, 2),
    c as (select *, valence / sqrt(valence * valence + 15) as compound from s)"""


def sentiment(spark, sf):
    return text.lexicon_sentiment(
        fx.reviews(spark, sf), "review_body", fx.lexicon(spark), keep=["star_rating"]
    )


@query(
    "lexicon_sentiment",
    _SENTIMENT
    + " select review_id, star_rating, round(valence, 6) as valence, round(compound, 6) as compound from c",
    ("reviews", "lexicon"),
)
def _(spark, sf):
    return sentiment(spark, sf)


@query(
    "sentiment_summary",
    _SENTIMENT
    + " select count(*) as n, round(avg(compound), 6) as mean, round(stddev_samp(compound), 6) as std from c",
    ("reviews", "lexicon"),
)
def _(spark, sf):
    return text.sentiment_summary(sentiment(spark, sf))


@query(
    "box_sentiment_by_rating",
    _SENTIMENT
    + """, r as (select star_rating, round(compound, 9) as v from c),
    q as (select star_rating, count(v) as n_rows, quantile_cont(v, 0.25) as q1, median(v) as med,
        quantile_cont(v, 0.75) as q3 from r group by 1)
    select r.star_rating, any_value(n_rows) as n_rows, round(any_value(q1), 6) as q1, round(any_value(med), 6) as median,
    round(any_value(q3), 6) as q3,
    round(min(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_lo,
    round(max(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_hi,
    count(*) filter (v not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
    from r join q on r.star_rating is not distinct from q.star_rating group by 1""",
    ("reviews", "lexicon"),
)
def _(spark, sf):
    scored = sentiment(spark, sf).withColumn("compound", F.round("compound", 9))
    return profile.box_stats(scored, ["star_rating"], "compound")


@query(
    "rating_sentiment_agreement",
    _SENTIMENT
    + """ select round(avg(case when sign(round(compound, 9)) = case when star_rating <= 2 then -1 when star_rating >= 4 then 1 else 0 end
    then 1 else 0 end), 6) as agreement, count(*) as n from c where star_rating is not null""",
    ("reviews", "lexicon"),
)
def _(spark, sf):
    scored = sentiment(spark, sf).withColumn("compound", F.round("compound", 9))
    return metrics.rating_sentiment_agreement(scored)


_REVIEW_CHARS = "string_split(review_body, '')"
_GRAMS = f""", g as (select star_rating, gram, count(*) as n from (
        {o.grams("filtered", "review_id", "star_rating", _REVIEW_CHARS, 3, "")}) group by 1, 2),
    m as (select star_rating, substring(gram, 1, 2) as context, substring(gram, 3, 1) as next, n,
        cast(sum(n) over (partition by star_rating, substring(gram, 1, 2)) as bigint) as n_context from g)"""


@query(
    "fit_char_ngram",
    _GRAMS + ' select star_rating, context, "next", n, n_context from m',
    ("filtered",),
)
def _(spark, sf):
    return char_lm.fit_char_ngram(fx.filtered(spark, sf), "review_body", 3)


@query(
    "char_perplexity",
    _GRAMS
    + f""", eg as (select star_rating, gram, count(*) as n from (
        {o.grams("generated", "id", "star_rating", "string_split(text, '')", 3, "")}) group by 1, 2),
    ctx as (select distinct star_rating, context, n_context from m),
    size as (select count(*) + 1 as size from (select distinct unnest(string_split(review_body, '')) as char from filtered)
        where length(char) > 0),
    l as (select eg.star_rating, eg.n, -ln((coalesce(m.n, 0) + 1.0::double)
        / (coalesce(ctx.n_context, 0) + cast(size.size as double))) as loss from eg cross join size
        left join m on m.star_rating = eg.star_rating and m.context || m.next = eg.gram
        left join ctx on ctx.star_rating = eg.star_rating and ctx.context = substring(eg.gram, 1, 2))
    select star_rating, cast(sum(n) as bigint) as n_chars, round(sum(loss * n) / sum(n), 6) as loss,
    round(exp(least(sum(loss * n) / sum(n), 20)), 6) as perplexity from l group by 1""",
    ("filtered", "generated"),
)
def _(spark, sf):
    fitted = fx.filtered(spark, sf)
    model = char_lm.fit_char_ngram(fitted, "review_body", 3)
    # The alphabet of the fitted texts, and one for any other character.
    size = text.char_vocab(fitted, "review_body").count() + 1
    held_out = fx.table(spark, sf, "conversations").select(
        (1 + F.col("conv_id") % 5).cast("int").alias("star_rating"), "text"
    )
    return char_lm.char_perplexity(held_out, model, "text", size, 3)


# Grams of each order: occurrences of the highest, different characters before those below.
_KNESER_NEY = f""", o3 as (select star_rating, gram, count(*) as n from (
        {o.grams("filtered", "review_id", "star_rating", _REVIEW_CHARS, 3, "")}) group by 1, 2),
    o2 as (select star_rating, substring(gram, 2) as gram, count(*) as n from o3 group by 1, 2),
    o1 as (select star_rating, substring(gram, 2) as gram, count(*) as n from o2 group by 1, 2),
    kn as (select 3 as "order", * from o3 union all select 2, * from o2 union all select 1, * from o1),
    rows_of as (select star_rating, "order", substring(gram, 1, "order" - 1) as context, substring(gram, "order", 1) as next, n from kn),
    ctx as (select star_rating, "order", context, cast(sum(n) as bigint) as n, count(*) as n_types from rows_of group by 1, 2, 3)"""


@query(
    "fit_kneser_ney",
    _KNESER_NEY
    + """ select star_rating, "order", context, next, n, cast(null as bigint) as n_types from rows_of
    union all select star_rating, "order", context, null, n, n_types from ctx""",
    ("filtered",),
)
def _(spark, sf):
    return kneser_ney.fit_kneser_ney(fx.filtered(spark, sf), "review_body", 3)


def _order_sql(k: int, below: str) -> str:
    return f"""coalesce((greatest(coalesce(r{k}.n, 0) - 0.75::double, 0) + 0.75::double * c{k}.n_types * {below}) / c{k}.n, {below})"""


def _joins_sql(k: int) -> str:
    context = f"substring(eg.gram, {4 - k}, {k - 1})"
    return f"""left join rows_of r{k} on r{k}."order" = {k} and r{k}.star_rating = eg.star_rating and r{k}.context = {context}
        and r{k}.next = substring(eg.gram, 3, 1)
    left join ctx c{k} on c{k}."order" = {k} and c{k}.star_rating = eg.star_rating and c{k}.context = {context}"""


@query(
    "backoff_perplexity",
    _KNESER_NEY
    + f""", eg as (select star_rating, gram, count(*) as n from (
        {o.grams("generated", "id", "star_rating", "string_split(text, '')", 3, "")}) group by 1, 2),
    size as (select count(*) + 1 as size from (select distinct unnest(string_split(review_body, '')) as char from filtered)
        where length(char) > 0),
    p1 as (select eg.*, {_order_sql(1, "(1 / cast(size.size as double))")} as p1 from eg cross join size {_joins_sql(1)}),
    p2 as (select eg.*, {_order_sql(2, "eg.p1")} as p2 from p1 eg {_joins_sql(2)}),
    p3 as (select eg.*, {_order_sql(3, "eg.p2")} as p3 from p2 eg {_joins_sql(3)}),
    l as (select star_rating, sum(n) as n_chars, sum(-ln(p3) * n) / sum(n) as loss from p3 group by 1)
    select star_rating, cast(n_chars as bigint) as n_chars, round(loss, 6) as loss, round(exp(least(loss, 20)), 6) as perplexity from l""",
    ("filtered", "generated"),
)
def _(spark, sf):
    fitted = fx.filtered(spark, sf)
    model = kneser_ney.fit_kneser_ney(fitted, "review_body", 3)
    size = text.char_vocab(fitted, "review_body").count() + 1
    held_out = fx.table(spark, sf, "conversations").select(
        (1 + F.col("conv_id") % 5).cast("int").alias("star_rating"), "text"
    )
    return kneser_ney.backoff_perplexity(held_out, model, "text", size, 3)
