"""SQL text of the same fixtures, for the side-by-side check."""

from __future__ import annotations

from revuelens.plans.fixtures import LEXICON, MIN_VOTES, PER_STRATUM, SEED, STOP_WORDS

# Fixed values, written here on their own so that a wrong class in the engine shows:
# white space as Python's str.split sees it, and word characters.
SPACE = r"\x09\x0A\x0B\x0C\x0D\x1C\x1D\x1E\x1F\x20\x85\pZ"
WORD = r"\pL\pN_"
LINK, TAG, ODD = f"http[^{SPACE}]+", "<[^\n]*?>", f"[^{WORD}{SPACE}.,!?;:'-]"


def sql_list(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


STOPS = sql_list(STOP_WORDS)


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def word_count(x: str) -> str:
    return f"cast(len({words(x)}) as int)"


def clean(x: str) -> str:
    def replaced(value: str, pattern: str, by: str) -> str:
        pattern = pattern.replace("'", "''")
        return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"

    plain = replaced(replaced(replaced(f"lower({x})", LINK, ""), TAG, " "), ODD, " ")
    return f"coalesce(trim({replaced(plain, f'[{SPACE}]+', ' ')}), '')"


def clean_words(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z{SPACE}]', '', 'g')"
    return f"list_filter({words(letters)}, lambda w: length(w) > 2 and w not in {STOPS})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[{WORD}]{{2,}}'), lambda w: w not in {STOPS})"


def grams(source: str, row_id: str, carry: str, items: str, n: int, gap: str = " ") -> str:
    """Select of (carried columns, ``gram``): every run of ``n`` neighbouring items of a row.

    Items are listed with their place and joined to the next ones by ``lead``; a
    lambda over slices would take the list apart again for every item.
    """
    joined = "w" + "".join(f" || '{gap}' || lead(w, {k}) over win" for k in range(1, n))
    return f"""select {carry}, gram from (select {carry}, {joined} as gram
        from (select {carry}, {row_id} as rid, unnest(ws) as w, generate_subscripts(ws, 1) as pos
            from (select {carry}, {row_id}, {items} as ws from {source}))
        window win as (partition by rid order by pos)) where gram is not null"""


def uniform(digest: str, start: int = 1) -> str:
    return f"(cast(('0x' || substr({digest}, {start}, 12)) as bigint) / cast(281474976710656 as double))"


def digest(column: str, seed: int = SEED, salt: str = "") -> str:
    return f"md5(cast({column} as varchar) || '#{seed}{salt}')"


CTES: dict[str, tuple[list[str], str]] = {
    "reviews": (
        [],
        """select doc_id as review_id, lang as product_category,
        cast(case when doc_id%97=96 then null when doc_id%10=0 then 1 when doc_id%10=1 then 2
             when doc_id%10=2 then 3 when doc_id%10 in (3,4) then 4 else 5 end as int) as star_rating,
        case when doc_id%89=88 then null else split_part(text, chr(10), 1) end as review_headline,
        case when doc_id%101=100 then null else text end as review_body,
        case when doc_id%53=52 then null
             else cast(least((doc_id*7)%23, (doc_id*5)%19) as int) end as helpful_votes,
        cast((doc_id*7)%23 as int) as total_votes,
        case when doc_id%50=49 then 'Y' else 'N' end as vine,
        case when doc_id%7=6 then 'N' else 'Y' end as verified_purchase,
        case when doc_id%211=210 then 'not-a-date'
             else strftime(date '2014-01-01' + cast((doc_id*37)%600 as int), '%Y-%m-%d') end as review_date
        from documents""",
    ),
    "filtered": (
        ["reviews"],
        f"""select *, cast(helpful_votes as double) / nullif(total_votes, 0) as helpfulness_ratio
        from reviews where verified_purchase = 'Y' and total_votes >= {MIN_VOTES}
        and star_rating is not null and review_body is not null
        and review_headline is not null and product_category is not null""",
    ),
    "measured": (
        ["filtered"],
        f"""select *, cast(length(review_body) as int) as review_body_len,
        {word_count("review_body")} as review_body_words,
        cast(length(review_headline) as int) as review_headline_len,
        {word_count("review_headline")} as review_headline_words from filtered""",
    ),
    "banded": (["measured"], "select * from measured where review_body_words between 5 and 300"),
    "cleaned": (
        ["banded"],
        f"""select * from (select * replace (coalesce(helpfulness_ratio,
            median(helpfulness_ratio) over (partition by product_category, star_rating), 0.0)
            as helpfulness_ratio),
        cast(dense_rank() over (order by product_category) - 1 as int) as category_encoded,
        {clean("review_body")} as clean_body, {clean("review_headline")} as clean_headline
        from banded) where length(clean_body) > 0 and length(clean_headline) > 0""",
    ),
    "sampled": (
        ["cleaned"],
        f"""select * replace ({word_count("clean_body")} as review_body_words) from cleaned
        qualify row_number() over (partition by product_category, star_rating
            order by {digest("review_id")}, review_id) <= {PER_STRATUM}""",
    ),
    "prepared": (
        ["sampled"],
        f"""select *, (review_body_words - avg(review_body_words) filter (split = 'train') over ())
            / stddev_pop(review_body_words) filter (split = 'train') over () as length_scaled,
        (helpfulness_ratio - avg(helpfulness_ratio) filter (split = 'train') over ())
            / stddev_pop(helpfulness_ratio) filter (split = 'train') over () as helpfulness_scaled
        from (select * exclude (rn, n), case when rn <= floor(n * cast(0.8 as double) + 0.5) then 'train'
            when rn <= floor(n * cast(0.9 as double) + 0.5) then 'val' else 'test' end as split
        from (select *, row_number() over (partition by product_category, star_rating
                order by {digest("review_id")}, review_id) as rn,
            count(*) over (partition by product_category, star_rating) as n from sampled))""",
    ),
    "facts": (
        [],
        """select *, cast(helpful_votes as double) / nullif(total_votes, 0) as helpfulness_ratio from (
        select l_orderkey * 8 + l_linenumber as review_id, p_type as product_category,
        cast(1 + (l_orderkey*7 + l_linenumber*3) % 5 as int) as star_rating,
        cast(floor(l_quantity) as int) as total_votes,
        cast(l_partkey % (cast(floor(l_quantity) as int) + 1) as int) as helpful_votes,
        case when l_returnflag = 'R' then 'N' else 'Y' end as verified_purchase,
        cast(l_shipdate as date) as review_date,
        cast(cast(floor(l_extendedprice) as bigint) % 500 as int) as review_body_words
        from lineitem join part on l_partkey = p_partkey)""",
    ),
    "vectors": (
        [],
        """select a.vec_id as review_id, cast(a.label % 5 as int) as category_encoded,
        cast(1 + a.vec_id % 5 as int) as star_rating, a.label,
        cast(a.embedding as double[]) as body_emb, cast(b.embedding as double[]) as head_emb
        from embeddings a join embeddings b
        on b.vec_id = (a.vec_id + 1) % (select count(*) from embeddings)""",
    ),
    "predictions": (
        [],
        """select doc_id as id, quality as label, cast(doc_id % 3 > 0 as int) as prediction,
        cast(case when doc_id % 3 > 0 then 0.7 else 0.4 end as double) as p1 from labels""",
    ),
    "scores": (
        [],
        """select event_id as id, event_type, cast(event_type = 'purchase' as int) as label,
        round(value / (value + 100), 9) as score from events""",
    ),
    "texts": (
        [],
        "select text, 1 as label from documents union all select text, 0 from benchmark",
    ),
    "lexicon": (
        [],
        "select * from (values "
        + ", ".join(f"('{w}', cast({v} as double))" for w, v in LEXICON)
        + ") t(word, valence)",
    ),
    "history": (
        [],
        """select 'm' || cast(user_id % 4 as varchar) as model, cast(hour(ts) as int) as epoch,
        'val_acc' as metric, round(avg(value), 6) as value from events group by 1, 2""",
    ),
    "generated": (
        [],
        """select conv_id || '-' || turn as id, role as category,
        cast(1 + conv_id % 5 as int) as star_rating,
        (length(text) % 101) / cast(100 as double) as gan_quality, text from conversations""",
    ),
}


def with_ctes(body: str, *names: str) -> str:
    """``body`` preceded by the named fixtures and what they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{name} as ({CTES[name][1]})" for name in order)
    return f"with recursive {parts}\n{body}" if parts else body
