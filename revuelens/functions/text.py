"""Text column expressions.

Character classes are written out so that Java, RE2 and Python's ``re`` agree:
words are letters, digits and underscore of any script, and white space is the
Unicode set Python's ``str.split`` uses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c- \x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# The cleaning patterns, in the order they are applied, each with
# its replacement. Text is lower-cased first and trimmed last.
CLEANING = [
    (rf"http[^{SPACE}]+", ""),
    (r"<[^\n]*?>", " "),
    (rf"[^{WORD}{SPACE}.,!?;:'-]", " "),
    (rf"[{SPACE}]+", " "),
]


def clean_text(text: Column) -> Column:
    """Lower-case text without links, tags and odd symbols; null becomes empty."""
    out = F.lower(text)
    for pattern, replacement in CLEANING:
        out = F.regexp_replace(out, pattern, replacement)
    return F.coalesce(F.trim(out), F.lit(""))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), 0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def clean_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of three or more Latin letters that are not stop words."""
    letters = F.regexp_replace(F.lower(text), f"[^a-z{SPACE}]", "")
    return F.filter(
        words(letters), lambda w: (F.length(w) > 2) & _not_in(w, stop_words)
    )


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case runs of two or more word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), 0)
    return F.filter(found, lambda w: _not_in(w, stop_words)) if stop_words else found


def _not_in(word: Column, stop_words: Sequence[str]) -> Column:
    return ~word.isin(list(stop_words)) if stop_words else F.lit(True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression used inside a lambda is evaluated again for every element; a
    bound one is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(items: Column, n: int) -> Column:
    """Contiguous n-grams of an array of words, joined with blanks.

    The words are joined once and read back with a look-ahead at each word start,
    which stays in generated code; slicing the array per n-gram would not.
    """
    starts_here = rf"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{n - 1}}}))"
    return F.regexp_extract_all(F.array_join(items, " "), F.lit(starts_here), 1)


def char_grams(text: Column, n: int) -> Column:
    """Contiguous runs of ``n`` characters, overlapping, in one pass over the text."""
    # The first look-ahead skips the second half of a surrogate pair.
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\udc00-\udfff])(?=(.{{{n}}}))"), 1)


def preview(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def prompt(category: str = "product_category", rating: str = "star_rating") -> Column:
    """Request text of a conditional generator (fixed format)."""
    return F.concat(
        F.lit("generate review: category "),
        F.col(category),
        F.lit(" rating "),
        F.col(rating).cast("string"),
    )


# How much of a headline and of a body ``target`` shows.
SHOWN = {"review_headline": 50, "review_body": 200}


def target(headline: str = "review_headline", body: str = "review_body") -> Column:
    """Reply text of a conditional generator (fixed format and lengths)."""
    return F.concat(
        F.lit("Headline: "),
        preview(F.col(headline), SHOWN["review_headline"]),
        F.lit(" Body: "),
        preview(F.col(body), SHOWN["review_body"]),
    )
