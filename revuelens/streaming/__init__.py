"""The row stage over a stream of raw reviews. Nothing here keeps state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revuelens.operators.filters import drop_empty_text, filter_reviews
from revuelens.operators.prepare import with_clean_text, with_helpfulness, with_lengths


def clean_stream(raw: DataFrame, min_total_votes: int) -> DataFrame:
    """Filtered, measured and cleaned rows of a streaming (or any) table of raw reviews."""
    return drop_empty_text(with_clean_text(with_lengths(with_helpfulness(filter_reviews(raw, min_total_votes)))))
