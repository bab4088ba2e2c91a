"""Imports every operator, so that their queries are registered."""

from scoreloom.llm import alignment, bpe, embeddings, exact, lm, mixing, ngram_join, quality, search, sharding, substring, toxicity, url_filter  # noqa: F401
from scoreloom.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
