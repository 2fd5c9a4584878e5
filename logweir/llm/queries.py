"""All queries of this subpackage."""

from __future__ import annotations

from logweir.llm import queries_duplicates, queries_filters, queries_layout, queries_scores, queries_words, registry  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
