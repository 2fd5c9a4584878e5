"""All registered queries and their SQL twins."""

from __future__ import annotations

from logweir.catalog import base, flows, sources_and_text, vectors_and_mining, windows_and_features


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
