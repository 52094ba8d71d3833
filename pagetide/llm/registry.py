"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from pagetide.llm import (
    decontamination,
    exact_dedup,
    html_text,
    jaccard_join,
    language_id,
    mixing,
    nearest,
    pii,
    quality,
    secrets,
    toxicity,
    vector_codes,
    whitening,
)

MODULES = (
    language_id,
    jaccard_join,
    exact_dedup,
    decontamination,
    mixing,
    html_text,
    toxicity,
    secrets,
    pii,
    quality,
    nearest,
    vector_codes,
    whitening,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
