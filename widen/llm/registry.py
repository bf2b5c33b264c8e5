"""Queries and oracles of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "vector_search", "classifier", "language_crf", "sentencepieces", "html_extract", "warc", "packing", "line_dedup", "jaccard", "toxicity", "divergence", "token_alignment"]


def load():
    """name -> query and name -> DuckDB SQL, in the order of the operators."""
    import corpus_pipeline

    queries, oracles = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"widen.llm.{name}")
        queries.update(m.QUERIES)
        oracles.update(m.ORACLES)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, oracles
