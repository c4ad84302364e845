"""Imports every operator module and returns its queries and their SQL."""

import importlib

MODULES = ["simhash", "leaks", "pii", "tokencount", "packing", "quality", "toxicity", "htmltext", "vectors", "language_model", "negatives", "spelling", "repeats"]


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"tarnfold.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
