"""Imports every query module and returns the registry."""

from __future__ import annotations

import importlib

MODULES = ["sources", "labels", "summaries", "sampling", "encoding", "scores", "search", "kernels", "metrics", "paired",
           "classifiers", "shift", "checks"]



def load():
    from workloads.registry import ORACLES, QUERIES
    for m in MODULES:
        importlib.import_module(f"workloads.{m}")
    return QUERIES, ORACLES
