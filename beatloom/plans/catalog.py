"""All registered queries: name -> (DataFrame function, equivalent SQL or None)."""

from __future__ import annotations

import importlib

AREAS = [
    "sentence_queries",
    "split_queries",
    "label_queries",
    "metric_queries",
    "segment_queries",
    "codebook_queries",
    "run_queries",
    "source_queries",
    "feature_queries",
]

QUERIES: dict = {}
for _area in AREAS:
    _mod = importlib.import_module(f"beatloom.plans.{_area}")
    for _name, _pair in _mod.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"query {_name} registered twice")
        QUERIES[_name] = _pair
