"""The query catalog: every operator applied to the given tables."""

from __future__ import annotations


def load_queries():
    from tallyweave.plans import (  # noqa: F401 - importing registers
        accuracy_queries, baseline_queries, exact_queries, io_queries, linear_queries, summary_queries,
    )
    from tallyweave.plans.registry import QUERIES

    return QUERIES
