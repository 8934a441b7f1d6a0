"""Queries: each module registers its own."""

from . import aggregates, api, decisions_, filters, forecasting, functions_, joins_, reads, sorts, sources_, streams  # noqa: F401
