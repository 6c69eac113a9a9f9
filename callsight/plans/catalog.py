"""Imports every query module so the registry is complete."""

from __future__ import annotations

from . import q_calls, q_filters, q_io, q_questions, q_segments, q_storage, q_vectors  # noqa: F401
from .registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)


def get(name: str) -> Query:
    return REGISTRY[name]
