"""All registered queries with their SQL twins."""

from . import evaluation, evidence, forensics, pages, report, scoring, selection, similarity, sources, stream, urls  # noqa: F401
from .core import REGISTRY, Tables

__all__ = ["REGISTRY", "Tables"]
