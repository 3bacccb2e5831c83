"""Registered queries, by subject. Importing the modules fills ``compare.REGISTRY``."""

from proofline.catalog import facts, golden, numbers, sources, statistics, streams, texts
from proofline.catalog.compare import REGISTRY

__all__ = ["REGISTRY", "facts", "golden", "numbers", "sources", "statistics", "streams", "texts"]
