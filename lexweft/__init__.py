"""Cross-lingual document alignment on Spark: rank reference documents, align paragraphs, write reports."""

from .config import Config
from .plans.engine import AlignmentEngine

__all__ = ["AlignmentEngine", "Config"]
