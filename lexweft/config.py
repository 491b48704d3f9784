"""Settings of an alignment run."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidConfig

SCOPES = ("corpus", "best_document")
METRICS = ("dot", "cosine")
MODES = ("composite", "cosine")


@dataclass(frozen=True)
class Config:
    """Folders, and the numbers that shape ranking and alignment.

    threshold is echoed in reports and filters hits only with apply_threshold. scope: whether a block's nearest
    elements are sought in the whole corpus (hits outside the best document are then lost) or in the best
    document only. mode: how stage 1 scores; precision of all scores is double, rounded to ``digits``.
    """

    reference_dir: str = ""
    query_dir: str = ""
    output_dir: str = ""
    cache_dir: str | None = None
    threshold: float = 0.01
    apply_threshold: bool = False
    top_k: int = 3
    head: int = 10
    dim: int = 256
    top_phrases: int = 10
    oversample: int = 2
    scope: str = "corpus"
    stage2_metric: str = "dot"
    mode: str = "composite"
    strip_suffix: bool = False
    digits: int = 9
    index_dir: str | None = None
    recall: float = 0.95
    large_files: bool = False
    documents: int | None = None

    def __post_init__(self) -> None:
        if self.top_k < 1 or self.head < 1 or self.dim < 1 or self.oversample < 1 or (self.documents or 1) < 1:
            raise InvalidConfig("top_k, head, dim, oversample and documents must be positive")
        if self.scope not in SCOPES or self.stage2_metric not in METRICS or self.mode not in MODES:
            raise InvalidConfig("unknown scope, metric or mode")
        if not 0 < self.recall <= 1:
            raise InvalidConfig("recall must be above 0 and at most 1")
