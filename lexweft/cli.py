"""Command line: python -m lexweft.cli --reference-dir ... --query-dir ... --output-dir ..."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .config import METRICS, MODES, SCOPES, Config
from .operators.embed import HashingProvider, HttpProvider
from .plans.engine import AlignmentEngine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--reference-dir", required=True)
    p.add_argument("--query-dir", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--cache-dir")
    p.add_argument("--endpoint", help="embedding service; without it vectors are hashed from words")
    p.add_argument("--threshold", type=float, default=0.01)
    p.add_argument("--apply-threshold", action="store_true")
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--dim", type=int, default=256)
    p.add_argument("--scope", choices=SCOPES, default=SCOPES[0])
    p.add_argument("--stage2-metric", choices=METRICS, default=METRICS[0])
    p.add_argument("--mode", choices=MODES, default=MODES[0])
    p.add_argument("--index-dir", help="folder of a vector index for stage 2; without it the search is exact")
    p.add_argument("--recall", type=float, default=0.95, help="what share of the nearest a search through the index is fitted to find; 1 is exact")
    p.add_argument("--head", type=int, default=10, help="leading blocks and elements that stage 1 compares")
    p.add_argument("--oversample", type=int, default=2)
    p.add_argument("--strip-suffix", action="store_true", help="leave _processed out of names that are compared")
    p.add_argument("--requests-per-second", type=float, help="most requests a second that a task makes to the endpoint")
    p.add_argument("--large-files", action="store_true", help="read JSON files by byte ranges, whatever their size")
    p.add_argument("--documents", type=int, help="documents that a report ranks, found without all pairs; all by default")
    p.add_argument("--clear-cache", action="store_true", help="start without the kept embeddings and the index")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO)
    config = Config(a.reference_dir, a.query_dir, a.output_dir, a.cache_dir, a.threshold, a.apply_threshold, a.top_k, a.head, a.dim, oversample=a.oversample, strip_suffix=a.strip_suffix, recall=a.recall, large_files=a.large_files, documents=a.documents, scope=a.scope, stage2_metric=a.stage2_metric, mode=a.mode, index_dir=a.index_dir)
    engine = AlignmentEngine(SparkSession.builder.getOrCreate(), config, HttpProvider(a.endpoint, per_second=a.requests_per_second) if a.endpoint else HashingProvider(a.dim))
    if a.clear_cache:
        engine.clear_cache()
    engine.run()
    engine.release()


if __name__ == "__main__":
    main()
