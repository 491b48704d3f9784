"""The alignment engine: sources, embeddings, ranking, alignment and reports as one set of plans."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InvalidConfig, NoQueryDocuments, NoReferenceDocuments
from ..functions import vectors
from ..operators import align, rank
from ..operators.embed import FAILURES, CachedProvider, EmbeddingProvider, HashingProvider, observed, outcome
from ..operators.index import VectorIndex
from ..operators.numbering import numbered
from ..operators.shared import Tables
from ..operators.sizes import size_statistics
from ..sources import documents, reports
from . import report

log = logging.getLogger(__name__)


class AlignmentEngine:
    """Aligns query documents with reference documents.

    Every text is embedded once; both stages and all query documents run in the same plans. Vectors are cut to
    config.dim and must have that many components at least.
    """

    def __init__(self, spark: SparkSession, config: Config, provider: EmbeddingProvider | None = None):
        self.spark, self.config = spark, config
        provider = provider or HashingProvider(config.dim)
        self.provider = CachedProvider(provider, config.cache_dir) if config.cache_dir else provider
        self._tables = Tables()
        self._index: tuple[DataFrame, VectorIndex] | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` as a table until ``release``, unless it is held already."""
        return df if Tables.holds(df) else self._tables.cut(df)

    @property
    def _kept(self) -> list:
        """Tables that are there until ``release``."""
        return self._tables._made

    def release(self) -> None:
        """Deletes what ``parts`` keeps for reports, which can't be read any more then."""
        self._tables.clear()
        if self._index:
            self._index[1].release()

    def prepared(self, df: DataFrame, role: str, what: str) -> DataFrame:
        """``embedded`` rows, kept until ``release``; logs outcomes by kind of failure and text sizes.

        The counts come from the pass that embeds and keeps the rows, not from one of their own.
        """
        seen = Observation()
        out = self._keep(self.embedded(df, role, seen))
        n = {k: v for k, v in observed(seen).items() if v}
        log.info("%s: %d embedded, %d failed%s", what, n.get("n_ok", 0), n.get("n_failed", 0), "".join(f", {k} {n[k]}" for k in FAILURES if k in n))
        if n.get("n_failed") and not n.get("n_ok"):
            log.warning("%s: all embeddings are zero", what)
        sizes = size_statistics(out.where("pos is not null").withColumn("_all", F.lit(0)), "_all").first()
        if sizes:
            log.info("%s: text sizes from %d to %d bytes, median %d", what, sizes["min_size"] or 0, sizes["max_size"] or 0, sizes["median_size"] or 0)
        return out

    def indexed(self, elements: DataFrame) -> VectorIndex:
        """The index in config.index_dir with these elements as points 1, 2, ... by (ref_id, pos).

        An index that is there stays, and points with the same numbers are replaced. The same elements are put in once.
        """
        if self._index and self._index[0].sameSemantics(elements):
            return self._index[1]
        index = VectorIndex(self.spark, self.config.index_dir, self.config.dim, self.config.stage2_metric)
        points = numbered(elements.where("pos is not null").select("ref_id", "pos", "vec"), ["ref_id", "pos"], "n")
        index.upsert(points.withColumn("point_id", F.col("n") + 1))
        self._index = elements, index
        return index

    def _near(self, blocks: DataFrame, elements: DataFrame, best: DataFrame) -> DataFrame:
        config = self.config
        if config.scope != "corpus":
            return align.neighbours_in_best(blocks, elements, best, config)
        if not config.index_dir:
            return align.neighbours(blocks, elements, config)
        return self.indexed(elements).search(blocks, config.oversample * config.top_k, config.recall, config.digits)

    def embedded(self, df: DataFrame, role: str, seen: Observation | None = None) -> DataFrame:
        """Adds vec, cut to dim; rows of empty documents keep a null one. ``seen`` gets the outcomes."""
        full = df.where("pos is not null")
        made = self.provider.answer(full, role)
        made = (made.observe(seen, *outcome()) if seen else made).drop("failure")
        made = made.withColumn("vec", F.when(F.size("vec") >= self.config.dim, vectors.truncate(F.col("vec"), self.config.dim)).otherwise(F.raise_error(F.lit(f"an embedding has under {self.config.dim} components"))))
        return made.unionByName(df.where("pos is null").withColumn("vec", F.lit(None).cast("array<double>")))

    def parts(self, blocks: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
        """What reports are made of, as rows: ``report.build`` and ``report.lines`` take it. It is kept until ``release``."""
        config = self.config
        blocks, elements = self._keep(blocks), self._keep(elements)
        if elements.isEmpty():
            raise NoReferenceDocuments("no reference documents")
        if blocks.isEmpty():
            raise NoQueryDocuments("no query documents")
        full_blocks, full_elements = blocks.where("pos is not null"), elements.where("pos is not null")
        if config.documents:
            scores, pooled = map(self._keep, rank.top_documents(blocks, elements, config, config.documents, tables=self._tables))
        else:
            pooled = self._keep(rank.max_pool(full_blocks, full_elements, config))
            scores = self._keep(rank.document_scores(blocks, elements, config, pooled))
        best = rank.best_documents(scores)
        near = self._near(full_blocks, full_elements, best)
        found = align.hits(near, full_blocks, full_elements, best, config)
        top = self._keep(align.top_hits(found, full_elements, config))
        stats = self._keep(align.statistics(top, blocks, elements, best, config))
        return {"scores": scores, "pooled": pooled, "top": top, "found": align.top_phrases(top, config), "stats": stats, "blocks": blocks, "elements": elements}

    def align(self, blocks: DataFrame, elements: DataFrame) -> DataFrame:
        """Reports for embedded ``blocks`` (query_id, pos, block_id, text, vec) and ``elements`` (ref_id, pos, element_id, text, vec)."""
        return report.build(**self.parts(blocks, elements), config=self.config)

    def run(self) -> DataFrame:
        """Reads both folders, aligns, writes one JSON file for each query document and the log of all, and returns the reports.

        The files are written from rows. The nested reports returned are built when they are read, from what is kept
        until ``release``.
        """
        config = self.config
        if not config.output_dir:
            raise InvalidConfig("no output folder")
        elements = self.prepared(documents.read_reference(self.spark, config.reference_dir, large=config.large_files), "document", "elements")
        blocks = self.prepared(documents.read_queries(self.spark, config.query_dir, large=config.large_files), "query", "blocks")
        made = self.parts(blocks, elements)
        reports.write_files(report.lines(**made, config=config), config.output_dir)
        reports.log_statistics(report.log_lines(made["scores"], made["stats"]), f"{config.output_dir.rstrip('/')}/_statistics")
        return report.build(**made, config=config)

    def clear_cache(self) -> None:
        """Deletes kept embeddings and the index."""
        if isinstance(self.provider, CachedProvider):
            self.provider.clear(self.spark)
        if self.config.index_dir:
            VectorIndex(self.spark, self.config.index_dir, self.config.dim, self.config.stage2_metric).clear()
