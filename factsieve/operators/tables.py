"""The relations of a set of pages (or scopes), derived on demand and stored while several operators read them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.operators import images as I
from factsieve.operators import page as P
from factsieve.operators import structured as S
from factsieve.sources.staging import bucketed


class PageTables:
    """Lazily derived page relations over staged element rows.

    ``pages(page_id, url, final_url, ...)`` locates the pages, ``nodes`` are element rows with a
    ``scope_id``. Tables several generators read are written once, bucketed by page, on first use; all have ``buckets`` buckets.
    """

    def __init__(self, pages: DataFrame, nodes: DataFrame, bases: DataFrame | None = None, warnings: DataFrame | None = None, buckets: int | None = None):
        self.pages, self.nodes, self.buckets = pages, nodes, buckets
        self.warnings = warnings if warnings is not None else pages.select("page_id", F.lit(None).cast("string").alias("message")).limit(0)
        self.bases = bases if bases is not None else bucketed(P.base_urls(pages, nodes), "page_id", buckets=buckets)

    def _hold(self, frame: DataFrame) -> DataFrame:
        return bucketed(frame, "page_id", placed=True, buckets=self.buckets)

    @cached_property
    def meta(self) -> DataFrame:
        return P.page_meta(self.nodes)

    @cached_property
    def titles(self) -> DataFrame:
        return P.page_title(self.nodes)

    @cached_property
    def entries(self) -> DataFrame:
        # Most repeated blocks carry no structured data: look before planning seven levels of it.
        if S.structured_nodes(self.nodes).isEmpty():
            return self.nodes.sparkSession.createDataFrame([], S.ENTRY_DDL)
        return self._hold(S.page_entries(self.nodes))

    @cached_property
    def blocks(self) -> DataFrame:
        return self._hold(P.blocks(self.nodes))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._hold(P.pairs(self.nodes, self.blocks))

    @cached_property
    def links(self) -> DataFrame:
        return self._hold(P.page_links(self.nodes, self.bases))

    @cached_property
    def texts(self) -> DataFrame:
        return P.page_text(self.blocks, self.nodes)

    @cached_property
    def kept_texts(self) -> DataFrame:
        """The texts, written once: for the tests of pages, each of which reads them."""
        return self._hold(self.texts)

    @cached_property
    def chrome(self) -> DataFrame:
        return P.boilerplate_text(self.nodes)

    @cached_property
    def images(self) -> DataFrame:
        return self._hold(I.harvest_images(self.nodes, self.bases, self.meta, self.entries))

    @cached_property
    def digests(self) -> DataFrame:
        return P.page_digest(self.titles, self.meta, self.pairs, self.texts)
