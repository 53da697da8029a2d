"""The field store: versioned Parquet with upserts by id and nearest-neighbour queries.

A write makes a new version folder and then moves the pointer file, so readers of the old version go on and a failed write leaves nothing
half done. The version before the current one stays, for readers that are under way; older ones are deleted. A write that finds
another one done since it began is refused. Documents whose text is unchanged keep their vectors.
"""

from __future__ import annotations

import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.errors import DataAccessError
from fieldweave.operators import catalog, neighbours
from fieldweave.operators.embedding import Embedder, hashed_ngrams, with_embeddings
from fieldweave.schemas import FIELD_DOC
from fieldweave.sources.folders import Folder

POINTER = "CURRENT"
log = logging.getLogger(__name__)


class FieldStore:
    """Field documents at a folder, by path or URI, that driver and executors share; opened or made."""

    def __init__(self, spark: SparkSession, folder: str | Path, embedder: Embedder = hashed_ngrams):
        self.spark, self.embedder = spark, embedder
        try:
            self.folder = Folder(spark, str(folder))
            self.folder.make()
        except Exception as e:
            raise DataAccessError("STORE_INIT_ERROR", f"can't open the store: {e}", {"folder": str(folder)}, e) from e

    def documents(self) -> DataFrame:
        """id, document, metadata, embedding of all records."""
        return self._read(self._versions())

    def _versions(self) -> list[str]:
        """The current version, and the one before it."""
        return self.folder.read(POINTER).split() if self.folder.exists(POINTER) else []

    def _read(self, versions: list[str]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], FIELD_DOC)
        return self.spark.read.schema(FIELD_DOC).parquet(f"{self.folder.uri}/{versions[0]}")

    def _replace(self, df: DataFrame, since: list[str]) -> None:
        """Make `df` the current version, if the versions still are those in `since`."""
        version = f"v-{uuid.uuid4().hex}"
        df.select("id", "document", "metadata", "embedding").write.parquet(f"{self.folder.uri}/{version}")
        if self._versions() != since:
            self.folder.delete(version)
            raise DataAccessError("STORE_CONFLICT", "another write was done meanwhile; try again", {"folder": self.folder.uri})
        self.folder.replace(POINTER, "\n".join([version, *since[:1]]))
        for old in since[1:]:
            self.folder.delete(old)

    def upsert(self, records: DataFrame, prune: bool = False) -> int:
        """Insert or replace by id; returns the number of records given, ids that occur twice included.

        Of equal ids the last by `ord` wins. Stored ids that aren't given stay, unless `prune`.
        """
        given, distinct = records.select(F.count("*"), F.count_distinct(catalog.document_id())).first()
        if not given:
            return 0
        if given > distinct:
            log.warning("%d of %d records share an id with another; the last of each stays", given - distinct, given)
        new = catalog.field_documents(records).groupBy("id").agg(F.max_by(F.struct("document", "metadata"), "ord").alias("x")).select("id", "x.document", "x.metadata")
        since = self._versions()
        old = self._read(since)
        same = old.select("id", "document", "embedding")
        known = new.join(same, ["id", "document"]).select("id", "document", "metadata", "embedding")
        fresh = with_embeddings(new.join(same, ["id", "document"], "left_anti").select("id", "document", "metadata"), "document", self.embedder)
        out = known.unionByName(fresh)
        if not prune:
            out = out.unionByName(old.join(new, "id", "left_anti"))
        self._replace(out, since)
        return given

    def clear(self) -> None:
        self._replace(self.spark.createDataFrame([], FIELD_DOC), self._versions())

    def count(self) -> int:
        return self.documents().count()

    def all_fields(self) -> DataFrame:
        return self.documents().select("id", "document", "metadata")

    def similar_to(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k nearest records to each row (query_key, query_text): query_key, rank, id, distance, document, metadata."""
        vectors = with_embeddings(queries.select("query_key", "query_text"), "query_text", self.embedder)
        return neighbours.top_k(vectors, self.documents(), k, carry=("document", "metadata"))

    def similar_fields(self, name: str, kind: str | None = None, k: int = 10) -> DataFrame:
        text = f"{name} ({kind})" if kind else name
        return self.similar_to(self.spark.createDataFrame([(name, text)], "query_key string, query_text string"), k).orderBy("rank")

    def by_concept(self, concept: str, k: int = 20) -> DataFrame:
        return self.similar_fields(concept, k=k)


def query_texts(records: DataFrame) -> DataFrame:
    """`name (type)` of each field. Of fields that share a name, the last one's text stands for all."""
    return records.groupBy(F.col("field_name").alias("query_key")).agg(F.max_by(F.concat("field_name", F.lit(" ("), "field_type", F.lit(")")), "ord").alias("query_text"))
