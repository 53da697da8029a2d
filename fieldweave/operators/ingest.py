"""From a folder of definition files to a searchable store."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from fieldweave.functions.declarations import parse
from fieldweave.operators import catalog
from fieldweave.operators.store import FieldStore
from fieldweave.sources.protofiles import scan_folder


log = logging.getLogger(__name__)


@dataclass
class Ingested:
    """Files parsed, fields given to the store, and all files that couldn't be read, by path: one entry for each reaches the driver."""

    total_files: int = 0
    total_fields: int = 0
    errors: list[dict] = field(default_factory=list)


def ingest(spark: SparkSession, folder: str | Path, store: FieldStore, mode: str = "compat", prune: bool = False) -> Ingested:
    """Parse all files and upsert their fields; a second run changes nothing."""
    declared = parse(scan_folder(spark, folder), mode).cache()
    given = store.upsert(catalog.field_records(declared), prune)
    errors = [r.asDict() for r in catalog.parse_errors(declared).orderBy("file_path").collect()]
    for e in errors:
        log.warning("%s can't be read: %s", e["file_path"], e["error"])
    out = Ingested(catalog.parsed_files(declared).count(), given, errors)
    declared.unpersist()
    return out
