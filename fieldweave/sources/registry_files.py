"""Registries as YAML or JSON files. They are small and written for people, so the driver reads and writes them."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from fieldweave.errors import DataAccessError, ValidationError
from fieldweave.schemas import CONCEPT


def _concepts(spark: SparkSession, entries: dict) -> DataFrame:
    rows = []
    for order, (name, entry) in enumerate(entries.items()):
        entry = entry or {}
        maps = [tuple(m.get(k, "") or "" for k in ("event_type", "field_name", "field_type", "file_path")) for m in entry.get("mappings") or []]
        rows.append((str(name), order, *(entry.get(k, "") or "" for k in ("description", "canonical_name", "canonical_type")), maps, list(entry.get("gaps") or [])))
    return spark.createDataFrame(rows, CONCEPT)


def read_registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """Concepts of a registry file in its order; missing keys are empty."""
    path = Path(path)
    if not path.exists():
        raise DataAccessError("REGISTRY_NOT_FOUND", f"no registry at {path}", {"path": str(path)})
    return _concepts(spark, _entries(path))


def _entries(path: Path) -> dict:
    try:
        entries = yaml.safe_load(path.read_text(encoding="utf-8"))  # JSON is YAML too
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ValidationError("INVALID_YAML", f"can't parse {path}", {"path": str(path)}, e) from e
    if not isinstance(entries, dict) or not all(isinstance(e or {}, dict) for e in entries.values()):
        raise ValidationError("INVALID_REGISTRY_FORMAT", "a registry maps concept names to definitions", {"path": str(path)})
    return entries


def read_overrides(spark: SparkSession, path: str | Path) -> DataFrame | None:
    """Concepts of an override file; None if there is none or it is empty."""
    path = Path(path)
    if not path.exists() or not path.read_bytes().strip():
        return None
    return _concepts(spark, entries) if (entries := _entries(path)) else None


def write_registry(concepts: DataFrame, path: str | Path, format: str = "yaml") -> int:
    """Write concepts sorted by name, without the files of their mappings; returns how many."""
    path = Path(path)
    entries = {}
    for r in concepts.orderBy("name").collect():
        maps = [{k: m[k] for k in ("event_type", "field_name", "field_type")} for m in r["mappings"]]
        entries[r["name"]] = {k: r[k] for k in ("description", "canonical_name", "canonical_type")} | {"mappings": maps, "gaps": list(r["gaps"])}
    path.parent.mkdir(parents=True, exist_ok=True)
    if format not in ("yaml", "json"):
        raise ValidationError("INVALID_FORMAT", f"a registry is written as yaml or json, not {format}", {"format": format})
    text = json.dumps(entries, indent=2) if format == "json" else yaml.dump(entries, default_flow_style=False, sort_keys=False, allow_unicode=True)
    try:
        path.write_text(text, encoding="utf-8")
    except OSError as e:
        raise DataAccessError("EXPORT_ERROR", f"can't write {path}", {"path": str(path)}, e) from e
    return len(entries)
