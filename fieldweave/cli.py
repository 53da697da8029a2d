"""Command line: ingest, build-registry, review, export-registry."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from fieldweave import config
from fieldweave.errors import FieldweaveError
from fieldweave.functions.declarations import parse
from fieldweave.operators import catalog, concepts, models, review
from fieldweave.operators.ingest import ingest
from fieldweave.operators.store import FieldStore
from fieldweave.sources import protofiles, registry_files

REGISTRY = "canonical_fields.yaml"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fieldweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "build-registry"):
        c = sub.add_parser(name)
        c.add_argument("--proto-dir", type=Path)
        c.add_argument("--mode", choices=("compat", "strict"), default="compat")
        if name == "build-registry":
            c.add_argument("--output", type=Path)
            c.add_argument("--model", help="name of a registered clusterer or of a hosted model")
            c.add_argument("--overrides", type=Path)
    c = sub.add_parser("review")
    c.add_argument("proto_path", type=Path)
    c.add_argument("--format", choices=("terminal", "markdown", "json"), default="terminal")
    c.add_argument("--model", help="name of a registered adviser or of a hosted model; without it, rules recommend")
    c.add_argument("--mode", choices=("compat", "strict"), default="compat")
    c.add_argument("--fail-on", choices=("error", "warning", "info"))
    c = sub.add_parser("export-registry")
    c.add_argument("--format", choices=("yaml", "json"), default="yaml")
    c.add_argument("--output", type=Path)
    return p


#: Models by name: clusterers (lines, event types) -> JSON, and advisers text -> JSON. Other names are those of hosted models.
CLUSTERERS = {"rules": concepts.rule_clusterer}
ADVISERS: dict[str, review.Adviser] = {}


def _named(table: dict, name: str, hosted):
    return table[name] if name in table else hosted(models.ChatModel(config.model_url(), name, config.api_key()))


def _store(spark: SparkSession) -> FieldStore:
    folder = config.embedder_dir()
    return FieldStore(spark, config.store_dir(), models.SentenceEmbedder(str(folder))) if folder else FieldStore(spark, config.store_dir())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fieldweave").getOrCreate()
    try:
        return {"ingest": _ingest, "build-registry": _build, "review": _review, "export-registry": _export}[args.command](spark, args)
    except FieldweaveError as e:
        print(e, file=sys.stderr)
        return 2


def _ingest(spark, args) -> int:
    r = ingest(spark, args.proto_dir or config.proto_dir(), _store(spark), args.mode)
    print(f"Ingested {r.total_fields} fields from {r.total_files} files")
    return 0


def _build(spark, args) -> int:
    folder, output = args.proto_dir or config.proto_dir(), args.output or config.registry_dir() / REGISTRY
    declared = parse(protofiles.scan_folder(spark, folder), args.mode).cache()  # read and parsed once
    records = catalog.field_records(declared).cache()
    print(f"Parsed {catalog.parsed_files(declared).count()} proto files, {records.count()} fields")
    store = _store(spark)
    store.upsert(records)
    built, _ = concepts.build_registry(records, _named(CLUSTERERS, args.model or config.default_model(), models.ChatClusterer))
    overrides = registry_files.read_overrides(spark, args.overrides) if args.overrides else None
    found = built if overrides is None else concepts.merge_overrides(built, overrides)
    n = registry_files.write_registry(found, output)
    store.upsert(concepts.as_records(found))
    print(f"Registry built: {n} concepts -> {output}")
    for used in (built, records, declared):
        used.unpersist()
    return 0


def _review(spark, args) -> int:
    path = config.registry_dir() / REGISTRY
    if path.exists():
        known = registry_files.read_registry(spark, path)
    else:
        from fieldweave.schemas import CONCEPT

        print("Warning: no canonical registry found; run build-registry first.")
        known = spark.createDataFrame([], CONCEPT)
    r = review.run_review(spark, _store(spark), known, args.proto_path, _named(ADVISERS, args.model, models.ChatAdviser) if args.model else None, args.mode)
    print({"terminal": lambda x: review.as_text(x, sys.stdout.isatty()), "markdown": review.as_markdown, "json": review.as_json}[args.format](r))
    r.release()
    bad = {"error": r.error_count, "warning": r.error_count + r.warning_count, "info": r.issue_count}
    return 1 if args.fail_on and bad[args.fail_on] else 0


def _export(spark, args) -> int:
    path = config.registry_dir() / REGISTRY
    if not path.exists():
        print("No registry found; run build-registry first.", file=sys.stderr)
        return 1
    output = args.output or config.registry_dir() / f"canonical_fields.{args.format}"
    print(f"Exported {registry_files.write_registry(registry_files.read_registry(spark, path), output, args.format)} concepts to {output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
