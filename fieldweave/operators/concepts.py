"""Canonical concepts: batches of fields go to a clusterer, its answers are parsed and merged, and people's overrides win."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.operators import catalog
from fieldweave.schemas import ANSWER, CONCEPT

log = logging.getLogger(__name__)

#: (lines of fields, event types) -> an answer in JSON, perhaps fenced.
Clusterer = Callable[[list[str], list[str]], str]

# What a hosted model is asked, where one is used.
INSTRUCTIONS = (
    "Group fields that mean the same into concepts. Answer with a JSON array of objects with the keys name (snake case), description, canonical_name,"
    " canonical_type, mappings (objects with event_type, field_name, field_type) and gaps (event types that lack the concept). Leave out groups of one field without gaps."
)


def prompt(lines: list[str], event_types: list[str]) -> str:
    return f"{INSTRUCTIONS}\n\nFields:\n" + "\n".join(lines) + f"\n\nEvent types: {', '.join(event_types)}"


LINE = re.compile(r"- (?P<name>\S+) \((?P<type>.*), \S+\) in (?P<event>.*) \[(?P<file>.*)\]$")


def rule_clusterer(lines: list[str], event_types: list[str]) -> str:
    """Offline default: fields whose names differ only in case, underscores and a leading mark are one concept.

    The commonest name and type are canonical, ties to the smaller; event types that lack the concept are gaps only if most have it.
    """
    groups: dict[str, list[dict]] = {}
    for m in filter(None, map(LINE.match, lines)):
        groups.setdefault(re.sub(r"[^a-z0-9]", "", m["name"].lower()) or m["name"], []).append(m.groupdict())
    out = []
    for key, fields in groups.items():
        have = {f["event"] for f in fields}
        gaps = sorted(set(event_types) - have) if 2 * len(have) > len(event_types) else []
        if len(fields) < 2 and not gaps:
            continue
        common = lambda what: min({f[what] for f in fields}, key=lambda v: (-sum(f[what] == v for f in fields), v))  # noqa: E731,B023
        snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", common("name")).lower().strip("_")
        out.append({"name": snake or key, "description": f"fields named like {common('name')}", "canonical_name": common("name"), "canonical_type": common("type"), "mappings": [{"event_type": f["event"], "field_name": f["name"], "field_type": f["type"], "file_path": f["file"]} for f in fields], "gaps": gaps})
    return json.dumps(out)


def batches(records: DataFrame, size: int = 100) -> DataFrame:
    """(batch, lines) of consecutive windows of `size` records by `ord`, which counts from 0."""
    lines = catalog.prompt_lines(records).withColumn("batch", F.floor(F.col("ord") / size))
    return lines.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))


def answers(records: DataFrame, clusterer: Clusterer = rule_clusterer, size: int = 100) -> DataFrame:
    """(batch, answer): one call for each batch, on the executors. Event types are sent whole: a catalog has few."""
    types = [r["event_type"] for r in catalog.event_types(records).collect()]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"batch": pdf["batch"], "answer": [clusterer(list(x), types) for x in pdf["lines"]]})

    return batches(records, size).repartition("batch").mapInPandas(run, "batch bigint, answer string")


def without_fence(answer: Column) -> Column:
    """The text between code fences if it begins with one: from the first line's end to the last fence."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n?", ""), r"(?s)```(?:(?!```).)*$", "")
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def parse_answers(answered: DataFrame) -> DataFrame:
    """Concepts in answers with their place (batch, nth). What isn't a JSON array of objects gives no rows; missing keys are empty."""
    items = answered.select("batch", F.posexplode(F.from_json(without_fence(F.col("answer")), ANSWER)).alias("nth", "c"))
    text = lambda c: F.coalesce(c, F.lit(""))
    mapping = lambda m: F.struct(*[text(m[k]).alias(k) for k in ("event_type", "field_name", "field_type", "file_path")])
    no_maps, no_gaps = F.array().cast(CONCEPT.split("mappings ")[1].split(", gaps")[0]), F.array().cast("array<string>")
    return items.select("batch", "nth", *[text(F.col(f"c.{k}")).alias(k) for k in ("name", "description", "canonical_name", "canonical_type")], F.coalesce(F.transform("c.mappings", mapping), no_maps).alias("mappings"), F.coalesce("c.gaps", no_gaps).alias("gaps"))


def merge_batches(parsed: DataFrame) -> DataFrame:
    """One concept for each name: texts of its first appearance, all mappings in order, all gaps once and sorted."""
    at = F.struct("batch", "nth")
    first = lambda c: F.min_by(c, at).alias(c)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("batch", "nth", "mappings"))), lambda x: x["mappings"])
    merged = parsed.groupBy("name").agg(F.min(at).alias("at"), first("description"), first("canonical_name"), first("canonical_type"), F.flatten(in_order).alias("mappings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("gaps")))).alias("gaps"))
    # A registry is small: one row for each concept.
    return merged.withColumn("concept_ord", F.row_number().over(Window.orderBy("at")).cast("bigint") - 1).select(*[c.split()[0] for c in re.split(r", (?![^<]*>)", CONCEPT)])


def build_registry(records: DataFrame, clusterer: Clusterer = rule_clusterer, size: int = 100) -> tuple[DataFrame, dict]:
    """Concepts of all records (cached; the caller releases them), and what is known about the build."""
    answered = answers(records, clusterer, size).cache()  # a model is asked once for each batch
    parsed = F.from_json(without_fence(F.col("answer")), ANSWER)
    for r in answered.where(parsed.isNull()).select("batch", F.substring("answer", 1, 200).alias("start")).orderBy("batch").take(20):
        log.warning("batch %d: the answer is no JSON array and gives no concepts: %s", r["batch"], r["start"])
    concepts = merge_batches(parse_answers(answered)).cache()
    meta = {"build_date": datetime.now(timezone.utc).isoformat(), "total_fields": records.count(), "total_event_types": catalog.event_types(records).count(), "total_concepts": concepts.count()}
    answered.unpersist()
    log.info("registry of %d concepts from %d fields", meta["total_concepts"], meta["total_fields"])
    return concepts, meta


def merge_overrides(concepts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides replace concepts of their name whole, in their place; others follow at the end in their own order."""
    places = concepts.select("name", F.col("concept_ord").alias("_place"))
    last = concepts.agg(F.coalesce(F.max("concept_ord") + 1, F.lit(0)).alias("_next"))
    won = overrides.join(places, "name", "left").crossJoin(F.broadcast(last)).withColumn("concept_ord", F.coalesce("_place", F.col("_next") + F.col("concept_ord"))).drop("_place", "_next")
    return concepts.join(overrides.select("name"), "name", "left_anti").unionByName(won)


def mappings(concepts: DataFrame) -> DataFrame:
    """One row for each mapping: name, concept_ord, map_ord and the mapping's parts."""
    return concepts.select("name", "concept_ord", F.posexplode("mappings").alias("map_ord", "m")).select("name", "concept_ord", "map_ord", "m.*")


def as_records(concepts: DataFrame) -> DataFrame:
    """Concepts as field records, to be stored and found beside real fields."""
    return concepts.select(F.col("canonical_name").alias("field_name"), F.col("canonical_type").alias("field_type"), F.lit("CanonicalRegistry").alias("message_name"), F.lit("canonical").alias("package"), F.lit("canonical_registry").alias("file_path"), F.lit("canonical").alias("label"), F.col("description").alias("comment"), F.array().cast("array<string>").alias("parent_messages"), F.col("concept_ord").alias("ord"))
