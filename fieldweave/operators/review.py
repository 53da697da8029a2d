"""Review of a definition file against catalog and registry: neighbours, issues, recommendations and reports."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.errors import ProcessingError, ValidationError
from fieldweave.functions.declarations import parse
from fieldweave.operators import catalog, concepts as registry_ops, neighbours
from fieldweave.operators.store import FieldStore, query_texts
from fieldweave.schemas import ADVICE
from fieldweave.sources.protofiles import scan_file

#: Issue texts -> recommendations in JSON, perhaps fenced.
Adviser = Callable[[str], str]
HITS = "query_key string, rank int, id string, distance double, document string, metadata struct<field_name:string,field_type:string,message_name:string,package:string,file_path:string,label:string,fqn:string>"
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}
# A recommendation's title by kind of issue, in the order of review.
TITLES = {"naming_mismatch": "Field naming inconsistencies", "type_mismatch": "Field type mismatches", "missing_concept": "Missing canonical concepts"}


def similar_fields(records: DataFrame, store: FieldStore, path: str | None, k: int = 10) -> DataFrame:
    """The k nearest stored records by field name, without those of the reviewed file (after the ranking)."""
    hits = store.similar_to(query_texts(records), k)
    return neighbours.drop_own_file(hits, path) if path is not None else hits


def match_concepts(records: DataFrame, hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """(ord, name of concept): the first concept, by its order, that maps the field's name or the name of any of its neighbours."""
    maps = registry_ops.mappings(concepts).select(F.col("field_name").alias("mapped"), F.col("name").alias("concept"), "concept_ord").distinct()
    own = records.select("ord", F.col("field_name").alias("mapped"))
    near = records.join(hits, records["field_name"] == hits["query_key"]).select("ord", F.col("metadata.field_name").alias("mapped"))
    return own.union(near).distinct().join(maps, "mapped").groupBy("ord").agg(F.min_by("concept", "concept_ord").alias("concept"))


def _hits_by_field(hits: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", "id", "distance", "document", "metadata")))
    return hits.groupBy("query_key").agg(ranked.alias("near"))


def find_issues(records: DataFrame, hits: DataFrame, concepts: DataFrame, event_type: str, cut: float = 0.5) -> DataFrame:
    """Issues in order: for each field naming, then type; then a row for each concept that the event type lacks. Their texts are fixed values.

    Columns: ord, field_name, issue_type, severity, message, canonical_name, canonical_type, similar_fields.
    """
    known = concepts.select(F.col("name").alias("concept"), F.col("canonical_name").alias("c_name"), F.col("canonical_type").alias("c_type"), F.array_join(F.transform(F.slice("mappings", 1, 5), lambda m: m["field_name"]), ", ").alias("others"))
    base = records.join(match_concepts(records, hits, concepts), "ord", "left").join(known, "concept", "left")
    base = base.join(_hits_by_field(hits).withColumnRenamed("query_key", "field_name"), "field_name", "left")
    few, none = F.coalesce(F.slice("near", 1, 3), F.slice("near", 1, 0), F.expr("slice(array(named_struct('rank', 0, 'id', '', 'distance', 0D, 'document', '', 'metadata', cast(null as struct<field_name:string,field_type:string,message_name:string,package:string,file_path:string,label:string,fqn:string>))), 1, 0)")), F.lit("")
    empty = F.slice(few, 1, 0)

    def issue(kind, severity, message, name, type_, similar):
        return F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), message.alias("message"), name.alias("canonical_name"), type_.alias("canonical_type"), similar.alias("similar_fields"))

    matched = F.col("concept").isNotNull()
    naming = F.when(matched & (F.col("field_name") != F.col("c_name")), issue("naming_mismatch", "warning", F.format_string("Field '%s' maps to concept '%s'. Canonical name is '%s'. Other event types use: %s", "field_name", "concept", "c_name", "others"), F.col("c_name"), F.col("c_type"), few))
    typing = F.when(matched & (F.col("field_type") != F.col("c_type")), issue("type_mismatch", "error", F.format_string("Field '%s' has type '%s' but canonical type for '%s' is '%s'. This may cause downstream query issues.", "field_name", "field_type", "concept", "c_type"), F.col("c_name"), F.col("c_type"), empty))
    top = F.col("near")[0]
    alike = F.when(~matched & (F.size("near") > 0) & (F.coalesce(top["distance"], F.lit(1.0)) < cut), issue("naming_mismatch", "info", F.format_string("Field '%s' is similar to '%s' in %s (%s). Consider aligning naming for cross-schema consistency.", F.col("field_name"), top["metadata"]["field_name"], top["metadata"]["message_name"], top["metadata"]["package"]), none, none, few))
    found = base.select("ord", "field_name", F.posexplode(F.array(naming, typing, alike)).alias("check", "i")).where("i is not null").select("ord", "check", "field_name", "i.*")
    if event_type:
        found = found.unionByName(missing_concepts(records, concepts, event_type))
    order = F.row_number().over(Window.orderBy("ord", "check")) - 1  # of one file's issues
    return found.withColumn("ord", order.cast("bigint")).drop("check")


def missing_concepts(records: DataFrame, concepts: DataFrame, event_type: str) -> DataFrame:
    """Concepts that don't map the event type, share no field name with the records and don't list it as a gap."""
    there = registry_ops.mappings(concepts).join(records.select("field_name").distinct(), "field_name", "left_semi").select("name").distinct()
    types = F.array_distinct(F.transform("mappings", lambda m: m["event_type"]))
    rows = concepts.where(~F.array_contains(types, event_type) & ~F.array_contains("gaps", event_type)).join(there, "name", "left_anti")
    message = F.format_string("Event type '%s' is missing concept '%s' (%s). Other event types have: %s", F.lit(event_type), "name", "description", F.array_join(F.slice(types, 1, 3), ", "))
    similar = "array<struct<rank:int,id:string,distance:double,document:string,metadata:struct<field_name:string,field_type:string,message_name:string,package:string,file_path:string,label:string,fqn:string>>>"
    last = F.lit(2**62).cast("bigint")
    return rows.select(last.alias("ord"), F.col("concept_ord").cast("int").alias("check"), F.lit("").alias("field_name"), F.lit("missing_concept").alias("issue_type"), F.lit("warning").alias("severity"), message.alias("message"), "canonical_name", "canonical_type", F.array().cast(similar).alias("similar_fields"))


def missing_by_event_type(records: DataFrame, concepts: DataFrame) -> DataFrame:
    """(event_type, name): the concepts that missing_concepts() finds for each event type of the records, all at once.

    The grid of concepts and event types is what a registry and a catalog are there to compare; what covers a cell goes by equi-joins.
    """
    typed = records.select(catalog.event_type_key().alias("event_type"), "field_name").distinct()
    every = typed.select("event_type").distinct().agg(F.collect_list("event_type").alias("types"))  # one row; a catalog has few event types
    grid = concepts.select("name").crossJoin(F.broadcast(every)).select("name", F.explode("types").alias("event_type"))
    maps = registry_ops.mappings(concepts)
    covered = maps.select("name", "event_type").union(maps.select("name", "field_name").distinct().join(typed, "field_name").select("name", "event_type")).union(concepts.select("name", F.explode("gaps").alias("event_type")))
    return grid.join(covered.distinct(), ["name", "event_type"], "left_anti").select("event_type", "name")


def severity_rank(column="severity"):
    return F.coalesce(F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col(column)], F.lit(0))


def recommend(issues: DataFrame) -> DataFrame:
    """One recommendation for each kind of issue in the order of first appearance: ord, title, body, severity, fields.

    Kinds without a title are left out. Missing concepts name no fields.
    """
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    rows = F.array_sort(F.collect_list(F.struct("ord", "message", "field_name")))
    grouped = issues.where(F.col("issue_type").isin(*TITLES)).groupBy("issue_type").agg(F.min("ord").alias("at"), rows.alias("rows"), F.max_by("severity", severity_rank()).alias("worst"))
    fields = F.when(F.col("issue_type") == "missing_concept", F.array().cast("array<string>")).otherwise(F.transform("rows", lambda r: r["field_name"]))
    severity = F.when(F.col("issue_type") == "type_mismatch", "error").when(F.col("issue_type") == "missing_concept", "warning").otherwise(F.col("worst"))
    out = grouped.select((F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), titles[F.col("issue_type")].alias("title"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["message"])), "\n").alias("body"), severity.alias("severity"), fields.alias("fields"))
    return out


def issue_lines(issues: DataFrame) -> DataFrame:
    return issues.select("ord", F.format_string("- [%s] %s: %s", F.upper("severity"), "issue_type", "message").alias("line"))


def parse_advice(answers: DataFrame) -> DataFrame:
    """Recommendations in a model's answers (column `answer`); what isn't a JSON array gives none; severity defaults to info."""
    items = answers.select(F.posexplode(F.from_json(registry_ops.without_fence(F.col("answer")), ADVICE)).alias("ord", "r"))
    return items.select("ord", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.body", F.lit("")).alias("body"), F.coalesce("r.severity", F.lit("info")).alias("severity"), F.coalesce("r.fields", F.array().cast("array<string>")).alias("fields"))


def advise(issues: DataFrame, adviser: Adviser, path: str | None = None) -> DataFrame:
    """Recommendations from a model; none, and no call, without issues."""
    spark = issues.sparkSession
    lines = [r["line"] for r in issue_lines(issues).orderBy("ord").collect()]  # of one reviewed file
    head = f"Proto file: {path}" if path else "Unknown proto"
    said = [(adviser(head + "\n\nIssues found:\n" + "\n".join(lines) + "\n\nAnswer with a JSON array of title, body, severity, fields."),)] if lines else []
    return parse_advice(spark.createDataFrame(said, "answer string"))


def counts(issues: DataFrame) -> DataFrame:
    """issue_count, error_count, warning_count, info_count."""
    return issues.agg(F.count("*").alias("issue_count"), *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")])


def should_retry(issues: DataFrame, retries: int, most: int = 2) -> bool:
    """There are issues, all are for information only, and tries are left."""
    r = issues.agg(F.count("*").alias("n"), F.bool_and(F.col("severity") == "info").alias("mild")).first()
    return bool(r["n"] and r["mild"] and retries < most)


@dataclass
class Review:
    proto_path: str
    issues: DataFrame
    recommendations: DataFrame
    issue_count: int
    error_count: int
    warning_count: int
    info_count: int
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Give back what the review keeps in memory; its tables can still be read, at the price of a new run."""
        for df in self.cached:
            df.unpersist()


def run_review(spark: SparkSession, store: FieldStore, concepts: DataFrame, path: str | Path, adviser: Adviser | None = None, mode: str = "compat", k: int = 10, max_retries: int = 0, broaden: int = 2) -> Review:
    """Review one file. A retry, off by default, looks `broaden` times as far when every issue is for information only."""
    declared = parse(scan_file(spark, path), mode).cache()
    if bad := declared.where("error is not null").first():
        raise ValidationError("PROTO_INVALID", bad["error"], {"path": str(path)})
    records = catalog.field_records(declared).cache()
    event_type = catalog.file_event_type(declared).first()["event_type"]
    tries = 0
    while True:
        hits = similar_fields(records, store, str(path), k).cache()
        issues = find_issues(records, hits, concepts, event_type).cache()
        if not should_retry(issues, tries, max_retries):
            break
        tries, k = tries + 1, k * broaden
        issues.unpersist()
        hits.unpersist()
    recommendations = (advise(issues, adviser, str(path)) if adviser else recommend(issues)).orderBy("ord").cache()
    return Review(str(path), issues, recommendations, **counts(issues).first().asDict(), cached=(recommendations, issues, hits, records, declared))


def as_json(review: Review) -> str:
    rows = [{k: (list(r[k]) if k == "fields" else r[k]) for k in ("title", "body", "severity", "fields")} for r in review.recommendations.orderBy("ord").collect()]
    return json.dumps({"proto_path": review.proto_path} | {k: getattr(review, k) for k in ("issue_count", "error_count", "warning_count", "info_count")} | {"recommendations": rows}, indent=2)


def as_markdown(review: Review) -> str:
    marks = {"error": "!!!", "warning": "!!", "info": "!"}
    out = [f"# Proto Review: {review.proto_path}", "", f"**Issues:** {review.issue_count} ({review.error_count} errors, {review.warning_count} warnings, {review.info_count} info)", ""]
    for r in review.recommendations.orderBy("ord").collect():
        out += [f"## {marks.get(r['severity'], '')} {r['title']}", "", r["body"], *([f"\n**Fields:** {', '.join(r['fields'])}"] if r["fields"] else []), ""]
    return "\n".join(out)


def post_comment(review: Review, url: str, key: str = "", timeout: float = 60.0) -> int:
    """Send the Markdown report as a comment (`{"body": ...}`) to an endpoint, such as that of a change under review; returns its status."""
    headers = {"content-type": "application/json", **({"authorization": f"Bearer {key}"} if key else {})}
    request = urllib.request.Request(url, json.dumps({"body": as_markdown(review)}).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status
    except OSError as e:
        raise ProcessingError("COMMENT_FAILED", "the report can't be posted", {"url": url}, e) from e


def as_text(review: Review, colour: bool = False) -> str:
    codes = {"error": "31", "warning": "33", "info": "34"}
    paint = lambda s, text: f"\x1b[{codes.get(s, '37')}m{text}\x1b[0m" if colour else text
    out = [f"Review: {review.proto_path}", "", "Summary"]
    out += [f"  {name:<14}{n}" for name, n in (("Total issues", review.issue_count), ("Errors", review.error_count), ("Warnings", review.warning_count), ("Info", review.info_count))]
    for r in review.recommendations.orderBy("ord").collect():
        out += ["", paint(r["severity"], f"[{r['severity'].upper()}] {r['title']}"), r["body"], *([f"  Fields: {', '.join(r['fields'])}"] if r["fields"] else [])]
    return "\n".join(out)
