"""Queries over the driver's tables, one for each operator or group of operators, and their SQL equivalents.

A table stands for an event type and a column for a field; small registries are given as values.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.functions.declarations import parse
from fieldweave.operators import catalog, concepts, neighbours, quality_checks as checks, review, store as store_ops
from fieldweave.operators.positions import with_positions
from fieldweave.operators.store import FieldStore
from fieldweave.schemas import CONCEPT, PROTO_FILE
from fieldweave.sources import registry_files
from fieldweave.sources.folders import Folder
from fieldweave.streaming import streams

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.records_of_tables(spark, {t: read(spark, sf_dir, t) for t in TABLES})


# The same catalog in SQL, and a registry with deliberate conflicts, as both sides see it.
_COLUMNS = f"""SELECT table_name AS message_name, column_name AS field_name, ordinal_position AS place,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS field_type
  FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})"""
REGISTRY = [
    ("text_body", 0, "what was said", "text", "string", [("tables/documents", "text", "string", ""), ("tables/benchmark", "text", "string", ""), ("tables/pages", "html", "string", "")], ["tables/region"]),
    ("document_key", 1, "which document", "document_id", "bigint", [("tables/documents", "doc_id", "bigint", ""), ("tables/labels", "doc_id", "bigint", "")], []),
    ("quantity", 2, "how much", "value", "int", [("tables/events", "value", "double", ""), ("tables/lineitem", "l_quantity", "double", "")], ["tables/nation", "tables/events"]),
    ("late_text", 3, "never reached by text", "html", "string", [("tables/pages", "text", "string", ""), ("tables/pages", "url", "string", "")], []),
]
_MAPPINGS = "SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', {c[1]}, '{c[3]}', '{c[4]}', '{m[0]}', '{m[1]}', {i})" for c in REGISTRY for i, m in enumerate(c[5])) + ") t(concept, concept_ord, canonical_name, canonical_type, event_type, field_name, map_ord)"
_GAPS = "SELECT * FROM (VALUES " + ", ".join(f"('{c[0]}', '{g}')" for c in REGISTRY for g in c[6]) + ") t(concept, event_type)"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, CONCEPT)


# --- Sources, parsing and flattening -----------------------------------------------------------------------------------------------


@query(_COLUMNS.replace("SELECT table_name", "SELECT 'tables' AS package, table_name || '.parquet' AS file_path, table_name", 1))
def catalog_fields(spark, sf_dir):
    r = table_records(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("message_name").orderBy("ord"))
    return r.select("package", "file_path", "message_name", "field_name", place.alias("place"), "field_type")


PROTO_TYPES = {"bigint": "int64", "int": "int32", "string": "string", "double": "double", "timestamp_ntz": "google.protobuf.Timestamp", "array<float>": "float"}


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's columns as a definition file."""
    files = []
    for i, t in enumerate(TABLES):
        lines = [f"  {'repeated ' if f.dataType.simpleString().startswith('array') else ''}{PROTO_TYPES[f.dataType.simpleString()]} {f.name} = {k};  // column {k}" for k, f in enumerate(read(spark, sf_dir, t).schema.fields, 1)]
        files.append((i, f"{t}.proto", "\n".join(['syntax = "proto3";', f"package tables.{t[0]};", 'import "google/protobuf/timestamp.proto";', f"message {t} {{", *lines, "  message Key {", "    int64 id = 1;", "  }", "}", "enum State {", "  NEW = 0;", "}", "service Lookup {", f"  rpc Get (Key) returns ({t});", "}"]), None))
    return spark.createDataFrame(files, PROTO_FILE)


_AS_PROTO = "CASE field_type WHEN 'bigint' THEN 'int64' WHEN 'int' THEN 'int32' WHEN 'timestamp_ntz' THEN 'google.protobuf.Timestamp' WHEN 'array<float>' THEN 'float' ELSE field_type END"


@query(
    f"""WITH c AS ({_COLUMNS}) SELECT message_name || '.proto' AS file_path, 'tables.' || message_name[1] AS package, message_name, field_name, {_AS_PROTO} AS field_type, CASE field_type WHEN 'array<float>' THEN 'repeated' ELSE 'optional' END AS label, 'column ' || place AS comment, field_name AS fqn FROM c
    UNION ALL SELECT DISTINCT message_name || '.proto', 'tables.' || message_name[1], 'Key', 'id', 'int64', 'optional', '', 'Key.id' FROM c"""
)
def parsed_definitions(spark, sf_dir):
    records = catalog.field_records(parse(_definitions(spark, sf_dir)))
    return records.select("file_path", "package", "message_name", "field_name", "field_type", "label", "comment", catalog.qualified_name().alias("fqn"))


@query(f"WITH c AS ({_COLUMNS}) SELECT kind, count(*) AS n FROM (SELECT DISTINCT message_name, unnest(['file', 'message', 'message ', 'enum', 'service']) AS kind_ FROM c) t, LATERAL (SELECT trim(kind_) AS kind) GROUP BY kind UNION ALL SELECT 'field', count(*) + (SELECT count(DISTINCT message_name) FROM c) FROM c")
def parsed_kinds(spark, sf_dir):
    return parse(_definitions(spark, sf_dir), "strict").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({_COLUMNS}) SELECT DISTINCT message_name || '.proto' AS file_path, 'tables.' || message_name[1] || '/' || message_name AS event_type FROM c")
def file_event_types(spark, sf_dir):
    return catalog.file_event_type(parse(_definitions(spark, sf_dir)))


# Definition files made of the rows of `part`, in the three kinds of line ends. They hold what the parser knows: headers, comments before and
# behind, nested messages, maps, a oneof, an enum, a service.
_EOL = ["\n", "\r\n", "\r"]


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    lines = [
        F.when(k % 2 == 0, 'syntax = "proto3";'), text("package shop.p", k % 7, ";"), text('import "a', k % 3, '.proto";'), F.when(k % 5 == 0, 'import "b.proto";'), F.lit(""),
        text("// part ", k), text("message Part", k, " {"), F.lit("  // its size"), text("  int32 size = ", size, ";"), text("  string name = 2; // called ", k), F.lit("  // not this"), F.lit("  option deprecated = true;"),
        F.lit("  map<string, int64> stock = 3;"), F.lit("  oneof choice {"), F.lit("    string brand = 4;"), F.lit("    int32 code = 5; // coded"), F.lit("  }"), F.lit("  message Box {"), F.lit("    message Lid {"), F.lit("      required bool open = 1;"), F.lit("    }"),
        F.lit("    double wide = 2;"), F.lit("  }"), F.lit("  enum Kind {"), F.lit("    SMALL = 0;"), text("    LARGE = -", size, ";"), F.lit("  }"), F.lit("  repeated string tags = 6;"), F.lit("}"),
        text("service Shop", k, " {"), text("  rpc Find (Part", k, ") returns (Box);"), F.lit("}"),
    ]
    eol = F.element_at(F.array(*map(F.lit, _EOL)), (k % 3 + 1).cast("int"))
    content = F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\x01")
    return read(spark, sf_dir, "part").select(k.cast("bigint").alias("file_ord"), text("part", k, ".proto").alias("file_path"), F.replace(content, F.lit("\x01"), eol).alias("content"), F.lit(None).cast("string").alias("error"))


_PART_FIELDS = """SELECT 'part' || p_partkey || '.proto' AS file_path, replace(m, '#', p_partkey::VARCHAR) AS message_name, f AS field_name, t AS field_type, CASE f WHEN 'size' THEN p_size ELSE n END::BIGINT AS number, l AS label,
    replace(c, '#', p_partkey::VARCHAR) AS comment, q AS fqn FROM part, (VALUES ('Part#', 'size', 'int32', 0, 'optional', 'its size', 'size'), ('Part#', 'name', 'string', 2, 'optional', 'called #', 'name'), ('Part#', 'stock', 'map<string, int64>', 3, 'optional', 'not this', 'stock'),
    ('Part#', 'brand', 'string', 4, 'optional', '', 'brand'), ('Part#', 'code', 'int32', 5, 'optional', 'coded', 'code'), ('Lid', 'open', 'bool', 1, 'required', '', 'Box.Lid.open'), ('Box', 'wide', 'double', 2, 'optional', '', 'Box.wide'), ('Part#', 'tags', 'string', 6, 'repeated', '', 'tags')) v(m, f, t, n, l, c, q)"""


def _part_fields(spark, sf_dir, mode):
    fields = parse(_part_files(spark, sf_dir), mode).where("kind = 'field'")
    fqn = F.concat_ws(".", "parents", "name")
    return fields.select("file_path", "message_name", F.col("name").alias("field_name"), F.col("type").alias("field_type"), "number", "label", "comment", fqn.alias("fqn"))


@query(_PART_FIELDS)
def part_fields(spark, sf_dir):
    """Line ends, braces, fields, maps, oneofs, comments before and behind."""
    return _part_fields(spark, sf_dir, "compat")


@query(_PART_FIELDS.replace("'not this'", "''"))
def part_fields_strict(spark, sf_dir):
    """The same from tokens, where a comment before an option is the option's."""
    return _part_fields(spark, sf_dir, "strict")


@query("SELECT 'part' || p_partkey || '.proto' AS file_path, CASE WHEN p_partkey % 2 = 0 THEN 'proto3' ELSE 'proto2' END AS syntax, 'shop.p' || (p_partkey % 7) AS package, 'a' || (p_partkey % 3) || '.proto' || CASE WHEN p_partkey % 5 = 0 THEN ',b.proto' ELSE '' END AS imports FROM part")
def file_headers(spark, sf_dir):
    """Syntax, package and imports."""
    return parse(_part_files(spark, sf_dir)).where("kind = 'file'").select("file_path", "syntax", "package", F.array_join("imports", ",").alias("imports"))


@query("SELECT 'part' || p_partkey || '.proto' AS file_path, replace(m, '#', p_partkey::VARCHAR) AS name, CASE m WHEN 'Part#' THEN 'part ' || p_partkey ELSE '' END AS comment, o::INT AS msg_ord FROM part, (VALUES ('Part#', 0), ('Box', 1), ('Lid', 2)) v(m, o)")
def message_rows(spark, sf_dir):
    """Messages in order, with the comment before them."""
    return parse(_part_files(spark, sf_dir)).where("kind = 'message'").select("file_path", "name", "comment", "msg_ord")


@query("SELECT 'part' || p_partkey || '.proto' AS file_path, 'Part' || p_partkey AS message_name, n AS name, CASE n WHEN 'SMALL' THEN 0 ELSE -p_size END::BIGINT AS number FROM part, (VALUES ('SMALL'), ('LARGE')) v(n)")
def enum_values(spark, sf_dir):
    rows = parse(_part_files(spark, sf_dir)).where("kind = 'enum'").select("file_path", "message_name", F.inline("values"))
    return rows.select("file_path", "message_name", "name", "number")


@query("SELECT 'part' || p_partkey || '.proto' AS file_path, 'Shop' || p_partkey AS service, 'Find' AS rpc, 'Part' || p_partkey AS request_type, 'Box' AS response_type FROM part")
def service_rpcs(spark, sf_dir):
    rows = parse(_part_files(spark, sf_dir), "strict").where("kind = 'service'").select("file_path", F.col("name").alias("service"), F.explode("rpcs").alias("r"))
    return rows.select("file_path", "service", F.col("r.name").alias("rpc"), "r.request_type", "r.response_type")


@query("SELECT 'part.proto:' || p_brand || '.' || p_name AS id, p_name || ' (' || p_type || ') in ' || p_brand || ' from parts' || CASE WHEN p_size > 25 THEN ' — size ' || p_size ELSE '' END AS document, p_name AS fqn FROM part")
def document_rendering(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("field_name"), F.col("p_type").alias("field_type"), F.col("p_brand").alias("message_name"), F.lit("parts").alias("package"), F.lit("part.proto").alias("file_path"), F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size"))).otherwise("").alias("comment"), F.array().cast("array<string>").alias("parent_messages"))
    return p.select(catalog.document_id().alias("id"), catalog.document_text().alias("document"), catalog.qualified_name().alias("fqn"))


@query(f"WITH c AS ({_COLUMNS}) SELECT message_name, string_agg('- ' || field_name || ' (' || field_type || ', optional) in tables/' || message_name || ' [' || message_name || '.parquet]', chr(10) ORDER BY place) AS lines FROM c GROUP BY message_name")
def prompt_lines(spark, sf_dir):
    r = table_records(spark, sf_dir)
    lines = catalog.prompt_lines(r).join(r.select("ord", "message_name"), "ord")
    return lines.groupBy("message_name").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY ord)").alias("lines"))


# --- Summaries ---------------------------------------------------------------------------------------------------------------------


@query("SELECT t AS field_type, count(*) AS n FROM part, (VALUES ('int32'), ('string'), ('map<string, int64>'), ('string'), ('int32'), ('bool'), ('double'), ('string')) v(t) GROUP BY 1")
def type_distribution(spark, sf_dir):
    declared = parse(_part_files(spark, sf_dir))
    return catalog.summary(declared, catalog.unnumbered_records(declared)).where("measure = 'type_distribution'").select(F.col("key").alias("field_type"), "n")


@query(f"WITH c AS ({_COLUMNS}) SELECT 'tables/' || message_name AS event_type, count(*) AS n FROM c GROUP BY 1")
def fields_per_event_type(spark, sf_dir):
    return table_records(spark, sf_dir).groupBy(catalog.summary_key().alias("event_type")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({_COLUMNS}) SELECT 'total_files' AS measure, '' AS key, count(DISTINCT message_name) AS n FROM c UNION ALL SELECT 'total_fields', '', count(*) + count(DISTINCT message_name) FROM c
    UNION ALL SELECT 'fields_per_event_type', 'tables.' || message_name[1] || '/' || message_name, count(*) FROM c GROUP BY 2 UNION ALL SELECT DISTINCT 'fields_per_event_type', 'tables.' || message_name[1] || '/Key', count(DISTINCT message_name) FROM c GROUP BY 2
    UNION ALL SELECT 'type_distribution', t, count(*) FROM (SELECT {_AS_PROTO} AS t FROM c UNION ALL SELECT * FROM (SELECT DISTINCT 'int64' AS t, message_name FROM c) k(t, m) WHERE false) GROUP BY 2""".replace("UNION ALL SELECT * FROM (SELECT DISTINCT 'int64' AS t, message_name FROM c) k(t, m) WHERE false", "UNION ALL SELECT 'int64' FROM (SELECT DISTINCT message_name FROM c)"))
def catalog_summary(spark, sf_dir):
    declared = parse(_definitions(spark, sf_dir))
    return catalog.summary(declared, catalog.field_records(declared))


@query(f"WITH c AS ({_COLUMNS}) SELECT DISTINCT 'tables/' || message_name AS event_type FROM c")
def event_types(spark, sf_dir):
    return catalog.event_types(table_records(spark, sf_dir))


@query("SELECT (rn // 100)::BIGINT AS batch, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) GROUP BY 1")
def batch_windows(spark, sf_dir):
    placed = with_positions(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return placed.groupBy(F.floor(F.col("position") / 100).alias("batch")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


# --- Store -------------------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, kind: str) -> str:
    """A folder in the cluster's shared place, or a temporary one where none is set; gone when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or f"file://{tempfile.gettempdir()}"
    name = f"{kind}-{uuid.uuid4().hex}"
    atexit.register(_forget, Folder(spark, base), name)
    return f"{base}/{name}"


def _scratch_store(spark: SparkSession) -> FieldStore:
    return FieldStore(spark, _scratch(spark, "fields"))


def _forget(parent: Folder, name: str) -> None:
    try:
        parent.delete(name)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


@query(f"WITH c AS ({_COLUMNS}) SELECT message_name || '.parquet:' || message_name || '.' || field_name AS id, field_name || ' (' || field_type || ') in ' || message_name || ' from tables' AS document, field_name AS fqn FROM c")
def store_round_trip(spark, sf_dir):
    store = _scratch_store(spark)
    records = table_records(spark, sf_dir)
    store.upsert(records)
    store.upsert(records.where("message_name <> 'region'"))
    return store.all_fields().select("id", "document", "metadata.fqn")


def _row_records(rows: DataFrame, name, kind, message, order) -> DataFrame:
    """Rows of a table as field records."""
    return rows.select(name.alias("field_name"), kind.alias("field_type"), message.alias("message_name"), F.lit("rows").alias("package"), F.lit("rows.proto").alias("file_path"), F.lit("optional").alias("label"), F.lit("").alias("comment"), F.array().cast("array<string>").alias("parent_messages"), order.cast("bigint").alias("ord"))


@query("SELECT 'rows.proto:Supplier.n' || s_nationkey AS id, 'n' || s_nationkey || ' (' || arg_max(s_name, s_suppkey) || ') in Supplier from rows' AS document FROM supplier GROUP BY s_nationkey")
def upsert_latest(spark, sf_dir):
    """Of records with one id, the last by order stays."""
    store, s = _scratch_store(spark), read(spark, sf_dir, "supplier")
    store.upsert(_row_records(s, F.concat(F.lit("n"), "s_nationkey"), F.col("s_name"), F.lit("Supplier"), F.col("s_suppkey")))
    return store.all_fields().select("id", "document")


_MERGED = "SELECT 'rows.proto:Nation.' || n_name AS id, n_name || CASE WHEN n_regionkey = 1 THEN ' (changed)' ELSE ' (old)' END || ' in Nation from rows' AS document FROM nation UNION ALL SELECT 'rows.proto:Region.' || r_name, r_name || ' (new) in Region from rows' FROM region"


def _merged_store(spark, sf_dir, prune):
    store, nation, region = _scratch_store(spark), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    store.upsert(_row_records(nation, F.col("n_name"), F.lit("old"), F.lit("Nation"), F.col("n_nationkey")))
    changed = _row_records(nation.where("n_regionkey = 1"), F.col("n_name"), F.lit("changed"), F.lit("Nation"), F.col("n_nationkey"))
    store.upsert(changed.unionByName(_row_records(region, F.col("r_name"), F.lit("new"), F.lit("Region"), F.col("r_regionkey") + 100)), prune)
    return store


@query(_MERGED)
def upsert_merge(spark, sf_dir):
    """Changed records replace stored ones, new ones are added, others stay."""
    return _merged_store(spark, sf_dir, False).all_fields().select("id", "document")


@query(f"SELECT * FROM ({_MERGED}) WHERE document NOT LIKE '% (old) %'")
def upsert_prune(spark, sf_dir):
    """With `prune`, stored records that aren't given go."""
    return _merged_store(spark, sf_dir, True).all_fields().select("id", "document")


@query("SELECT 0::BIGINT AS cleared, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")
def store_count_and_clear(spark, sf_dir):
    store = _merged_store(spark, sf_dir, False)
    n = store.count()
    store.clear()
    return spark.createDataFrame([(store.count(), n)], "cleared bigint, n bigint")


@query(f"WITH c AS ({_COLUMNS}) SELECT field_name AS query_key, field_name || ' (' || arg_max(field_type, message_name) || ')' AS query_text FROM c GROUP BY field_name")
def query_texts(spark, sf_dir):
    """What a field is looked up by; of equal names the last one's type."""
    return store_ops.query_texts(table_records(spark, sf_dir))


@query()
def store_similar_fields(spark, sf_dir):
    """The ten nearest fields of other tables' columns, by the default embedder."""
    store = _scratch_store(spark)
    records = table_records(spark, sf_dir)
    store.upsert(records)
    return store.similar_to(store_ops.query_texts(records)).select("query_key", "rank", "id", F.round("distance", 6).alias("distance"))


# --- Neighbours --------------------------------------------------------------------------------------------------------------------

_KNN = "WITH d AS (SELECT q.vec_id AS query_key, q.label AS query_label, c.vec_id AS id, c.label AS label, round(pow(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2), 9) AS distance FROM embeddings q, embeddings c), r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY distance, id) AS rank FROM d)"


def _knn(spark, sf_dir):
    """All rows as queries against all rows, in blocks; the distance is rounded before ranking so that both engines agree on ties."""
    e = read(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_key"), "embedding")
    c = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    hits = neighbours.top_k(q, c, 10, carry=("label",)).withColumn("distance", F.round("distance", 9))
    return hits.join(e.select(F.col("vec_id").alias("query_key"), F.col("label").alias("query_label")), "query_key")


@query(_KNN + " SELECT query_key, rank::INT AS rank, id, distance FROM r WHERE rank <= 10")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir).select("query_key", "rank", "id", "distance")


@query(_KNN + " SELECT query_key, rank::INT AS rank, id, distance FROM r WHERE rank <= 10 AND label <> query_label")
def knn_postfilter(spark, sf_dir):
    return neighbours.drop_own_file(_knn(spark, sf_dir), F.col("query_label"), "label").select("query_key", "rank", "id", "distance")


@query(_KNN + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY rank) AS n FROM r WHERE rank <= 10 AND id <> query_key) SELECT query_key, id, distance FROM o WHERE n = 1 AND distance < 1.2")
def knn_threshold(spark, sf_dir):
    return neighbours.close(_knn(spark, sf_dir).where("id <> query_key"), 1.2).select("query_key", "id", "distance")


# --- Concepts ----------------------------------------------------------------------------------------------------------------------


_NEAR = [("o_orderkey", "doc_id"), ("l_orderkey", "html"), ("html", "doc_id"), ("p_name", "no_such_field")]


def _hits(spark):
    """Neighbours of some fields, as a store's search gives them."""
    rows = [(q, 1, f"x:{n}", 0.1, "", (n, "string", "m", "p", "f", "optional", n)) for q, n in _NEAR]
    return spark.createDataFrame(rows, review.HITS)


@query(f"WITH m AS ({_MAPPINGS}), c AS ({_COLUMNS}), h AS (SELECT * FROM (VALUES {', '.join(map(str, _NEAR))}) t(q, n)), k AS (SELECT c.message_name, c.field_name, c.field_name AS mapped FROM c UNION ALL SELECT c.message_name, c.field_name, h.n FROM c JOIN h ON h.q = c.field_name) SELECT k.message_name, k.field_name, arg_min(m.concept, m.concept_ord) AS concept FROM k JOIN m ON k.mapped = m.field_name GROUP BY ALL")
def concept_match(spark, sf_dir):
    """The first concept that maps a field's own name or that of a neighbour."""
    r = table_records(spark, sf_dir)
    return review.match_concepts(r, _hits(spark), registry(spark)).join(r, "ord").select("message_name", "field_name", "concept")


_FIRST = f"WITH m AS ({_MAPPINGS}), c AS ({_COLUMNS}), f AS (SELECT c.message_name, c.field_name, c.field_type, min(m.concept_ord) AS o FROM c JOIN m ON c.field_name = m.field_name GROUP BY ALL), k AS (SELECT DISTINCT concept, concept_ord, canonical_name, canonical_type FROM m)"


def _no_hits(spark):
    return spark.createDataFrame([], review.HITS)


@query(_FIRST + " SELECT f.message_name, f.field_name, k.concept FROM f JOIN k ON f.o = k.concept_ord")
def concept_first_match(spark, sf_dir):
    r = table_records(spark, sf_dir)
    return review.match_concepts(r, _no_hits(spark), registry(spark)).join(r, "ord").select("message_name", "field_name", "concept")


def _issues(spark, sf_dir):
    return review.find_issues(table_records(spark, sf_dir), _no_hits(spark), registry(spark), "tables/new")


@query(_FIRST + " SELECT f.field_name, k.canonical_name, count(*) AS n FROM f JOIN k ON f.o = k.concept_ord WHERE f.field_name <> k.canonical_name GROUP BY ALL")
def naming_mismatch(spark, sf_dir):
    return _issues(spark, sf_dir).where("issue_type = 'naming_mismatch'").groupBy("field_name", "canonical_name").agg(F.count("*").alias("n"))


@query(_FIRST + " SELECT 'Field ''' || f.field_name || ''' has type ''' || f.field_type || ''' but canonical type for ''' || k.concept || ''' is ''' || k.canonical_type || '''. This may cause downstream query issues.' AS message, count(*) AS n FROM f JOIN k ON f.o = k.concept_ord WHERE f.field_type <> k.canonical_type GROUP BY ALL")
def type_mismatch(spark, sf_dir):
    return _issues(spark, sf_dir).where("issue_type = 'type_mismatch'").groupBy("message").agg(F.count("*").alias("n"))


@query(f"WITH m AS ({_MAPPINGS}), g AS ({_GAPS}), c AS ({_COLUMNS}), t AS (SELECT DISTINCT message_name, 'tables/' || message_name AS event_type FROM c), k AS (SELECT DISTINCT concept FROM m) SELECT t.event_type, k.concept FROM t, k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.concept = k.concept AND m.event_type = t.event_type) AND NOT EXISTS (SELECT 1 FROM m JOIN c ON c.field_name = m.field_name WHERE m.concept = k.concept AND c.message_name = t.message_name) AND NOT EXISTS (SELECT 1 FROM g WHERE g.concept = k.concept AND g.event_type = t.event_type)")
def missing_concepts(spark, sf_dir):
    return review.missing_by_event_type(table_records(spark, sf_dir), registry(spark)).select("event_type", F.col("name").alias("concept"))


@query(f"WITH m AS ({_MAPPINGS}), c AS ({_COLUMNS}) SELECT k.concept, t.event_type FROM (SELECT DISTINCT concept FROM m) k, (SELECT DISTINCT 'tables/' || message_name AS event_type FROM c) t WHERE (k.concept, t.event_type) NOT IN (SELECT concept, event_type FROM m)")
def coverage_matrix(spark, sf_dir):
    return checks.coverage_gaps(concepts.mappings(registry(spark)), catalog.event_types(table_records(spark, sf_dir)))


@query("SELECT name, canonical_name, concept_ord FROM (SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 'override' ELSE n_name END AS canonical_name, n_nationkey::BIGINT AS concept_ord FROM nation UNION ALL SELECT 'new', 'new', (SELECT max(n_nationkey) FROM nation)::BIGINT + 1 + 1)")
def override_merge(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    none = F.array().cast("array<struct<event_type:string,field_name:string,field_type:string,file_path:string>>")
    rest = [F.lit("").alias("description"), F.lit("string").alias("canonical_type"), none.alias("mappings"), F.array().cast("array<string>").alias("gaps")]
    base = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("concept_ord"), F.col("n_name").alias("canonical_name"), *rest)
    over = n.where("n_nationkey = 3").select(F.col("n_name").alias("name"), F.lit(0).cast("bigint").alias("concept_ord"), F.lit("override").alias("canonical_name"), *rest)
    new = spark.range(1).select(F.lit("new").alias("name"), F.lit(1).cast("bigint").alias("concept_ord"), F.lit("new").alias("canonical_name"), *rest)
    return concepts.merge_overrides(base, over.unionByName(new)).select("name", "canonical_name", "concept_ord")


def _answers(spark, sf_dir):
    """One fenced or bare answer for each region, of its nations as concepts, and one that is no JSON."""
    n = read(spark, sf_dir, "nation")
    item = F.struct(F.concat(F.lit("c"), (F.col("n_nationkey") % 7).cast("string")).alias("name"), F.col("n_name").alias("description"), F.array(F.struct(F.col("n_name").alias("field_name"))).alias("mappings"), F.array(F.concat(F.lit("g"), (F.col("n_nationkey") % 3).cast("string"))).alias("gaps"))
    text = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"]))
    fenced = F.when(F.col("n_regionkey") % 2 == 0, F.concat(F.lit("```json\n"), "t", F.lit("\n```"))).otherwise(F.col("t"))
    bad = spark.range(1).select(F.lit(99).cast("bigint").alias("batch"), F.lit("sorry, no groups").alias("answer"))
    return n.groupBy("n_regionkey").agg(text.alias("t")).select(F.col("n_regionkey").cast("bigint").alias("batch"), fenced.alias("answer")).union(bad)


@query("SELECT n_regionkey::BIGINT AS batch, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS nth, 'c' || (n_nationkey % 7) AS name, n_name AS description, '' AS canonical_type, n_name AS field, '' AS event_type FROM nation")
def answer_parsing(spark, sf_dir):
    return concepts.parse_answers(_answers(spark, sf_dir)).select("batch", "nth", "name", "description", "canonical_type", F.col("mappings")[0]["field_name"].alias("field"), F.col("mappings")[0]["event_type"].alias("event_type"))


@query("SELECT 'c' || (n_nationkey % 7) AS name, arg_min(n_name, n_regionkey * 1000 + n_nationkey) AS description, string_agg(n_name, ',' ORDER BY n_regionkey, n_nationkey) AS fields, list_aggregate(list_sort(list_distinct(list('g' || (n_nationkey % 3)))), 'string_agg', ',') AS gaps FROM nation GROUP BY 1")
def concept_batch_merge(spark, sf_dir):
    merged = concepts.merge_batches(concepts.parse_answers(_answers(spark, sf_dir)))
    return merged.select("name", "description", F.array_join(F.transform("mappings", lambda m: m["field_name"]), ",").alias("fields"), F.array_join("gaps", ",").alias("gaps"))


@query(f"WITH c AS ({_COLUMNS}) SELECT (o // 10)::BIGINT AS batch, count(*)::INT AS n FROM (SELECT row_number() OVER (ORDER BY message_name, place) - 1 AS o FROM c) GROUP BY 1")
def registry_batches(spark, sf_dir):
    return concepts.batches(table_records(spark, sf_dir), 10).select("batch", F.size("lines").alias("n"))


_BUILT = f"""WITH c AS ({_COLUMNS}), e AS (SELECT count(DISTINCT message_name) AS n FROM c), g AS (SELECT regexp_replace(lower(field_name), '[^a-z0-9]', '', 'g') AS key, * FROM c),
    names AS (SELECT key, field_name, count(*) AS n FROM g GROUP BY ALL), types AS (SELECT key, field_type, count(*) AS n FROM g GROUP BY ALL),
    k AS (SELECT key, count(*)::INT AS n_mappings, count(DISTINCT message_name) AS have FROM g GROUP BY key),
    b AS (SELECT (SELECT field_name FROM names WHERE names.key = k.key ORDER BY n DESC, field_name LIMIT 1) AS canonical_name, (SELECT field_type FROM types WHERE types.key = k.key ORDER BY n DESC, field_type LIMIT 1) AS canonical_type, n_mappings, CASE WHEN 2 * have > e.n THEN e.n - have ELSE 0 END::INT AS n_gaps FROM k, e)
    SELECT trim(lower(canonical_name), '_') AS name, * FROM b WHERE n_mappings > 1 OR n_gaps > 0"""


@query(_BUILT)
def registry_build(spark, sf_dir):
    """Concepts that the offline clusterer finds in the tables' columns."""
    found, _ = concepts.build_registry(table_records(spark, sf_dir))
    return found.select("name", "canonical_name", "canonical_type", F.size("mappings").alias("n_mappings"), F.size("gaps").alias("n_gaps"))


@query(f"WITH c AS ({_COLUMNS}) SELECT count(*) AS total_fields, count(DISTINCT message_name) AS total_event_types, (SELECT count(*) FROM ({_BUILT})) AS total_concepts FROM c")
def registry_metadata(spark, sf_dir):
    _, meta = concepts.build_registry(table_records(spark, sf_dir))
    return spark.createDataFrame([tuple(meta[k] for k in ("total_fields", "total_event_types", "total_concepts"))], "total_fields bigint, total_event_types bigint, total_concepts bigint")


@query("SELECT 'canonical_registry:CanonicalRegistry.' || canonical_name AS id, canonical_name || ' (' || canonical_type || ') in CanonicalRegistry from canonical — ' || description AS document FROM (VALUES " + ", ".join(str((c[3], c[4], c[2])) for c in REGISTRY) + ") t(canonical_name, canonical_type, description)")
def concept_records(spark, sf_dir):
    """Concepts in the store, beside fields."""
    store = _scratch_store(spark)
    store.upsert(concepts.as_records(registry(spark)))
    return store.all_fields().select("id", "document")


@query(f"SELECT concept, map_ord::INT AS map_ord, event_type, field_name FROM ({_MAPPINGS})")
def registry_export(spark, sf_dir):
    """A registry written to its file and read again."""
    with tempfile.TemporaryDirectory() as folder:
        registry_files.write_registry(registry(spark), f"{folder}/registry.yaml")
        back = registry_files.read_registry(spark, f"{folder}/registry.yaml")
        rows = [tuple(r) for r in concepts.mappings(back).select("name", "map_ord", "event_type", "field_name").collect()]
    return spark.createDataFrame(rows, "concept string, map_ord int, event_type string, field_name string")


# --- Issues and recommendations ----------------------------------------------------------------------------------------------------

_AS_ISSUES = "SELECT event_id AS ord, CAST(user_id AS VARCHAR) AS field_name, CASE event_id % 4 WHEN 0 THEN 'naming_mismatch' WHEN 1 THEN 'type_mismatch' WHEN 2 THEN 'missing_concept' ELSE 'other' END AS issue_type, CASE WHEN value > 90 THEN 'error' WHEN value > 30 THEN 'warning' ELSE 'info' END AS severity, event_type AS message FROM events"


def _event_issues(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("naming_mismatch", "type_mismatch", "missing_concept", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("field_name"), kind.alias("issue_type"), F.when(F.col("value") > 90, "error").when(F.col("value") > 30, "warning").otherwise("info").alias("severity"), F.col("event_type").alias("message"))


@query(f"WITH i AS ({_AS_ISSUES}) SELECT count(*) AS issue_count, count_if(severity = 'error')::BIGINT AS error_count, count_if(severity = 'warning')::BIGINT AS warning_count, count_if(severity = 'info')::BIGINT AS info_count FROM i")
def severity_counts(spark, sf_dir):
    return review.counts(_event_issues(spark, sf_dir))


@query(f"""WITH i AS ({_AS_ISSUES}) SELECT CASE issue_type WHEN 'naming_mismatch' THEN 'Field naming inconsistencies' WHEN 'type_mismatch' THEN 'Field type mismatches' ELSE 'Missing canonical concepts' END AS title,
    CASE issue_type WHEN 'type_mismatch' THEN 'error' WHEN 'missing_concept' THEN 'warning' ELSE CASE max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END END AS severity,
    md5(string_agg('- ' || message, chr(10) ORDER BY ord)) AS body_md5, CASE issue_type WHEN 'missing_concept' THEN 0 ELSE count(*) END::INT AS n_fields, (row_number() OVER (ORDER BY min(ord)) - 1)::INT AS ord FROM i WHERE issue_type <> 'other' GROUP BY issue_type""")
def issue_rollup(spark, sf_dir):
    return review.recommend(_event_issues(spark, sf_dir)).select("title", "severity", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.size("fields").alias("n_fields"), "ord")


@query(f"WITH i AS ({_AS_ISSUES}) SELECT ord, '- [' || upper(severity) || '] ' || issue_type || ': ' || message AS line FROM i")
def issue_lines(spark, sf_dir):
    return review.issue_lines(_event_issues(spark, sf_dir))


@query("SELECT n_nationkey AS nation, n_name AS title, '' AS body, CASE WHEN n_nationkey % 2 = 0 THEN 'error' ELSE 'info' END AS severity, 0 AS n_fields FROM nation")
def advice_parsing(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    item = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.array(F.struct(F.col("n_name").alias("title"), F.lit("error").alias("severity"))))).otherwise(F.to_json(F.array(F.struct(F.col("n_name").alias("title")))))
    found = review.parse_advice(n.select(F.concat(F.lit("```\n"), item, F.lit("\n```")).alias("answer")))
    return found.join(n, n["n_name"] == found["title"]).select(F.col("n_nationkey").alias("nation"), "title", "body", "severity", F.size("fields").alias("n_fields"))


_NATION_ISSUES = "SELECT n_nationkey AS ord, n_name AS field_name, CASE n_nationkey % 3 WHEN 0 THEN 'naming_mismatch' WHEN 1 THEN 'type_mismatch' ELSE 'missing_concept' END AS issue_type, CASE n_nationkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'error' ELSE 'warning' END AS severity, 'about ' || n_name AS message FROM nation"
_REPORTED = f"""WITH i AS ({_NATION_ISSUES}), r AS (SELECT min(ord) AS first_ord, CASE issue_type WHEN 'naming_mismatch' THEN 'Field naming inconsistencies' WHEN 'type_mismatch' THEN 'Field type mismatches' ELSE 'Missing canonical concepts' END AS title, severity, string_agg('- ' || message, chr(10) ORDER BY ord) AS body,
    CASE WHEN issue_type <> 'missing_concept' THEN string_agg(field_name, ', ' ORDER BY ord) END AS fields FROM i GROUP BY issue_type, severity), n AS (SELECT count(*) AS n, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w, count_if(severity = 'info') AS f FROM i)"""


def _nation_review(spark, sf_dir):
    kinds = F.element_at(F.array(*map(F.lit, ("naming_mismatch", "type_mismatch", "missing_concept"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ("info", "error", "warning"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    issues = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("field_name"), kinds.alias("issue_type"), severity.alias("severity"), F.concat(F.lit("about "), "n_name").alias("message"))
    return review.Review("x.proto", issues, review.recommend(issues), **review.counts(issues).first().asDict())


@query(_REPORTED + """ SELECT '# Proto Review: x.proto' || chr(10) || chr(10) || '**Issues:** ' || n || ' (' || e || ' errors, ' || w || ' warnings, ' || f || ' info)' || chr(10) || chr(10) ||
    (SELECT string_agg('## ' || CASE severity WHEN 'error' THEN '!!!' WHEN 'warning' THEN '!!' ELSE '!' END || ' ' || title || chr(10) || chr(10) || body || chr(10) || coalesce(chr(10) || '**Fields:** ' || fields || chr(10), ''), chr(10) ORDER BY first_ord) FROM r) AS report FROM n""")
def report_markdown(spark, sf_dir):
    return spark.createDataFrame([(review.as_markdown(_nation_review(spark, sf_dir)),)], "report string")


@query(_REPORTED + """ SELECT 'Review: x.proto' || chr(10) || chr(10) || 'Summary' || chr(10) || '  Total issues  ' || n || chr(10) || '  Errors        ' || e || chr(10) || '  Warnings      ' || w || chr(10) || '  Info          ' || f ||
    (SELECT string_agg(chr(10) || chr(10) || '[' || upper(severity) || '] ' || title || chr(10) || body || coalesce(chr(10) || '  Fields: ' || fields, ''), '' ORDER BY first_ord) FROM r) AS report FROM n""")
def report_text(spark, sf_dir):
    return spark.createDataFrame([(review.as_text(_nation_review(spark, sf_dir)),)], "report string")


@query(_REPORTED + " SELECT title, body, severity, coalesce(fields, '') AS fields, n AS issue_count, e::BIGINT AS error_count FROM r, n")
def report_json(spark, sf_dir):
    said = json.loads(review.as_json(_nation_review(spark, sf_dir)))
    rows = [(x["title"], x["body"], x["severity"], ", ".join(x["fields"]), said["issue_count"], said["error_count"]) for x in said["recommendations"]]
    return spark.createDataFrame(rows, "title string, body string, severity string, fields string, issue_count bigint, error_count bigint")


# --- Data quality ------------------------------------------------------------------------------------------------------------------


@query("SELECT source, c AS \"column\", count(*) AS n, count_if(v IS NULL)::BIGINT AS nulls, round(count_if(v IS NULL) / count(*), 9) AS rate FROM (SELECT source, unnest(['quality', 'toxic', 'lang']) AS c, unnest([quality::VARCHAR, toxic::VARCHAR, lang]) AS v FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL")
def null_rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return checks.null_rates(d, [F.col("source")], ["quality", "toxic", "lang"]).select(F.col("_g0").alias("source"), "column", "n", "nulls", F.round("rate", 9).alias("rate"))


@query("WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count_if(o_orderstatus = 'O') / count(*) AS rate FROM orders GROUP BY 1), b AS (SELECT *, lag(rate) OVER (ORDER BY period) AS before FROM r) SELECT period, round(rate, 9) AS rate, round(before, 9) AS before FROM b WHERE rate - before > 0.02")
def null_rate_spikes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("closed", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    rates = checks.null_rates(o, [F.date_format("o_orderdate", "yyyy-MM")], ["closed"])
    return checks.rate_spikes(rates, "_g0", 0.02).select(F.col("_g0").alias("period"), F.round("rate", 9).alias("rate"), F.round("before", 9).alias("before"))


@query("SELECT event_type, k AS field_name, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) WHERE (event_type, k) NOT IN (VALUES ('click', 'k'), ('view', 'other')) GROUP BY ALL")
def unknown_fields(spark, sf_dir):
    known = spark.createDataFrame([("click", "k"), ("view", "other")], "event_type string, field_name string")
    return checks.unknown_fields(read(spark, sf_dir, "events"), "props", known, "event_type")


_SHARES = "SELECT period, bucket, n, n / sum(n) OVER (PARTITION BY period) AS share FROM (SELECT strftime(ts, '%Y-%m-%d') AS period, (CASE WHEN value >= 100 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 20 THEN 2 WHEN value >= 5 THEN 1 ELSE 0 END)::INT AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)"
_EDGES = [5.0, 20.0, 50.0, 100.0]


@query(f"SELECT period, bucket, n, round(share, 9) AS share FROM ({_SHARES})")
def distribution_shares(spark, sf_dir):
    return checks.distribution(read(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), "value", _EDGES).withColumn("share", F.round("share", 9))


@query(f"WITH s AS ({_SHARES}), p AS (SELECT period, lag(period) OVER (ORDER BY period) AS before FROM (SELECT DISTINCT period FROM s)), g AS (SELECT DISTINCT p.period, p.before, s.bucket FROM p JOIN s ON s.period IN (p.period, p.before) WHERE p.before IS NOT NULL), v AS (SELECT g.period, coalesce(x.share, 0.0001) AS a, coalesce(y.share, 0.0001) AS b FROM g LEFT JOIN s x ON x.period = g.period AND x.bucket = g.bucket LEFT JOIN s y ON y.period = g.before AND y.bucket = g.bucket) SELECT period, round(sum((a - b) * ln(a / b)), 6) AS psi FROM v GROUP BY period")
def distribution_shift(spark, sf_dir):
    shares = checks.distribution(read(spark, sf_dir, "events"), F.date_format("ts", "yyyy-MM-dd"), "value", _EDGES)
    return checks.stability_index(shares).withColumn("psi", F.round("psi", 6))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' ELSE 'ns' END AS precision, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 ELSE epoch_us(ts) // 1000 END AS millis FROM events")
def time_normalization(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    raw = F.when(F.col("event_id") % 4 == 0, F.expr("t div 1000000")).when(F.col("event_id") % 4 == 1, F.expr("t div 1000")).when(F.col("event_id") % 4 == 2, F.col("t")).otherwise(F.col("t") * 1000).cast("bigint")
    return e.select("event_id", checks.time_precision(raw).alias("precision"), checks.epoch_millis(raw).alias("millis"))


@query("SELECT doc_id, coalesce(text, html, url) AS body FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS text, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE source END AS html, 'u' || doc_id AS url FROM documents)")
def name_reconciliation(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("text"), F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("html"), F.concat(F.lit("u"), "doc_id").alias("url"))
    return checks.reconcile_names(d, {"body": ["text", "html", "absent", "url"]})


_TYPED = "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' || user_id ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events"


def _untyped(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "user_id")).otherwise(F.col("user_id").cast("string")).alias("user_id"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"))


@query(f"SELECT event_id, user_id, event_type, user_id IS NULL AS rejected FROM ({_TYPED})")
def type_reconciliation(spark, sf_dir):
    return checks.reconcile_types(_untyped(spark, sf_dir), {"user_id": "bigint"}).select("event_id", "user_id", "event_type", (F.size("rejects") > 0).alias("rejected"))


@query(f"SELECT event_id, user_id, event_type FROM ({_TYPED}) WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def validated_rows(spark, sf_dir):
    return checks.validate(_untyped(spark, sf_dir), ["event_type"], {"user_id": "bigint"})[0]


@query(f"SELECT event_id, concat_ws(';', CASE WHEN user_id IS NULL THEN 'type of user_id' END, CASE WHEN event_type IS NULL THEN 'missing event_type' END) AS reasons FROM ({_TYPED}) WHERE user_id IS NULL OR event_type IS NULL")
def dead_letters(spark, sf_dir):
    return checks.validate(_untyped(spark, sf_dir), ["event_type"], {"user_id": "bigint"})[1].select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS tries FROM events")
def repaired_rows(spark, sf_dir):
    """Wrong types first, then missing event types are repaired; how many rounds a row took."""
    digits = lambda d: d.withColumn("user_id", F.regexp_replace("user_id", "^x", ""))
    typed = lambda d: d.withColumn("event_type", F.coalesce("event_type", F.lit("unknown")))
    return checks.repair(_untyped(spark, sf_dir), ["event_type"], {"user_id": "bigint"}, [digits, typed])[0]


@query("WITH s AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, avg(((value > 10)::INT + (user_id % 2 = 0)::INT) / 2.0) AS score FROM events GROUP BY ALL) SELECT event_type, period, n, round(score, 6) AS score, round(avg(score) OVER (PARTITION BY event_type ORDER BY period ROWS 6 PRECEDING), 6) AS trend FROM s")
def quality_score_trend(spark, sf_dir):
    scores = checks.quality_scores(read(spark, sf_dir, "events"), ["event_type"], F.date_format("ts", "yyyy-MM-dd"), {"value": F.col("value") > 10, "user": F.col("user_id") % 2 == 0})
    return scores.withColumn("score", F.round("score", 6)).withColumn("trend", F.round("trend", 6))


@query(f"WITH c AS ({_COLUMNS}) SELECT message_name, field_name, 'optional' AS label, 'required' AS expected_label FROM c WHERE field_name = 'doc_id'")
def label_mismatches(spark, sf_dir):
    expected = spark.createDataFrame([("doc_id", "required"), ("text", "optional")], "field_name string, expected_label string")
    return checks.label_mismatches(table_records(spark, sf_dir), expected).select("message_name", "field_name", "label", "expected_label")


@query("SELECT 'documents' AS event_type, doc_id::VARCHAR AS key, text AS body FROM documents UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark UNION ALL SELECT 'labels', doc_id::VARCHAR, NULL FROM labels")
def across_events(spark, sf_dir):
    tables = {t: read(spark, sf_dir, t) for t in ("documents", "benchmark", "labels")}
    return checks.across_events(tables, {"key": ["doc_id", "item_id"], "body": ["text", "html"]}, ["key", "body"])


@query("SELECT c_custkey, tier FROM customer LEFT JOIN (VALUES (-1000, 0, 'owing'), (1, 2500, 'small'), (5001, 20000, 'large')) t(low, high, tier) ON floor(c_acctbal)::BIGINT BETWEEN low AND high")
def range_enrichment(spark, sf_dir):
    tiers = spark.createDataFrame([(-1000, 0, "owing"), (1, 2500, "small"), (5001, 20000, "large")], "low bigint, high bigint, tier string")
    c = read(spark, sf_dir, "customer").withColumn("balance", F.floor("c_acctbal"))
    return checks.enrich_by_range(c, "balance", tiers, "low", "high", 1000).select("c_custkey", "tier")


# --- Streams -----------------------------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir):
    batch = read(spark, sf_dir, "events")
    return streams.timed(streams.read_events(spark, sf_dir, batch.schema, "events.parquet"))


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    return streams.run_to_end(stream, _scratch(stream.sparkSession, "stream"), mode)


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    out = _drained(streams.counts(_stream(spark, sf_dir), ["event_type"], "value"), "complete")
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS n, round(avg((value IS NULL)::INT), 9) AS value_null_rate FROM events GROUP BY 1")
def stream_null_rates(spark, sf_dir):
    out = _drained(streams.null_rates(_stream(spark, sf_dir), ["value"]), "complete")
    return out.select(F.date_format("period", "yyyy-MM-dd").alias("period"), "n", F.round("value_null_rate", 9).alias("value_null_rate"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g) SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS start_ms FROM s GROUP BY user_id, nr")
def stream_sessions(spark, sf_dir):
    out = _drained(streams.sessions(_stream(spark, sf_dir), "user_id"), "complete")
    return out.select("user_id", "n", F.unix_millis("start").alias("start_ms"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    return _drained(streams.without_duplicates(_stream(spark, sf_dir), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("""WITH w AS (SELECT event_type, date_trunc('day', ts) AS period, count(*) AS n, sum(value) AS t, sum(value * value) AS q FROM events WHERE value IS NOT NULL GROUP BY ALL), b AS (SELECT *, sum(n) OVER p AS bn, sum(t) OVER p AS bt, sum(q) OVER p AS bq FROM w WINDOW p AS (PARTITION BY event_type ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_type, strftime(period, '%Y-%m-%d') AS period, n AS rows, round(t, 2) AS total, coalesce(bn, 0)::BIGINT AS seen, round(bt, 2) AS before, coalesce(abs(t / n - bt / bn) > 2 * sqrt(greatest(bq / bn - (bt / bn) * (bt / bn), 0) / n), false) AS strays FROM b WHERE period + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_drift(spark, sf_dir):
    """Closed days whose mean strays from all days before, by event type."""
    found = _drained(streams.drift(_stream(spark, sf_dir), "event_type", "value", limit=2.0), "append")
    return found.select("event_type", F.date_format("period", "yyyy-MM-dd").alias("period"), "rows", F.round(F.col("mean") * F.col("rows"), 2).alias("total"), "seen", F.round(F.col("baseline") * F.col("seen"), 2).alias("before"), "strays")
