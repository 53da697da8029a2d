"""The field catalog: one row for each field, its texts and keys, and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _record() -> list:
    return [F.col("name").alias("field_name"), F.col("type").alias("field_type"), "message_name", "package", "file_path", "label", "comment", F.col("parents").alias("parent_messages")]


def unnumbered_records(declarations: DataFrame) -> DataFrame:
    """One row for each field, in no order and without `ord`: enough for summaries, and made without a join."""
    return declarations.where("kind = 'field'").select(*_record())


def field_records(declarations: DataFrame) -> DataFrame:
    """One row for each field in the order of files, messages (outer before inner) and fields; `ord` numbers them from 0.

    The number is global, so it is made from counts: running sums over files within blocks of 4096, and over the blocks.
    The joins are merge joins, as Spark knows the size of the files but not how many rows are made of them: it would
    take millions of fields for a small side and send them through the driver.
    """
    fields = declarations.where("kind = 'field'")
    within = Window.partitionBy("file_ord").orderBy("msg_ord", "ord")
    counts = fields.groupBy("file_ord").agg(F.count("*").alias("n"))
    counts = counts.withColumn("block", F.floor(F.col("file_ord") / 4096))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("m")).select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("file_ord")) - F.col("n")
    before = counts.withColumn("inside", inside).join(blocks.hint("merge"), "block").select("file_ord", (F.col("start") + F.col("inside")).alias("base"))
    numbered = fields.withColumn("nth", F.row_number().over(within) - 1).join(before.hint("merge"), "file_ord")
    return numbered.select(*_record(), (F.col("base") + F.col("nth")).alias("ord"))


def records_of_tables(spark: SparkSession, tables: dict[str, DataFrame], package: str = "tables") -> DataFrame:
    """Columns of tables as field records: a table is a message, a column a field."""
    from fieldweave.schemas import FIELD_RECORD

    rows = [(f.name, f.dataType.simpleString(), t, package, f"{t}.parquet", "optional" if f.nullable else "required", "", []) for t, df in sorted(tables.items()) for f in df.schema.fields]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FIELD_RECORD)


def qualified_name() -> Column:
    """Parents and field, joined by dots."""
    return F.concat_ws(".", "parent_messages", "field_name")


def document_id() -> Column:
    return F.concat("file_path", F.lit(":"), "message_name", F.lit("."), "field_name")


def document_text() -> Column:
    """`name (type) in message from package`, and the comment behind an em dash if there is one."""
    base = F.format_string("%s (%s) in %s from %s", "field_name", "field_type", "message_name", "package")
    return F.concat(base, F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(" — "), "comment")).otherwise(""))


def metadata() -> Column:
    return F.struct("field_name", "field_type", "message_name", "package", "file_path", "label", qualified_name().alias("fqn"))


def event_type_key() -> Column:
    """package/message, with the slash even if there is no package: the key of registries."""
    return F.concat("package", F.lit("/"), "message_name")


def summary_key() -> Column:
    """package/message, or the message alone if there is no package: the key of summaries."""
    return F.when(F.col("package") == "", F.col("message_name")).otherwise(event_type_key())


def file_event_type(declarations: DataFrame) -> DataFrame:
    """(file_path, event_type): package and first top-level message of each file, or the empty string: the key of reviews."""
    tops = declarations.where("kind = 'message' and size(parents) = 0").groupBy("file_path").agg(F.min_by("name", "msg_ord").alias("first"))
    files = declarations.where("kind = 'file' and error is null").select("file_path", "package")
    return files.join(tops, "file_path", "left").select("file_path", F.coalesce(F.concat("package", F.lit("/"), "first"), F.lit("")).alias("event_type"))


def field_documents(records: DataFrame) -> DataFrame:
    """id, document and metadata of each record, with its order."""
    return records.select(document_id().alias("id"), document_text().alias("document"), metadata().alias("metadata"), "ord")


def prompt_lines(records: DataFrame) -> DataFrame:
    """Each record as a line for a model."""
    return records.select("ord", F.format_string("- %s (%s, %s) in %s/%s [%s]", "field_name", "field_type", "label", "package", "message_name", "file_path").alias("line"))


def summary(declarations: DataFrame, records: DataFrame) -> DataFrame:
    """Rows (measure, key, n): total_files, total_fields, fields_per_event_type, type_distribution, from one pass over the records, numbered or not."""
    files = declarations.where("kind = 'file' and error is null").agg(F.count("*").alias("n")).select(F.lit("total_files").alias("measure"), F.lit("").alias("key"), "n")
    keyed = records.select(summary_key().alias("event_type"), "field_type")
    measure = F.when(F.grouping_id() == 1, "fields_per_event_type").when(F.grouping_id() == 2, "type_distribution").otherwise("total_fields")
    sets = keyed.groupingSets([[F.col("event_type")], [F.col("field_type")], []], F.col("event_type"), F.col("field_type"))
    counted = sets.agg(measure.alias("measure"), F.count("*").alias("n")).select("measure", F.coalesce("event_type", "field_type", F.lit("")).alias("key"), "n")
    return files.unionByName(counted)


def event_types(records: DataFrame) -> DataFrame:
    """Distinct event types in order."""
    return records.select(event_type_key().alias("event_type")).distinct().orderBy("event_type")


def parsed_files(declarations: DataFrame) -> DataFrame:
    """One row for each file that was read and parsed."""
    return declarations.where("kind = 'file' and error is null")


def parse_errors(declarations: DataFrame) -> DataFrame:
    """(file_path, error) of the files that weren't."""
    return declarations.where("kind = 'file' and error is not null").select("file_path", "error")
