"""Checks and repairs of the data that a catalog describes: rates, drift, unknown fields, names, types, times, coverage and scores."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_rates(df: DataFrame, by: list[Column], columns: list[str]) -> DataFrame:
    """Share of nulls of each column in each group, in one pass: the groups' columns, column, n, nulls, rate."""
    names = [f"_g{i}" for i in range(len(by))]
    keyed = df.select(*[c.alias(n) for c, n in zip(by, names, strict=True)], *[F.col(c).isNull().cast("bigint").alias(c) for c in columns])
    counted = keyed.groupBy(*names).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("p")
    return counted.select(*names, "n", pairs).select(*names, "p.column", "n", "p.nulls", (F.col("p.nulls") / F.col("n")).alias("rate"))


def rate_spikes(rates: DataFrame, period: str, jump: float = 0.1, partition: tuple[str, ...] = ("column",)) -> DataFrame:
    """Rows whose rate rose by more than `jump` since the period before."""
    before = F.lag("rate").over(Window.partitionBy(*partition).orderBy(period))
    return rates.withColumn("before", before).where(F.col("rate") - F.col("before") > jump)


def unknown_fields(df: DataFrame, json_col: str, known: DataFrame, by: str) -> DataFrame:
    """Keys of JSON objects that the catalog (by, field_name) doesn't list, with how often they occur: by, field_name, n."""
    keys = df.select(by, F.explode(F.json_object_keys(json_col)).alias("field_name")).groupBy(by, "field_name").agg(F.count("*").alias("n"))
    return keys.join(known.select(by, "field_name").distinct(), [by, "field_name"], "left_anti")


def distribution(df: DataFrame, period: Column, value: str, edges: list[float]) -> DataFrame:
    """Share of values in each bucket of each period: period, bucket, n, share. A bucket holds values from its edge up to the next."""
    bucket = reduce(lambda e, i: F.when(F.col(value) >= edges[i], i + 1).otherwise(e), range(len(edges)), F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(period.alias("period"), bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def stability_index(shares: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Population stability index of each period against the one before: period, psi. Empty buckets count as `floor`."""
    periods = shares.select("period").distinct()
    order = Window.orderBy("period")  # over periods, which are few
    pairs = periods.withColumn("before", F.lag("period").over(order)).where("before is not null")
    now, then = shares.select("period", "bucket", F.col("share").alias("a")), shares.select(F.col("period").alias("before"), "bucket", F.col("share").alias("b"))
    grid = pairs.join(now, "period").select("period", "before", "bucket").union(pairs.join(then, "before").select("period", "before", "bucket")).distinct()
    both = grid.join(now, ["period", "bucket"], "left").join(then, ["before", "bucket"], "left")
    a, b = F.coalesce("a", F.lit(floor)), F.coalesce("b", F.lit(floor))
    return both.groupBy("period").agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def epoch_millis(value: Column) -> Column:
    """Numbers of seconds, milli-, micro- or nanoseconds since 1970, told apart by size, as whole milliseconds cut toward zero.

    Integers are divided as decimals: a double holds nanoseconds of today to 256 only, and whole milliseconds would come out one too small.
    """
    size = F.abs(value)
    whole = lambda n: (value / F.lit(Decimal(n))).cast("bigint")
    return F.when(size < 100_000_000_000, value * 1000).when(size < 100_000_000_000_000, value).when(size < 100_000_000_000_000_000, whole(1000)).otherwise(whole(1_000_000))


def time_precision(value: Column) -> Column:
    """s, ms, us or ns, by the same sizes."""
    size = F.abs(value)
    return F.when(size < 100_000_000_000, "s").when(size < 100_000_000_000_000, "ms").when(size < 100_000_000_000_000_000, "us").otherwise("ns")


def reconcile_names(df: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Each canonical name as the first of its variants that isn't null; variants themselves go."""
    have = {c: [v for v in names if v in df.columns] for c, names in variants.items()}
    gone = {v for names in have.values() for v in names}
    return df.select(*[c for c in df.columns if c not in gone], *[F.coalesce(*map(F.col, names)).alias(c) for c, names in have.items() if names])


def variants_of(mappings: DataFrame, concepts: DataFrame) -> dict[str, list[str]]:
    """Canonical name -> field names that map to it, in registry order; a registry is small."""
    rows = mappings.join(concepts.select("name", "canonical_name"), "name").select("canonical_name", "concept_ord", "map_ord", "field_name").orderBy("concept_ord", "map_ord").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        names = out.setdefault(r["canonical_name"], [])
        if r["field_name"] not in names:
            names.append(r["field_name"])
    return out


def reconcile_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their canonical types; `rejects` lists those whose value couldn't be."""
    cast = {c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns}
    bad = [F.when(F.col(c).isNotNull() & e.isNull(), F.lit(c)) for c, e in cast.items()]
    rejects = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.select(*[cast.get(c, F.col(c)).alias(c) for c in df.columns], rejects.alias("rejects"))


def validate(df: DataFrame, required: list[str], types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the canonical schema, and a dead-letter table of the others with `reasons`."""
    typed = reconcile_types(df, types)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() & ~F.array_contains("rejects", c), F.lit(f"missing {c}")) for c in required])) if required else F.array().cast("array<string>")
    checked = typed.withColumn("reasons", F.concat(F.transform("rejects", lambda c: F.concat(F.lit("type of "), c)), missing)).drop("rejects")
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def repair(df: DataFrame, required: list[str], types: dict[str, str], repairs: list[Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the canonical schema, as they are or after some of the `repairs`, with `tries`; and the dead letters of the others.

    A row that fails goes through one repair after the other, each on top of those before, and is checked again after each: as many
    rounds as there are repairs. Dead letters show the row as it was given, with the reasons of the last round.
    """
    columns = df.columns
    waiting = df.withColumn("_given", F.struct(*columns)).withColumn("_now", F.struct(*columns))
    good, bad = None, None
    for tries, mend in enumerate([None, *repairs]):
        if mend is not None:
            mended = mend(bad.select("_now.*", "_given"))
            waiting = mended.withColumn("_now", F.struct(*columns))
        passed, bad = validate(waiting, required, types)
        passed = passed.select(*columns, F.lit(tries).alias("tries"))
        good = passed if good is None else good.unionByName(passed)
    return good, bad.select("_given.*", "reasons")


def quality_scores(df: DataFrame, by: list[str], period: Column, checks: dict[str, Column], window: int = 7) -> DataFrame:
    """Mean share of passed checks by group and period, and its moving mean over `window` periods."""
    passed = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in checks.values()]) / len(checks)
    scored = df.groupBy(*by, period.alias("period")).agg(F.count("*").alias("n"), F.avg(passed).alias("score"))
    trend = F.avg("score").over(Window.partitionBy(*by).orderBy("period").rowsBetween(1 - window, 0))
    return scored.withColumn("trend", trend)


def coverage_gaps(mappings: DataFrame, event_types: DataFrame) -> DataFrame:
    """Concepts that an event type lacks: concept, event_type. Both sides are registries' sizes; the grid is their product."""
    have = mappings.select(F.col("name").alias("concept"), "event_type").distinct()
    every = event_types.agg(F.collect_set("event_type").alias("types"))  # one row
    grid = have.select("concept").distinct().crossJoin(every).select("concept", F.explode("types").alias("event_type"))
    return grid.join(have, ["concept", "event_type"], "left_anti")


def label_mismatches(records: DataFrame, expected: DataFrame) -> DataFrame:
    """Fields whose label isn't that expected of their concept: records joined with (field_name, expected_label)."""
    return records.join(expected, "field_name").where(F.col("label") != F.col("expected_label"))


def across_events(tables: dict[str, DataFrame], variants: dict[str, list[str]], columns: list[str]) -> DataFrame:
    """Rows of several event types under canonical names: event_type and `columns`, null where a type lacks one."""
    parts = []
    for name, df in tables.items():
        unified = reconcile_names(df, variants)
        parts.append(unified.select(F.lit(name).alias("event_type"), *[F.col(c).cast("string").alias(c) if c in unified.columns else F.lit(None).cast("string").alias(c) for c in columns]))
    return reduce(DataFrame.unionByName, parts)


def enrich_by_range(df: DataFrame, key: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Left join of rows to the ranges [low, high] that hold their key, as an equi-join on buckets of `width`: no nested loops."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    keyed = df.withColumn("_b", F.floor(F.col(key) / width))
    return keyed.join(spread, (keyed["_b"] == spread["_b"]) & F.col(key).between(F.col(low), F.col(high)), "left").drop("_b")
