"""Data-quality rules: every violation, and a summary with the rules that found none.

A rule is a condition that holds for good rows; a null counts as a failure.  All
rules on one table are read off it in one scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from almanac.functions.columns import SPACES
from almanac.sources.schemas import DIMENSIONS, KINDS, SCORE_MODES, SIGNALS, STATUSES


@dataclass(frozen=True)
class Rule:
    """applies: rows that it looks at; ok: what must hold; observed: what a violation shows."""

    rule_id: str
    ok: Column
    observed: Column
    applies: Column | None = None


def item_rules(snapshot: str, platforms: tuple[str, ...], regions: tuple[str, ...]) -> list[Rule]:
    day = F.lit(snapshot).cast("date")
    status, date = F.col("declared_status"), F.col("declared_date")
    text = date.cast("string")
    known = lambda c, values: F.col(c).isin(*values)
    rules = [
        Rule("Q2", F.trim("title", F.lit(SPACES)) != "", F.col("title")),
        Rule("Q3", F.startswith("source_url", F.lit("https://")), F.col("source_url")),
        Rule("Q4", F.col("checked_at") == day, F.col("checked_at").cast("string")),
        Rule("Q5", F.length("evidence") >= 18, F.col("evidence")),
        Rule("Q6", F.size("platforms") > 0, F.size("platforms").cast("string")),
        *(Rule(f"Q7.{d}", F.col(d).between(1, 10), F.col(d).cast("string")) for d in DIMENSIONS),
        Rule("Q8", date.isNull(), text, status == "development"),
        Rule("Q9", date.isNotNull(), text, status != "development"),
        Rule("Q10", date <= day, text, (status == "released") & date.isNotNull()),
        Rule("Q11", date > day, text, (status == "upcoming") & date.isNotNull()),
        Rule("Q16.status", status.isin(*STATUSES), status),
        Rule("Q16.region", known("region", regions), F.col("region")),
        Rule("Q16.signal", known("signal", SIGNALS), F.col("signal")),
        Rule("Q16.score_mode", known("score_mode", SCORE_MODES), F.col("score_mode")),
        Rule("Q16.platforms", ~F.exists("platforms", lambda p: ~F.coalesce(p.isin(*platforms), F.lit(False))), F.array_join("platforms", ",")),
        Rule("Q17", (status == "released") == (F.col("score_mode") == "initial"), F.concat_ws("/", status, "score_mode")),
        Rule("Q18", F.date_format("release_date", "yyyy.MM.dd") == F.col("date_label"), F.col("date_label"), F.col("release_date").isNotNull()),
    ]
    return rules


def signal_rules() -> list[Rule]:
    return [
        Rule("Q13", F.rlike("date", F.lit(r"^\d{4}-\d{2}-\d{2}\z")), F.col("date")),
        Rule("Q14", F.startswith("source_url", F.lit("https://")), F.col("source_url")),
        Rule("Q15", F.length("detail") >= 20, F.col("detail")),
        Rule("Q16.kind", F.col("kind").isin(*KINDS), F.col("kind")),
    ]


def _failed(rule: Rule) -> Column:
    failed = ~F.coalesce(rule.ok, F.lit(False))
    return failed if rule.applies is None else F.coalesce(rule.applies, F.lit(False)) & failed


def violations(rows: DataFrame, rules: list[Rule], entity: str, key: str) -> DataFrame:
    """(rule_id, entity, key, observed): one row for each violation."""
    broken = F.array_compact(F.array(*(F.when(_failed(r), F.struct(F.lit(r.rule_id).alias("rule_id"), r.observed.cast("string").alias("observed"))) for r in rules)))
    found = rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("b"))
    return found.select("b.rule_id", F.lit(entity).alias("entity"), "key", "b.observed")


def repeated_keys(rows: DataFrame, rule_id: str, entity: str, key: str) -> DataFrame:
    """Violations of uniqueness, one row for each repeated key."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule_id).alias("rule_id"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.col("n").cast("string").alias("observed"))


def too_few(rows: DataFrame, rule_id: str, entity: str, least: int) -> DataFrame:
    """A violation of a table's least size."""
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") < least)
    return n.select(F.lit(rule_id).alias("rule_id"), F.lit(entity).alias("entity"), F.lit("*").alias("key"), F.col("n").cast("string").alias("observed"))


def summary(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, checked, failed) for every rule, in one aggregation."""
    applies = lambda r: F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))
    counts = rows.agg(*(F.count_if(applies(r)).alias(f"c{i}") for i, r in enumerate(rules)), *(F.count_if(_failed(r)).alias(f"f{i}") for i, r in enumerate(rules)))
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"c{i}").alias("checked"), F.col(f"f{i}").alias("failed")) for i, r in enumerate(rules)))
    return counts.select(F.explode(each).alias("r")).select("r.*")


def publish(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, and the others."""
    broken = F.lit(False)
    for r in rules:
        broken = broken | _failed(r)
    return rows.where(~broken), rows.where(broken)


def divert(rows: DataFrame, rules: list[Rule], path: str) -> tuple[DataFrame, DataFrame, list[tuple[str, int, int]]]:
    """Rows that break no rule, the others with the rules they break, and (rule_id, checked, failed) for every rule.

    One pass writes both kinds of rows to folders of their own below a fresh path, and counts on the way.
    """
    seen = Observation()
    applies = lambda r: F.lit(True) if r.applies is None else F.coalesce(r.applies, F.lit(False))
    counts = [c for i, r in enumerate(rules) for c in (F.count_if(applies(r)).alias(f"c{i}"), F.count_if(_failed(r)).alias(f"f{i}"))]
    broken = F.array_compact(F.array(*(F.when(_failed(r), F.lit(r.rule_id)) for r in rules)))
    checked = rows.observe(seen, *counts).withColumn("broken", broken)
    checked.withColumn("published", F.size("broken") == 0).write.partitionBy("published").parquet(path)
    found = rows.sparkSession.read.schema(StructType([*checked.schema.fields, StructField("published", BooleanType())])).parquet(path)
    of = lambda good: found.where(F.col("published") == good).drop("published")
    return of(True).drop("broken"), of(False), [(r.rule_id, seen.get[f"c{i}"], seen.get[f"f{i}"]) for i, r in enumerate(rules)]
