"""Plans of work as a table: judge them, change their states, report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of plans and units, and words of a file name that say nothing about a branch.
PLAN_STATUSES = ["draft", "active", "in_progress", "complete", "superseded", "abandoned"]
UNIT_STATES = ["pending", "in_progress", "complete", "skipped"]
BRANCH_STOPWORDS = ["feat", "fix", "refactor", "plan"]

#: A plan per row.
PLANS = ("path STRING, title STRING, type STRING, status STRING, date STRING, implemented_in STRING, superseded_by STRING, "
         "abandoned_reason STRING, "
         "units ARRAY<STRUCT<id: INT, title: STRING, state: STRING, implemented_in: STRING, skipped_reason: STRING>>")


def rollup(units: Column) -> Column:
    """Status that follows from the units."""
    done = F.forall(units, lambda u: u["state"].isin("complete", "skipped"))
    begun = F.exists(units, lambda u: u["state"].isin("in_progress", "complete"))
    return F.when(F.size(units) == 0, "active").when(done, "complete").when(begun, "in_progress").otherwise("active")


def violations(plans: DataFrame) -> DataFrame:
    """(path, message): the rules that plans break."""
    status, units = F.col("status"), F.col("units")

    def needs(value: str, key: str) -> Column:
        return F.when((status == value) & (F.coalesce(F.col(key), F.lit("")) == ""), F.lit(f"status={value} requires {key}"))

    def per_unit(bad, text) -> Column:
        return F.transform(F.filter(units, bad), lambda u: F.concat(F.lit("unit "), u["id"].cast("string"), F.lit(text)))

    ids = F.transform(units, lambda u: u["id"])
    twice = F.filter(F.transform(units, lambda u, i: F.when(F.array_position(ids, u["id"]) <= i, u["id"])),
                     lambda x: x.isNotNull())
    expected = rollup(units)
    off = ~status.isin("superseded", "abandoned", "draft") & (F.size(units) > 0) & (status != expected)
    single = F.array_compact(F.array(
        F.when(~status.isin(*PLAN_STATUSES), F.concat(F.lit("invalid plan status: "), status)),
        needs("complete", "implemented_in"), needs("superseded", "superseded_by"), needs("abandoned", "abandoned_reason"),
        F.when(off, F.concat(F.lit("plan status="), status, F.lit(" disagrees with rollup="), expected))))
    found = F.concat(
        single, per_unit(lambda u: ~u["state"].isin(*UNIT_STATES), ": invalid state"),
        F.transform(twice, lambda i: F.concat(F.lit("duplicate unit id: "), i.cast("string"))),
        per_unit(lambda u: (u["state"] == "skipped") & (F.coalesce(u["skipped_reason"], F.lit("")) == ""),
                 ": state=skipped requires a reason"))
    return plans.select("path", F.explode(found).alias("message"))


def _rolled(status: Column, units: Column) -> Column:
    return F.when(status.isin("superseded", "abandoned", "draft"), status).otherwise(rollup(units))


def set_unit_state(plans: DataFrame, unit_id: int, state: str, implemented_in: str | None = None,
                   skipped_reason: str | None = None) -> DataFrame:
    """Set one unit of the given plans; notes that do not belong to the new state are cleared."""
    if state not in UNIT_STATES:
        raise ValueError(f"unknown unit state {state!r}")
    where = F.lit(implemented_in).cast("string")
    why = F.lit(skipped_reason).cast("string")

    def change(u: Column) -> Column:
        kept = F.coalesce(where, u["implemented_in"]) if state == "complete" else (
            u["implemented_in"] if state == "skipped" else F.lit(None).cast("string"))
        reason = F.coalesce(why, u["skipped_reason"]) if state == "skipped" else F.lit(None).cast("string")
        new = F.struct(u["id"].alias("id"), u["title"].alias("title"), F.lit(state).alias("state"),
                       kept.alias("implemented_in"), reason.alias("skipped_reason"))
        return F.when(u["id"] == unit_id, new).otherwise(u)

    changed = plans.withColumn("units", F.transform("units", change))
    return changed.withColumn("status", _rolled(F.col("status"), F.col("units")))


def set_plan_status(plans: DataFrame, status: str, implemented_in: str | None = None, superseded_by: str | None = None,
                    abandoned_reason: str | None = None) -> DataFrame:
    """Set the status; completing a plan completes its open units, and notes of other statuses are cleared."""
    if status not in PLAN_STATUSES:
        raise ValueError(f"unknown plan status {status!r}")
    notes = {"implemented_in": ("complete", implemented_in), "superseded_by": ("superseded", superseded_by),
             "abandoned_reason": ("abandoned", abandoned_reason)}
    out = plans.withColumn("status", F.lit(status))
    for column, (of, value) in notes.items():
        given = F.lit(value).cast("string")
        out = out.withColumn(column, F.coalesce(given, F.col(column)) if status == of else F.lit(None).cast("string"))
    if status == "complete":
        def close(u: Column) -> Column:
            where = F.coalesce(u["implemented_in"], F.lit(implemented_in).cast("string"))
            new = F.struct(u["id"].alias("id"), u["title"].alias("title"), F.lit("complete").alias("state"),
                           where.alias("implemented_in"), u["skipped_reason"].alias("skipped_reason"))
            return F.when(u["state"].isin("pending", "in_progress"), new).otherwise(u)
        out = out.withColumn("units", F.transform("units", close))
    return out


def report(plans: DataFrame, branch: str | None = None) -> DataFrame:
    """One row per plan: status, units per state, and whether its file name fits the branch."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    words = F.filter(F.split(stem, "-"), lambda p: ~p.rlike("^[0-9]+$") & (F.length(p) > 2) & ~p.isin(*BRANCH_STOPWORDS))
    fits = F.exists(words, lambda p: F.contains(F.lit(branch), p)) if branch else F.lit(False)
    tally = [F.size(F.filter("units", _in_state(state))).alias(f"units_{state}") for state in UNIT_STATES]
    return plans.select(
        "path", "title", "type", "status", "implemented_in", "superseded_by", "abandoned_reason",
        F.size("units").alias("units_total"), *tally, fits.alias("branch_match"))


def _in_state(state: str):
    return lambda u: u["state"] == state
