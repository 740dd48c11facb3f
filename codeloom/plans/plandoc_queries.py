"""Registered queries: plans of work, one per order with a unit per line."""

from pyspark.sql import functions as F

from codeloom.plans.graph_view import table
from codeloom.plans.registry import query
from codeloom.sources import plandocs

STATE = ("CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'complete' "
         "WHEN l_returnflag = 'A' THEN 'in_progress' WHEN l_quantity = 13 THEN 'odd' ELSE 'pending' END")
#: The status, and the notes that go with it, follow from the order.
STATUS = ("CASE o_orderkey % 7 WHEN 0 THEN 'complete' WHEN 1 THEN 'superseded' WHEN 2 THEN 'abandoned' WHEN 3 THEN 'draft' "
          "WHEN 4 THEN 'in_progress' WHEN 5 THEN 'active' ELSE 'unheard' END")
NOTES = {"implemented_in": "CASE WHEN o_orderkey % 2 = 0 THEN 'commit' END", "superseded_by": "CASE WHEN o_orderkey % 3 = 0 THEN 'other.md' END",
         "abandoned_reason": "CASE WHEN o_orderkey % 5 = 0 THEN 'no need' END"}
PATH = "'plans/' || o_orderkey || '-' || lower(replace(o_orderpriority, ' ', '')) || '-plan.md'"


def _plans(spark, sf_dir):
    # Units of equal id stay, as rules ask for them: a line number is taken modulo 5.
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(
            (F.col("l_linenumber") % 5).cast("int").alias("id"), F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
            F.expr(STATE).alias("state"), F.lit(None).cast("string").alias("implemented_in"),
            F.expr("CASE WHEN l_tax > 0.04 THEN 'taxed' END").alias("skipped_reason")).alias("unit"))
    units = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    orders = table(spark, sf_dir, "orders").join(units, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.expr(PATH).alias("path"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit("feat").alias("type"), F.expr(STATUS).alias("status"), F.lit("").alias("date"),
        *[F.expr(e).alias(n) for n, e in NOTES.items()], "units")


def _units_sql(state: str = STATE, status: str = STATUS) -> str:
    notes = ", ".join(f"{e} AS {n}" for n, e in NOTES.items())
    return f"""WITH plans AS (SELECT o_orderkey, {PATH} AS path, 'Order ' || o_orderkey AS title, {status} AS status, {notes}
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
units AS (SELECT l_orderkey, l_linenumber % 5 AS id, {state} AS state, CASE WHEN l_tax > 0.04 THEN 'taxed' END AS reason FROM lineitem),
tally AS (SELECT l_orderkey, count(*) AS units_total, count(*) FILTER (state = 'pending') AS units_pending,
  count(*) FILTER (state = 'in_progress') AS units_in_progress, count(*) FILTER (state = 'complete') AS units_complete,
  count(*) FILTER (state = 'skipped') AS units_skipped FROM units GROUP BY l_orderkey),
rolled AS (SELECT p.*, t.*, CASE WHEN units_complete + units_skipped = units_total THEN 'complete'
  WHEN units_in_progress + units_complete > 0 THEN 'in_progress' ELSE 'active' END AS rollup
  FROM plans p JOIN tally t ON t.l_orderkey = p.o_orderkey)"""


COUNTS = "units_total, units_pending, units_in_progress, units_complete, units_skipped"


@query("plan_report", _units_sql() + f""" SELECT path, title, 'feat' AS type, status, implemented_in, superseded_by, abandoned_reason, {COUNTS},
  contains(path, '1-urgent') OR contains(path, '-low-') AS branch_match FROM rolled""")
def plan_report(spark, sf_dir):
    rows = plandocs.report(_plans(spark, sf_dir), "topic/1urgent-low")
    counts = {c: F.col(c).cast("long") for c in rows.columns if c.startswith("units_")}
    return rows.withColumns(counts)


@query("plan_violations", _units_sql() + """
SELECT path, message FROM (
  SELECT path, 'invalid plan status: ' || status AS message FROM rolled WHERE status = 'unheard'
  UNION ALL SELECT path, 'status=complete requires implemented_in' FROM rolled WHERE status = 'complete' AND implemented_in IS NULL
  UNION ALL SELECT path, 'status=superseded requires superseded_by' FROM rolled WHERE status = 'superseded' AND superseded_by IS NULL
  UNION ALL SELECT path, 'status=abandoned requires abandoned_reason' FROM rolled WHERE status = 'abandoned' AND abandoned_reason IS NULL
  UNION ALL SELECT path, 'plan status=' || status || ' disagrees with rollup=' || rollup FROM rolled
    WHERE status NOT IN ('superseded', 'abandoned', 'draft') AND status <> rollup
  UNION ALL SELECT path, 'unit ' || id || ': invalid state' FROM units JOIN plans ON o_orderkey = l_orderkey WHERE state = 'odd'
  UNION ALL SELECT path, 'duplicate unit id: ' || id FROM (SELECT l_orderkey, id, unnest(range(1, count(*))) FROM units
    GROUP BY l_orderkey, id HAVING count(*) > 1) JOIN plans ON o_orderkey = l_orderkey
  UNION ALL SELECT path, 'unit ' || id || ': state=skipped requires a reason' FROM units JOIN plans ON o_orderkey = l_orderkey
    WHERE state = 'skipped' AND reason IS NULL)""")
def plan_violations(spark, sf_dir):
    """All eight rules."""
    return plandocs.violations(_plans(spark, sf_dir))


@query("plan_unit_state", _units_sql(f"CASE WHEN l_linenumber % 5 = 1 THEN 'complete' ELSE {STATE} END") + f"""
SELECT path, CASE WHEN status IN ('superseded', 'abandoned', 'draft') THEN status ELSE rollup END AS status, {COUNTS} FROM rolled""")
def plan_unit_state(spark, sf_dir):
    """Unit 1 of every plan set to complete; the status follows."""
    after = plandocs.report(plandocs.set_unit_state(_plans(spark, sf_dir), 1, "complete", implemented_in="now"))
    return after.select("path", "status", *[F.col(c.strip()).cast("long").alias(c.strip()) for c in COUNTS.split(",")])


@query("plan_set_status", _units_sql(f"CASE WHEN {STATE} IN ('pending', 'in_progress') THEN 'complete' ELSE {STATE} END") + f"""
SELECT path, 'complete' AS status, coalesce('now', implemented_in) AS implemented_in, CAST(NULL AS VARCHAR) AS superseded_by, {COUNTS} FROM rolled""")
def plan_set_status(spark, sf_dir):
    """Every plan completed, with its open units."""
    after = plandocs.report(plandocs.set_plan_status(_plans(spark, sf_dir), "complete", implemented_in="now"))
    return after.select("path", "status", "implemented_in", "superseded_by",
                        *[F.col(c.strip()).cast("long").alias(c.strip()) for c in COUNTS.split(",")])
