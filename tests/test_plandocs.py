from codeloom.sources import plandocs


def plan(spark, status="active", units=(), **notes):
    rows = [("d/2026-01-search-plan.md", "A plan", "feat", status, "", notes.get("implemented_in"), notes.get("superseded_by"),
             notes.get("abandoned_reason"), list(units))]
    return spark.createDataFrame(rows, plandocs.PLANS)


UNITS = [(1, "One", "complete", "def", None), (2, "Two", "pending", None, None), (3, "Three", "skipped", None, "no need")]


def test_report_and_rules(spark):
    plans = plan(spark, "in_progress", UNITS)
    row = plandocs.report(plans, "feature/search").first()
    assert (row["units_total"], row["units_complete"], row["units_skipped"], row["branch_match"]) == (3, 1, 1, True)
    assert plandocs.violations(plans).count() == 0
    broken = plan(spark, "nonsense", [(1, "a", "odd", None, None), (1, "b", "skipped", None, "")])
    assert sorted(r["message"] for r in plandocs.violations(broken).collect()) == [
        "duplicate unit id: 1", "invalid plan status: nonsense", "plan status=nonsense disagrees with rollup=active",
        "unit 1: invalid state", "unit 1: state=skipped requires a reason"]


def test_changes_of_state(spark):
    plans = plan(spark, "in_progress", UNITS)
    done = plandocs.set_unit_state(plans, 2, "complete", implemented_in="xyz")
    assert done.first()["status"] == "complete" and done.first()["units"][1]["implemented_in"] == "xyz"
    assert [r["message"] for r in plandocs.violations(done).collect()] == ["status=complete requires implemented_in"]
    gone = plandocs.set_plan_status(plans, "superseded", superseded_by="q.md").first()
    assert (gone["status"], gone["superseded_by"]) == ("superseded", "q.md")
    whole = plandocs.set_plan_status(plans, "complete", implemented_in="c").first()
    assert [u["state"] for u in whole["units"]] == ["complete", "complete", "skipped"]
