"""Registered queries over whole tables against their SQL on the smallest tables."""

import pytest

from tests import check_queries

FOLDER = "/root/testdata/sf0.001"
LAST_OUTPUTS = ["lineage_of_last_outputs", "pedigree_of_last_outputs", "published_upstream_of_outputs", "all_sources_of_outputs", "reproduction_plans_of_outputs",
                "workflow_trace", "published_upstream", "executions_behind_endpoints"]


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


def holds(spark, con, name):
    import __spark_entry__ as entry

    text, good = check_queries.compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, text


@pytest.mark.parametrize("name", LAST_OUTPUTS)
def test_all_last_outputs(spark, con, name):
    holds(spark, con, name)


def test_sources_of_given_outputs(spark, con):
    holds(spark, con, "sources_of_given_outputs")


@pytest.mark.parametrize("name, column", [("lineage_of_last_outputs", "hash"), ("all_sources_of_outputs", "hash"), ("reproduction_plans_of_outputs", "target")])
def test_suppliers_are_starts(spark, con, name, column):
    import __spark_entry__ as entry

    want = con.execute("SELECT DISTINCT 'supp:'||l_suppkey FROM lineitem").fetchall()
    found = entry.queries()[name](spark, FOLDER).filter(f"{column} LIKE 'supp:%'").select(column).distinct().collect()
    assert {x[0] for x in found} == {x[0] for x in want} and want


@pytest.mark.parametrize("name", ["recipe_verdicts_with_variables", "recipe_gaps_with_network", "expired_sessions_of_projects", "draft_with_objects", "files_to_keep"])
def test_fed_arms(spark, con, name):
    holds(spark, con, name)


def test_executions_by_file(spark, con):
    """Views of a file go, in order of time, to the nearest free task that named it; the rest goes by time."""
    import __spark_entry__ as entry
    from provenant.operators.links import SOURCE_SLACK_NS
    from provenant.plans.model_sql import with_models
    from provenant.plans.traces import TASKS

    found = lambda name: {r.event_id: r.task_no for r in entry.queries()[name](spark, FOLDER).collect()}
    spans = con.execute(with_models(f"""WITH {TASKS} SELECT DISTINCT n.session, split_part(n.extra, ' -i ', 2), t.task_no, t.start, t."end"
      FROM num n JOIN tsk t USING (session, task_no) WHERE op='exec'""")).fetchall()
    views = con.execute("""SELECT 's'||user_id, '/proj/'||json_extract_string(props,'$.k')||'.csv', epoch_us(ts)*1000, event_id FROM events
      WHERE event_type='view' ORDER BY ts, event_id""").fetchall()
    free, by_file = set(spans), {}
    for session, file, at, event in views:
        near = [(max(x[3] - at, at - x[4], 0), x[3], x[2], x) for x in free if x[:2] == (session, file)]
        near = min((n for n in near if n[0] <= SOURCE_SLACK_NS), default=None)
        if near:
            free.discard(near[3])
            by_file[event] = near[2]
    assert by_file and found("executions_by_file") == found("executions_by_time") | by_file
