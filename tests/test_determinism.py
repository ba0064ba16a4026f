"""Results don't depend on how rows are dealt over partitions or in which order they come."""

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import activity, scans
from lodeframe.plans.catalog import LINES
from lodeframe.sources.views import view

AS_OF = "2001-06-01"
CASES = {
    "contributors": lambda c, f, lines: activity.top_contributors(c),
    "churn": lambda c, f, lines: activity.code_churn(c, f),
    "lines": lambda c, f, lines: activity.lines_per_author(c, f, AS_OF),
    "stale": lambda c, f, lines: activity.stale_files(c, f),
    "sensitive": lambda c, f, lines: scans.sensitive_commits(c, f),
    "rules": lambda c, f, lines: scans.sast_top(lines),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_any_partitioning(spark, small, name):
    tables = view(spark, small, "v_commits"), view(spark, small, "v_file_changes"), LINES(spark, small)
    results = []
    for n in (1, 8):
        dealt = [t.orderBy(F.rand(n)).repartition(n) for t in tables]
        results.append(CASES[name](*dealt).collect())
    assert sorted(results[0]) == sorted(results[1]) and results[0]
