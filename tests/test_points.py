"""Points are gathered by pid once a reading of lineitem, where they are made distinct, and by no later step."""

import re

import pytest

from wardlight.operators import spatial as P
from wardlight.plans.registry import QUERIES

#: Queries whose largest task held a table of its points for each step that grouped or joined them by pid.
BY_ROW = [
    "g17_adjudicate_blocks",
    "a08_agreement",
    "g08_tiling_report",
    "g09_fill_gaps",
    "l01_polygon_layer",
    "l02_school_zone_layer",
    "l03_network_layer",
    "l04_chamber_layer",
]


@pytest.mark.parametrize("name", BY_ROW)
def test_points_are_gathered_by_pid_only_where_they_are_made_distinct(name, spark, sf, monkeypatch):
    frames, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df: frames.append(df) or write(df))
    frames.append(QUERIES[name](spark, sf))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in frames]
    count = lambda pattern: sum(len(re.findall(pattern, p)) for p in plans)
    read = count(r"Relation \[[^\]]*l_linenumber")
    assert read and count(r"RepartitionByExpression \[pid") == count(r"Aggregate \[[^\]]*\bpid#") == read
    assert count(r"Join [^\n]*\bpid#") == 0
