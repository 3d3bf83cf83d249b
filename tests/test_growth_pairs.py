"""Questions of reach ask for pairs only: edges are not grouped with what they tell."""

from rulescape.workload import core
from rulescape.workload.estate import _OPEN, estate

SF = "/root/testdata/sf0.001"


def test_reachable_batch_groups_no_edges(spark):
    kept = dict(_OPEN)
    _OPEN.clear()
    try:
        got = core.QUERIES["reachable_batch"](spark, SF).collect()
        found = core.QUERIES["find_paths_batch"](spark, SF).collect()
        view = estate(spark, SF).view
        assert "edges" not in view.__dict__
        assert {(r.s, r.d, r.s_kind, r.d_kind) for r in view.pairs.collect()} == {
            (r.s, r.d, r.s_kind, r.d_kind) for r in view.edges.collect()}
        # with the edges grouped, the same rows
        assert sorted(map(repr, core.QUERIES["reachable_batch"](spark, SF).collect())) == sorted(map(repr, got))
        assert sorted(map(repr, core.QUERIES["find_paths_batch"](spark, SF).collect())) == sorted(map(repr, found))
    finally:
        _OPEN.clear()
        _OPEN.update(kept)
