"""Fix proofs: refs on several rules, hot groups, and what is written for many fixes."""

import pytest
from pyspark.sql import functions as F

from rulescape.operators import fixes, paths
from rulescape.operators.scratch import cut, write_table
from rulescape.plans import snapshot
from rulescape.sources import normalize

WITH = "fix_id string, op string, target_ref string, shadowing_ref string, for_type string, for_involved array<string>"


def _view(spark, rules):
    """Rules as (tool, ref, source, destination, service, action), in order."""
    rows = [(i, i, *r) for i, r in enumerate(rules)]
    given = spark.createDataFrame(rows, "record_seq long, `order` int, source_tool string, raw_ref string, src string, dst string, "
                                        "service string, action string")
    catalog = spark.sql("""SELECT * FROM VALUES ('web', '10.0.0.1', array('dmz')), ('app', '10.0.0.2', array('prod')),
                           ('db', '10.0.0.3', array('pci')) AS t(name, ip, tags)""")
    parsed = normalize.Parsed(
        normalize.shaped(given, normalize.RULE, tool_rank="0"), normalize.shaped(catalog, normalize.CATALOG),
        normalize.shaped(catalog.limit(0), normalize.SEEN), catalog.limit(0))
    return snapshot.build_view(parsed, cut(normalize.shared_entities(parsed)), materialize=True)


def _found(view):
    every = cut(paths.internet_paths(view.passing, view.nodes))
    chained = snapshot.chains.path_findings(paths.describe(paths.cross_tool(every), view.nodes))
    return cut(snapshot.rule_findings(view.placed).unionByName(chained)), every


RULES = [
    ("firewall", "A", "0.0.0.0/0", "web", "tcp/443", "allow"), ("cloud", "A", "web", "db", "tcp/5432", "allow"),
    ("cloud", "B", "10.0.0.0/8", "app", "tcp/22", "allow"), ("cloud", "B", "10.1.0.0/16", "app", "tcp/22", "allow"),
    ("firewall", "C", "10.2.0.0/16", "app", "tcp/443", "allow"), ("firewall", "D", "10.0.0.0/8", "app", "udp/443", "allow"),
    ("firewall", "C", "10.2.1.0/24", "app", "tcp/443", "deny"),
]


@pytest.fixture(scope="module")
def several(spark):
    view = _view(spark, RULES)
    return view, *_found(view)


@pytest.mark.parametrize("ref", ["A", "B", "C"])
def test_all_rules_of_a_ref_go_together(spark, several, ref):
    view, findings, every = several
    fix = spark.createDataFrame([("f", "remove", ref, None, "none", ["none"])], WITH)
    got = fixes.validate_fixes(fix, view, findings, every).first()
    after, _ = _found(_view(spark, [r for r in RULES if r[1] != ref]))
    assert (got.findings_before, got.findings_after) == (findings.count(), after.count())


def test_fixes_of_a_hot_group_are_not_paired(spark, monkeypatch):
    n = 40
    view = _view(spark, [("firewall", f"R{i:02d}", "10.0.0.0/8", "app", "tcp/22", "deny") for i in range(n)])
    findings, every = _found(view)
    assert findings.count() == n - 1
    wanted = cut(fixes.default_fixes(findings, view.records))
    wanted = wanted.unionByName(wanted.withColumn("fix_id", F.concat("fix_id", F.lit("|again"))))
    sizes = []

    def counted(df, *aggs):
        out, seen = write_table(df, *aggs)
        sizes.append((seen["rows"], out.columns))
        return out, seen

    monkeypatch.setattr(fixes, "write_table", counted, raising=False)
    monkeypatch.setattr(fixes, "cut", lambda df: counted(df)[0])
    out = fixes.validate_fixes(wanted, view, findings, every).collect()
    assert len(out) == 2 * (n - 1) and len({(r.resolves, r.findings_after) for r in out}) == 1
    # two keys a rule at most, before and after its edit; fixes that edit alike are proved once
    assert max(rows for rows, _ in sizes) <= 4 * n
    assert not [c for _, c in sizes if {"dest_tags", "fix_id"} & set(c)]


def test_only_grants_that_tell_of_a_pair_change_its_paths(spark, monkeypatch):
    n = 12
    more = [("firewall", f"P{i:02d}", "0.0.0.0/0", "web", "tcp/80", "allow") for i in range(n)]
    view = _view(spark, RULES[:2] + more)
    findings, every = _found(view)
    fix = spark.createDataFrame([(f"f{r[1]}", "remove", r[1], None, "none", ["none"]) for r in more], WITH)
    pairs = []
    monkeypatch.setattr(fixes, "cut", lambda df: (pairs.append(df.count()) if df.columns == ["edit", "target_ref", "s", "d"] else None) or cut(df))
    got = fixes.validate_fixes(fix, view, findings, every).collect()
    # the overlaps with all others, and one shadow: its own, or that of the second rule once the first is removed
    assert {r.findings_before - r.findings_after for r in got} == {n - 1 + 1}
    # the path stays as it is, so nobody looks at its hops again
    assert pairs == [0]


def test_what_goes_with_a_ref_is_told_without_signals(several):
    view, findings, every = several
    fix = cut(fixes.default_fixes(findings, view.records))
    named = fixes._named_findings(findings)
    assert {r.ref for r in named.select("ref").collect()} == {"A", "B", "C", "D"} - {
        ref for ref in "ABCD" if not findings.filter(F.array_contains("raw_refs", ref) & F.expr(
            "type IN ('over_permissive', 'cidr_overlap') OR title LIKE '%likely uninspected'")).count()}
    assert "get_json_object" not in named._jdf.queryExecution().optimizedPlan().toString()
    decided = [r.decision for r in fixes.fix_gate(fixes.validate_fixes(fix, view, findings, every)).collect()]
    assert len(decided) == findings.count() and set(decided) <= {"auto_approve", "escalate"}


def test_nodes_are_written_once_when_asked_for(spark, monkeypatch):
    written = []
    monkeypatch.setattr(snapshot, "cut", lambda df: written.append(df.columns) or cut(df))
    view = _view(spark, RULES)
    assert not [c for c in written if "ip_set" in c]
    assert view.nodes is view.nodes and len([c for c in written if "ip_set" in c]) == 1
    assert {r.node for r in view.nodes.collect()} >= {"web", "db", "app", "0.0.0.0/0"}
