"""Specs: strictness, stable hashes, and a run over the smallest tables."""

import json

import pytest
from conftest import SMALL

from lodestat.plans.catalog import QUERIES, SQL
from lodestat.plans.engine import Refused, SourcePolicy, run_spec
from lodestat.plans.spec import AnalysisSpec, SpecError
from lodestat.sources.observations import observations

SPEC = {
    "title": "t", "purpose": "research", "sources": [f"cdr{i}" for i in range(5)], "index_event": {"observation": "signup"},
    "cohort": {"include": [{"observation": "purchase", "op": ">=", "value": 5}]},
    "variables": [{"name": "p", "from": "purchase", "agg": "mean", "window_days": [0, 28]}, {"name": "c", "from": "click", "agg": "count"}, {"name": "sex", "from": "demographics.sex"}],
    "groups": [{"name": "hi", "where": {"p": {"ge": 50}}}, {"name": "lo", "where": {"p": {"lt": 50}}}],
    "analyses": [{"kind": "describe", "vars": ["p", "c"]}, {"kind": "histogram", "var": "p", "bins": {"range": [0, 100], "width": 20}}, {"kind": "frequency", "vars": ["sex"]}, {"kind": "crosstab", "row": "sex", "col": "sex"},
                 {"kind": "correlation", "vars": ["p", "c"]}, {"kind": "correlation", "vars": ["p", "c"], "method": "spearman"}, {"kind": "compare_groups", "vars": ["c"]}, {"kind": "over_time", "var": "p", "bin_days": 7, "range_days": [0, 28]}, {"kind": "completeness"}, {"kind": "linear_regression", "outcome": "p", "predictors": ["c"]}],
}


def changed(**what):
    return json.loads(json.dumps(SPEC)) | what


def test_hash_is_stable_and_defaults_are_explicit():
    a, b = AnalysisSpec.parse(SPEC), AnalysisSpec.parse(json.dumps(changed(linkage="shared_guid")))
    assert a.digest() == b.digest() and a.digest().startswith("sha256:")
    assert a.digest() != AnalysisSpec.parse(changed(title="u")).digest()
    secret = bytes(32)
    assert a.verified(secret, a.sign(secret)) and not a.verified(secret, "x")
    with pytest.raises(ValueError):
        a.sign(b"short")


@pytest.mark.parametrize("what", [{"purpose": "care"}, {"sources": []}, {"sources": ["a", "a"]}, {"extra": 1}, {"analyses": []}, {"analyses": [{"kind": "describe", "vars": ["q"]}]}, {"groups": []}, {"index_event": None}, {"cohort": {"include": []}}, {"variables": [{"name": "sex", "from": "demographics.sex", "agg": "mean"}]}])
def test_what_is_refused(what):
    with pytest.raises(SpecError):
        AnalysisSpec.parse(changed(**what))


def test_run(spark):
    spec, rows = AnalysisSpec.parse(SPEC), observations(spark, SMALL)
    policies = [SourcePolicy(s, ("research",), k_min=5, may_pool=s != "cdr4") for s in SPEC["sources"]]
    held = []
    found = run_spec(rows, spec, policies, held).collect()
    assert len(held) == 2 and all(frame.is_cached for frame in held)
    for frame in held:
        frame.unpersist()
    assert {r.analysis for r in found} == set(range(10))
    assert all(r.n is None or r.n == 0 or r.n >= 5 for r in found) and all(r.value is None for r in found if r.suppressed)
    people = rows.where("source <> 'cdr4' AND concept = 'purchase' AND value >= 5").select("pid").distinct().count()
    pooled = [r.n for r in found if r.kind == "describe" and r.source == "pooled" and r.var == "c" and r.key == "mean"]
    assert pooled == [people if people >= 5 else None]
    with pytest.raises(Refused):
        run_spec(rows, spec, [SourcePolicy(s, ("statistics",)) for s in SPEC["sources"]])


def test_every_query_gives_what_its_sql_gives(spark):
    import math
    from pathlib import Path

    import duckdb

    db = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        db.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)
    for name, sql in SQL.items():
        mine = QUERIES[name](spark, SMALL)
        names = sorted(mine.columns)
        theirs = db.sql(sql)
        assert sorted(theirs.columns) == names, name
        order = [theirs.columns.index(c) for c in names]
        key = lambda row: tuple(repr(round(v, 2) if isinstance(v, float) else v) for v in row)
        a = sorted((tuple(plain(r[c]) for c in names) for r in mine.collect()), key=key)
        b = sorted((tuple(plain(r[i]) for i in order) for r in theirs.fetchall()), key=key)
        same = lambda x, y: abs(x - y) <= 2e-4 if isinstance(x, float) and isinstance(y, float) else x == y
        assert len(a) == len(b) and all(same(x, y) for p, q in zip(a, b) for x, y in zip(p, q)), name


def test_the_rest_imports_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['lodestat.llm'] = None\nimport importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name.startswith(('lodestat.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(name, name=name)\nsys.modules.pop('lodestat.llm'); sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\nassert 'pipeline' not in e.queries() and len(e.queries()) > 50"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_audit_and_command_line(spark, tmp_path, capsys):
    import datetime

    from lodestat.plans.audit import record_run, runs_of
    from lodestat.plans.cli import main

    spec = AnalysisSpec.parse(changed(analyses=[{"kind": "frequency", "vars": ["sex"]}]))
    result = run_spec(observations(spark, SMALL), spec, [SourcePolicy(s, ("research",)) for s in SPEC["sources"]])
    for day in (1, 2):
        record_run(result, spec, "someone", f"{tmp_path}/audit", datetime.datetime(2026, 1, day))
    found = runs_of(spark, f"{tmp_path}/audit", spec).collect()
    assert found[0]["at"].day == 2 and {r.source for r in found} >= {"pooled"} and all(r.figures >= r.suppressed for r in found)
    assert runs_of(spark, f"{tmp_path}/audit", AnalysisSpec.parse(SPEC)).count() == 0
    (tmp_path / "spec.json").write_text(json.dumps(SPEC))
    assert main(["hash", f"{tmp_path}/spec.json"]) == 0 and capsys.readouterr().out.strip() == AnalysisSpec.parse(SPEC).digest()
    (tmp_path / "bad.json").write_text(json.dumps(changed(purpose="care")))
    assert main(["validate", f"{tmp_path}/bad.json"]) == 1
