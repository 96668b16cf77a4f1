"""Every query with SQL gives the rows of its SQL, and every query runs on empty tables."""

from pathlib import Path

import duckdb
import pytest

from diffloom import queries as core
from diffloom.checks import queries as checks

DATA = Path("/root/testdata/sf0.001")
#: Reports whose made-up form is checked through findings, flags and highlights.
REPORTS = {"findings_by_type", "risk_factors", "category_scores", "risk_report", "category_aggregates", "top_findings", "dependency_overview", "finding_lines", "result_lines", "risk_delta", "profile_findings", "section_lines"}


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


_FOUND: dict[tuple, object] = {}


@pytest.fixture(autouse=True)
def findings_once(monkeypatch):
    """The findings of the same tables are computed once for all tests that read them."""
    real = core._findings

    def once(changes):
        key = (changes.with_sources, tuple(sorted(changes.hunks.inputFiles())))
        if key not in _FOUND:
            _FOUND[key] = real(changes)
        return _FOUND[key]

    monkeypatch.setattr(core, "_findings", once)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted({**core.oracle_sql(), **{n: s for n, s in checks.oracle_sql().items() if n.removeprefix("made_up_") not in REPORTS}}))
def test_against_sql(spark, duck, name):
    df = {**core.queries(), **checks.queries()}[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute({**core.oracle_sql(), **checks.oracle_sql()}[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(norm(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("empty")
    for p in DATA.glob("*.parquet"):
        spark.read.parquet(str(p)).where("false").coalesce(1).write.parquet(f"{out}/{p.name}")
    return str(out)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["p2_found", "p4_found", "findings", "risk_score", "risk_report", "parse_patch", "sql_risk_report", "config_findings", "schema_changes", "chunk_by_budget"])
def test_empty_tables(spark, empty_dir, name):
    assert core.queries()[name](spark, empty_dir).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_scores_stay_in_range(spark):
    rows = core.queries()["risk_score"](spark, str(DATA)).collect()
    assert rows and all(0 <= r.score <= 100 and r.level in ("low", "medium", "high") for r in rows)
    report = core.queries()["risk_report"](spark, str(DATA)).collect()
    assert report and all(0 <= r.overall <= 100 for r in report)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_findings_name_delivered_files_only(spark):
    rows = core.queries()["findings"](spark, str(DATA)).collect()
    files = {(r.changeset_id, r.path) for t in ("files", "hunks") for r in spark.read.parquet(f"{DATA}/{t}.parquet").select("changeset_id", "path").distinct().collect()}
    assert rows and all((r.changeset_id, r.file) in files for r in rows if r.file)


def test_no_product_module_reads_made_up_hunks():
    root = Path(__file__).resolve().parents[1] / "diffloom"
    for path in root.rglob("*.py"):
        if "checks" not in path.parts:
            assert "diffloom.checks" not in path.read_text(), path
