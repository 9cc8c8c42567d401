"""Every core query that has SQL gives what the SQL gives."""

import pytest

from tidemark.plans import analytics, domain, kernels, ledger, lineage, problems

PAIRS = [(n, m.QUERIES[n], m.SQL[n]) for m in (problems, kernels, analytics, domain, ledger, lineage) for n in m.SQL]


@pytest.mark.parametrize("name,query,sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_query_equals_sql(spark, sf, against, name, query, sql):
    against(spark, sf, query, sql)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f"p{n}_found" in entry.queries() for n in (1, 2, 3, 6))


@pytest.mark.parametrize("lacking", ["tidemark.llm", "tiktoken"])
def test_rest_runs_without_llm(monkeypatch, lacking):
    """Neither the subpackage nor the libraries that only it needs are needed."""
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, lacking, None)
    core = {n for m in (problems, kernels, analytics, domain, ledger, lineage) for n in m.QUERIES}
    assert set(entry.queries()) == core and set(entry.oracle_sql()) <= core


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text(), f
