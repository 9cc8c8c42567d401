from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import get_session

    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    folder = "/root/testdata/sf0.001"
    if not Path(folder).is_dir():
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def against():
    """Compares a query with its SQL on the smallest tables."""
    import duckdb

    def canon(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return float(f"{v + 0.0:.8g}")
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        if hasattr(v, "item"):
            return canon(v.item())
        return v

    def run(spark, folder, query, sql):
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        got = query(spark, folder)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(got.columns) == sorted(names)
        order = sorted(names)
        want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]

        def key(rows):
            return sorted(([canon(r[c]) for c in order] for r in rows), key=repr)

        mine, theirs = key([r.asDict() for r in got.collect()]), key(want)
        assert len(mine) == len(theirs)
        for a, b in zip(mine, theirs, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-6 * max(1, abs(x))), (a, b)

    return run
