"""One local session for all tests, and helpers to write and read small tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

DATA = Path(os.environ.get("BRINEWORK_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brinework.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    path = DATA / "sf0.001"
    if not path.is_dir():
        pytest.skip("no test tables here")
    return str(path)


@pytest.fixture
def tables(spark, sf_dir, tmp_path):
    """Writes tables of given rows with the schema of the test tables; what isn't given is empty."""

    def write(extra: dict[str, str] | None = None, **rows: list[dict]) -> str:
        names = {p.name.split(".")[0] for p in Path(sf_dir).iterdir()}
        for name in names:
            schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
            full = [tuple(r.get(f.name) for f in schema.fields) for r in rows.get(name, [])]
            df = spark.createDataFrame(full, schema)
            for column, sql in (extra or {}).items():
                if column not in df.columns:
                    df = df.selectExpr("*", f"{sql} AS `{column}`")
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    return str(v)


def compare(spark, sf_dir: str, run, sql: str) -> None:
    """Fails unless the query and the SQL have the same columns and rows."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted(tuple(norm(x[i]) for i in at) for x in relation.fetchall())
    assert mine == theirs
