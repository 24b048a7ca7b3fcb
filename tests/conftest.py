import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from orbiteer.session import session

    folder = tmp_path_factory.mktemp("spark")
    spark = session(
        "tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"file://{folder}/checkpoints",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
        spark__driver__memory="3g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def same_rows():
    """Whether a query and its SQL give the same rows, in any order."""
    import duckdb

    tables = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return "NaN" if isinstance(v, float) and v != v else repr(v)

    def check(df, sql):
        found = db.sql(sql)
        columns = sorted(found.columns)
        assert columns == sorted(df.columns)
        expected = sorted(tuple(plain(row[found.columns.index(c)]) for c in columns) for row in found.fetchall())
        assert sorted(tuple(plain(row[c]) for c in columns) for row in df.collect()) == expected
        return expected

    return check
