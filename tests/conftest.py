import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textloom.session import local_session

    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows_of(frame, columns):
    """Rows as comparable tuples, in order."""
    out = []
    for row in frame[columns].itertuples(index=False, name=None):
        out.append(repr(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row)))
    return sorted(out)
