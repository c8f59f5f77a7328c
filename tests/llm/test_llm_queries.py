import glob
import os

import duckdb
import pytest

from codeloom.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {"p2_found": ["file_id"], "p4_found": ["qualified_name"], "p5_found": ["vec_a", "vec_b"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)
    if name in registry.SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = con.execute(registry.SQL[name]).fetchall()
        assert sorted(map(tuple, df.select(*[d[0] for d in con.description]).collect())) == sorted(got)
