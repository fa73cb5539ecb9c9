"""Every query with SQL against DuckDB over the smallest tables; the others run and keep their schema."""

import os

import duckdb
import pytest

import __spark_entry__
from commitlens.sources import tree

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PLAIN = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return c


def key(rows):
    return sorted(tuple(repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", PLAIN)
def test_query(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = key(tuple(r) for r in df.select(*names).collect())
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    order = [d[0] for d in rel.description]
    assert sorted(order) == names
    assert got == key(tuple(r[order.index(n)] for n in names) for r in rel.fetchall())


def test_tree_scan_of_folders_and_stores(spark, con, tmp_path):
    """A table is a row whether it is a file or a folder of files, by local paths and by URIs."""
    want = key(con.execute(__spark_entry__.oracle_sql()["tree_scan"]).fetchall())
    root = tmp_path / "sf"
    for k, (path, _) in enumerate(con.execute(__spark_entry__.oracle_sql()["tree_scan"]).fetchall()):
        inside = ([""], ["part-0", "part-1", "_SUCCESS", ".part-0.crc"], ["lang=en/part-0.rs", "lang=fr/part-0.go"])[k % 3]
        for f in inside:
            (root / path / f).parent.mkdir(parents=True, exist_ok=True)
            (root / path / f).write_text("")
    for f in ("x.rs", "other.parquet/part-0", "documents.parquet.old/part-0", "old/documents.parquet", "documents"):
        (root / f).parent.mkdir(exist_ok=True)
        (root / f).write_text("")
    spark.conf.set("fs.viewfs.mounttable.trees.link./in", f"file://{tmp_path}")
    for where in (str(root), f"file://{root}", f"file:{root}", "viewfs://trees/in/sf"):
        assert key(tuple(r) for r in __spark_entry__.queries()["tree_scan"](spark, where).select("path", "lang").collect()) == want, where
    for filters in ((), (["./old", "./documents.parquet"], ["part-1"])):
        local, far = (key(tree.scan(spark, d, *filters).collect()) for d in (str(root), "viewfs://trees/in/sf"))
        assert local == far and len(local) > 1
    with pytest.raises(Exception, match="FileNotFound"):
        tree.scan(spark, "viewfs://trees/in/nowhere")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
