"""The registry loads with no file, jar or JVM access."""
import subprocess
import sys

from plotwise.plans import registry

PROBE = """
import glob, zipfile
def fail(*a, **k):
    raise OSError("no file access while registering")
glob.glob = fail
zipfile.ZipFile = fail
import __spark_entry__ as e
names = e.queries()
sql = e.oracle_sql()
assert len(names) >= 135 and set(sql) <= set(names), (len(names), set(sql) - set(names))
"""


def test_registry_loads_without_jar():
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def _documents(spark, path):
    rows = [(i, "red house" if i % 2 else f"green garden w{i}") for i in range(1, 61)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


def test_nearest_documents_ask_every_row_against_all(spark, tmp_path):
    from plotwise.plans import q_similar
    _documents(spark, tmp_path)
    found = q_similar.j6_docs(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(q, k) for q in range(1, 61) for k in range(1, 6)]
    assert "% 100" not in registry.ORACLES["j6_nearest_documents"]


def test_nearest_parts_ask_every_row_against_all(spark, tmp_path):
    from plotwise.plans import q_similar
    rows = [(i, "red bolt" if i % 2 else f"new ring w{i}") for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = q_similar.j6(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(q, k) for q in range(60) for k in range(1, 6)]
    assert "% 100" not in registry.ORACLES["j6_nearest_neighbours"]


def test_batch_asks_every_tenth_document_against_all(spark, tmp_path):
    from plotwise.plans import q_similar
    _documents(spark, tmp_path)
    found = q_similar.r7_batch(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(q, k) for q in range(10, 61, 10) for k in range(1, 6)]
    assert any(r.doc_id % 10 for r in found)
