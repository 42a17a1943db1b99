import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwright.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(clean(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_results_do_not_depend_on_partitions(spark):
    get = lambda: sorted(map(tuple, QUERIES["paragraphs"](spark, SF).collect()))
    was, first = spark.conf.get("spark.sql.shuffle.partitions"), get()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert get() == first
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_the_rest_works_without_the_optional_folders(tmp_path):
    """A copy without both llm folders but with the pipeline still lists and runs the other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_escapes_of_whole_texts_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    from inkwright.plans import queries

    def digests(end):
        late = F.concat(F.rpad("text", 300, "x"), F.lit(end))
        monkeypatch.setattr(queries, "table", lambda s, d, n: s.read.parquet(f"{d}/{n}.parquet").withColumn("text", late))
        return {r["doc_id"]: r["escaped"] for r in QUERIES["text_marks"](spark, SF).collect()}

    once, twice = digests("<"), digests("&lt;")
    assert all(once[k] != twice[k] for k in once)  # marks after 300 characters count


def equals_sql(spark, name, folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = QUERIES[name](spark, str(folder)), c.sql(ORACLE[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows(rel.columns, rel.fetchall())


def test_commonest_with_large_keys(spark, tmp_path):
    c = duckdb.connect()
    # the first seen has the largest supplier; then equal places, where the least supplier wins; then no place
    values = "(7, 1, 990000, 1), (7, 2, 5, 1), (8, 3, 2000, 1), (8, 3, 1999, 1), (9, NULL, 4, 1), (9, 5, 3, 1), (10, NULL, NULL, 1), (10, NULL, 6, 1)"
    c.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INT AS l_linenumber FROM (VALUES {values}) v(l_partkey, l_orderkey, l_suppkey, l_linenumber)) TO '{tmp_path}/lineitem.parquet'")
    equals_sql(spark, "mode_first", tmp_path)


def test_pages_of_keys_past_four_digits(spark):
    from inkwright.functions.text import mark_key, page_of_key

    given = {"00021253011801320743": 2, "00010200": 1, "0001": 1, "00011": 1, "9999": 9999, "1000000000012": 10000, "36000001200340567": 36000, "12345670000123400005678": 1234567, "12": 12, "page0001": None, "": None}
    found = spark.createDataFrame([(k,) for k in given], "key string").select("key", page_of_key(F.col("key")).alias("page")).collect()
    assert {r["key"]: r["page"] for r in found} == given
    pages = [1, 999, 9999, 10000, 36000, 1234567]
    written = spark.createDataFrame([(p, 900000) for p in pages], "p bigint, k bigint").select(page_of_key(mark_key(F.col("p"), F.col("k"))).alias("page")).collect()
    assert [r["page"] for r in written] == pages


def test_marks_of_more_pages_than_four_digits_count(spark, tmp_path):
    c = duckdb.connect()
    c.sql(f"COPY (SELECT range::BIGINT AS c_custkey, 3::INT AS c_nationkey FROM range(10100)) TO '{tmp_path}/customer.parquet'")
    equals_sql(spark, "note_marks", tmp_path)


def test_one_page_of_pixels_is_held_at_a_time(monkeypatch):
    import weakref

    import numpy as np
    import pyarrow as pa

    from inkwright.plans import exports
    from inkwright.sources import png

    held, most, decode = [], [0], png.decode

    def counting(data):
        found = decode(data)
        held.append(weakref.ref(found))
        most[0] = max(most[0], sum(r() is not None for r in held))
        return found

    monkeypatch.setattr(png, "decode", counting)
    pixels = np.zeros((3, 5, 4), np.uint8)
    pixels[0], pixels[1, :4] = (0, 0, 0, 255), (128, 128, 128, 255)
    pages = pa.RecordBatch.from_arrays([pa.array(["a"] * 6), pa.array(range(6), pa.int32()), pa.array([png.encode(pixels)] * 6, pa.binary())], names=["note_id", "page_no", "png"])
    found = pa.Table.from_batches(exports._counted([pages, pages.slice(0, 0)])).to_pydict()
    assert (found["black"], found["grey"], found["clear"]) == ([5] * 6, [4] * 6, [6] * 6)
    assert len(held) == 6 and most[0] <= 2
