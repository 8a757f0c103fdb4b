"""Media folder of the pages: one file a page, known by its number."""

import collections
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.sources import files as SRC

PAGES = [(0, "<p>a</p>"), (1, ""), (2, "two\nlines\r\n"), (3, None), (4, "é日😀"), (5, "same"), (6, "same"), (5, "same"),
         (-7, "below"), (None, "no number"), (None, None), (8, "x" * 5000)]


@pytest.fixture()
def folder(tmp_path):
    rows = PAGES + [(100 + k, "p" * (k % 50)) for k in range(2500)]
    ids, html = zip(*rows)
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": pa.array(["u"] * len(rows)), "html": pa.array(html)}),
                   f"{tmp_path}/pages.parquet", row_group_size=700)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["media_listing", "media_payload"])
def test_one_row_a_page(spark, folder, name):
    import __spark_entry__ as E
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        want = c.execute(E.oracle_sql()[name]).fetchall()
        columns = [x[0] for x in c.description]
    got = E.queries()[name](spark, folder)
    assert got.columns == columns
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want) and len(want) == len(PAGES) + 2500


def test_written_media_are_dealt_over_subfolders(spark, tmp_path):
    from tessera.session import ship_package
    ship_package(spark)
    rows = spark.range(0, 2600, 1, 1).selectExpr("IF(id % 2 = 0, 'n', concat('n', id)) AS name",
                                                 "IF(id >= 2500, NULL, encode(string(id), 'UTF-8')) AS content")
    out = str(tmp_path / "media")
    assert SRC.write_media(rows, out) == 2500
    assert sorted(len(os.listdir(f"{out}/{x}")) for x in os.listdir(out)) == [500, 1000, 1000]
    read = SRC.media_payloads(spark, out).selectExpr("decode(content, 'UTF-8') AS k", "path").collect()
    assert sorted(int(r.k) for r in read) == list(range(2500))
    assert all(r.path.endswith("-n" if int(r.k) % 2 == 0 else f"-n{r.k}") for r in read)
    assert SRC.write_media(rows.limit(0), f"{out}-none") == 0 and SRC.media_listing(spark, f"{out}-none").count() == 0


def test_small_files_share_tasks(spark, folder):
    """A task takes as many files as a subfolder has, whatever a file is reckoned as."""
    import __spark_entry__ as E
    for name in ("media_listing", "media_payload"):
        got = E.queries()[name](spark, folder)
        assert got.count() == len(PAGES) + 2500 and got.rdd.getNumPartitions() < 20
