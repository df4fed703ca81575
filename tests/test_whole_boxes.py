"""The queries over all boxes of the view."""

import pytest

from quire.oracles import ORACLES
from quire.plans import views
from quire.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_box_has_a_row(spark):
    boxes = {(r["page_id"], r["det_idx"]) for r in views.detections(spark, SF).collect()}
    for name in ("layout_blocks", "paper_score"):
        rows = QUERIES[name](spark, SF).collect()
        assert len(rows) == len(boxes) and {(r["page_id"], r["det_idx"]) for r in rows} == boxes, name
    assert {r["page_id"] for r in QUERIES["tiles_topk"](spark, SF).collect()} <= {p for p, _ in boxes}


def test_tiles_equal_sql_where_coverages_tie(spark, tmp_path):
    # 12 x 23 1/3 in the first tile, 14 x 20 in the last: both 280, but not as doubles
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, 1, 3, 6, 2.0), (0, 2, 10, 13, 4.0)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["tiles_topk"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(ORACLES["tiles_topk"]).fetchall()) and [r[1] for r in got] == ["0-0", "1-0"]
