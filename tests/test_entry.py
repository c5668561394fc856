"""The driver's contract: every query runs and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from arborel.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
QUICK = ["normalize_aabb", "knn_8", "radius_count", "nearest_label_transfer", "sigma_smooth", "lop_calibrate", "fps_50", "mst_points", "semantic_overall", "mucov_mwcov", "skeleton_chamfer", "triangle_geometry", "cotan_laplacian", "contraction_step", "edge_labels", "p90_index"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.queries()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted(tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want)
