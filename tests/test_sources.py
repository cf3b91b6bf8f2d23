"""Readers, scratch folders, matrix views and written reports."""

import pytest

from latentspark import diagnostics, resample
from latentspark.model import fit
from latentspark.sources import read_csv, tables
from latentspark.spec import Scheme
from tests.test_model import data, model


@pytest.fixture(scope="module")
def fitted(spark):
    return fit(spark.createDataFrame(data(300).assign(id=range(300))), model(), Scheme.PATH, keep=["id"])


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',x,y\n1,2,"a,b"\n2,,c\n')
    (tmp_path / "b.csv").write_text("x;y\n-99;1.5\n3;-99\n")
    a = read_csv(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["_c0", "x", "y"] and [tuple(r) for r in a.orderBy("_c0").collect()] == [(1, 2, "a,b"), (2, None, "c")]
    b = tables.sentinel_to_null(read_csv(spark, str(tmp_path / "b.csv"), ";", "x int, y double"))
    assert sorted(map(tuple, b.collect()), key=str) == [(3, None), (None, 1.5)]


def test_scratch_folders_of_a_cluster_must_be_shared():
    class Fake:
        def __init__(self, master, folder):
            self.conf = type("C", (), {"get": lambda s, k, d: folder})()
            self.sparkContext = type("S", (), {"master": master, "getCheckpointDir": lambda s: None})()

    assert tables.shared_dir(Fake("spark://host:7077", "s3a://shared/x")) == "s3a://shared/x"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            tables.shared_dir(Fake(master, None))


def test_matrices_hold_the_values_of_the_tables(fitted):
    for name, got in (("htmt", fitted.htmt_matrix()), ("htmt2", fitted.htmt_matrix(second=True))):
        cells = {r["lv"]: r for r in got.collect()}
        for r in getattr(fitted, name)().collect():
            assert cells[r.lv_b][r.lv_a] == pytest.approx(r[name]) and cells[r.lv_a][r.lv_b] is None
    cells = {r["lv"]: r for r in fitted.f_squared_matrix().collect()}
    assert all(cells[r.source][r.target] == pytest.approx(r.f_squared) for r in fitted.f_squared().collect())
    cells = {r["lv"]: r for r in fitted.fornell_larcker_matrix().collect()}
    assert all(cells[r.lv][r.lv] == pytest.approx(r.sqrt_ave) for r in fitted.fornell_larcker().collect())


def test_reports_are_written(fitted, spark, tmp_path):
    wanted = {k: v for k, v in diagnostics.report(fitted).items() if k in ("fit_indices", "htmt")}
    diagnostics.write_report(wanted, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "htmt")).count() == wanted["htmt"].count()
    with pytest.warns(DeprecationWarning):
        assert fitted.unidimensionality().count() == 3


def test_specific_indirect_replicates_and_counts(fitted):
    r = resample.bootstrap(fitted, "id", 30)
    assert r.counts() == (30, 0)
    one = r.specific_indirect("X", "Y").collect()
    assert [x.b for x in one] == ["X -> M -> Y"] and one[0].valid == 30
    assert r.specific_indirect(through=["M"]).count() == 1
    with pytest.raises(ValueError):
        r.specific_indirect("M", "Y")
