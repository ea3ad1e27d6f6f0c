"""Data sources of matrix files and archives against numpy and the archive itself."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.sources import files, readers


def got(df, shape):
    out = np.full(shape, np.nan)
    seen = 0
    for r in df.collect():
        seen += 1
        out[r.row_id, r.col_id] = np.nan if r.value is None else r.value
    return out, seen


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", [np.float64, np.float32, np.int16, bool])
def test_matrix_file_equals_numpy(spark, tmp_path, monkeypatch, order, kind):
    monkeypatch.setattr(files, "PART_BYTES", 300)
    monkeypatch.setattr(files, "STEP_BYTES", 200)
    x = (np.arange(60 * 9).reshape(60, 9) % 17).astype(kind)
    if kind == np.float64:
        x[3, 4], x[5, 6], x[7, 8] = np.nan, np.inf, -np.inf
    path = str(tmp_path / "x.npy")
    np.save(path, np.asarray(x, order=order))
    cells = readers.matrix(spark, path)
    assert len(files.MatrixReader(path, None).partitions()) > 1
    out, n = got(cells, x.shape)
    assert n == x.size and np.array_equal(out, np.where(np.isfinite(x.astype(float)), x, np.nan), equal_nan=True)
    some, n = got(cells.filter("col_id IN (2, 5) AND row_id >= 10 AND row_id < 13 AND value >= 0"), x.shape)
    assert n == 6 and np.array_equal(some[10:13, [2, 5]], x[10:13, [2, 5]].astype(float))
    assert got(spark.read.format("npy_matrix").option("path", path).option("columns", "1").load(), x.shape)[1] == 60


def test_conditions_reach_the_reader(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    np.save(tmp_path / "x.npy", np.zeros((50, 4)))
    r = files.MatrixReader(str(tmp_path / "x.npy"), None)
    rest = IsNotNull(("value",))
    assert list(r.pushFilters([GreaterThan(("row_id",), 9), LessThanOrEqual(("row_id",), 12), EqualTo(("col_id",), 3), rest])) == [rest]
    assert r.rows == (10, 13) and r.columns == {3}
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 3


def test_files_that_are_no_matrix(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.zeros(5))
    (tmp_path / "t.npy").write_text("not numbers at all")
    for name in ("v.npy", "t.npy"):
        with pytest.raises(Exception, match="dimensions|not a .npy"):
            readers.matrix(spark, str(tmp_path / name)).collect()


def test_the_largest_csv_of_an_archive(spark, tmp_path):
    path = str(tmp_path / "a.zip")
    body = "".join(f"{k},{k * 2},{'x' if k % 2 else ''}\n" for k in range(500))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("small.csv", "a,b\n1,2\n")
        z.writestr("in/large.CSV", "a,b,c\n" + body)
        z.writestr("notes.txt", "y" * 10**6)
    table = readers.tabular(spark, path)
    assert table.count() == 500 and table.agg(F.sum("b")).first()[0] == sum(2 * k for k in range(500))
    files.register(spark)
    lines = spark.read.format("zip_lines").option("path", path).load()
    assert {r.member: r.n for r in lines.groupBy("member").agg(F.count("*").alias("n")).collect()} == {"small.csv": 2, "in/large.CSV": 501, "notes.txt": 1}
    with pytest.raises(FileNotFoundError):
        readers.unzipped(spark, path, ".tsv")
