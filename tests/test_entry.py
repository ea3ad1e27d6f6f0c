import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert not set(__spark_entry__.oracle_sql()) - set(__spark_entry__.queries())


def test_entry_works_without_the_text_operators(tmp_path):
    """The rest stands alone when the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2:3].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, timeout=120)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.n_scored > 0 and row.rmse > 0


#: A query of each kind that is quick on the smallest tables.
NAMES = ["grid_known_counts", "mask_mcar", "mask_block_rows", "impute_col_mode", "hankelize", "leaderboard", "clf_roc_auc", "series_mean_sd", "ordinal_codes"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
