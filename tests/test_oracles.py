"""Every query with an oracle gives DuckDB's rows at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelloom import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _rows(rows, order):
    return sorted((tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, duck, data, name):
    df = Q.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = duck.execute(Q.oracle_sql()[name])
    there = [d[0] for d in got.description]
    assert sorted(there) == cols
    assert _rows([tuple(r[c] for c in cols) for r in df.collect()], range(len(cols))) == _rows(got.fetchall(), [there.index(c) for c in cols])


def test_unit_stretch_beyond_four_scenes(spark, tmp_path):
    """Flat scenes beyond the two fixed maps are lightness: they are stretched as the SQL has it."""
    spark.range(300).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = c.execute(f"SELECT image_id, x, y, v FROM ({Q.oracle_sql()['percentile_stretch_unit']})").fetchall()
    got = Q.queries()["percentile_stretch_unit"](spark, str(tmp_path)).select("image_id", "x", "y", "v").collect()
    assert len(want) == 12 * 1024
    assert _rows(got, range(4)) == _rows(want, range(4))
