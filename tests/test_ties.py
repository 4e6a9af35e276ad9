"""Equal rows and equal distances do not leave a result to chance, in Spark or in its SQL."""
from __future__ import annotations

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from tests.compare import table


def both(spark, tmp_path, name, rows):
    cols = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_linenumber": pa.int32(), "l_quantity": pa.float64(),
            "l_extendedprice": pa.float64(), "l_discount": pa.float64(), "l_tax": pa.float64(), "l_returnflag": pa.string(),
            "l_linestatus": pa.string(), "l_shipdate": pa.timestamp("us")}
    file = f"{tmp_path}/lineitem.parquet"
    pq.write_table(pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(cols.items())}), file)
    got = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{file}')")
    cur = con.execute(entry.oracle_sql()[name])
    return (table(got.columns, [tuple(r) for r in got.collect()])[1], table([d[0] for d in cur.description], cur.fetchall())[1])


DAY = dt.datetime(1994, 3, 1)


def test_typical_image_of_copies(spark, tmp_path):
    """Images 2 and 1 hold the same rows in another order; the smaller id is typical of every key."""
    rnd, rows = random.Random(3), []
    for key in range(40):
        lines = [(round(rnd.uniform(900, 90000), 2), rnd.randrange(11) / 100) for _ in range(60)]
        for image in (2, 1):
            rows += [(1, 1, image, 1, 1.0, p, d, 0.0, f"K{key:02}", "O", DAY) for p, d in lines]
            lines = lines[::-1]
    got, want = both(spark, tmp_path, "top10_typical_image", rows)
    assert got == want and {r[1] for r in got} == {1} and len(got) == 40


def test_equal_intervals_merge(spark, tmp_path):
    rnd, rows = random.Random(5), []
    for vid in range(200):
        for _ in range(12):
            r = (vid, float(rnd.randrange(1, 50)), DAY + dt.timedelta(days=rnd.randrange(900)))
            rows += [(k, r[0], 1, 1, r[1], 1.0, 0.0, 0.0, "A", "F", r[2]) for k in range(3)]
    rnd.shuffle(rows)
    got, want = both(spark, tmp_path, "run08_merge_intervals", rows)
    assert got == want and len(got) > 200


def test_equal_intervals_count_once_in_the_sql():
    assert "select distinct vid, lo, hi" in entry.oracle_sql()["run08_merge_intervals"]
