import datetime as dt
import os
import tempfile

from ledgerlens.sources.export import export_table
from ledgerlens.sources.tables import COMMERCE_SCHEMAS, TABLE_NAMES, load_csv_tables, row_count_manifest


def _write(path, header, rows):
    with open(path, "w") as f:
        f.write(header + "\n")
        for r in rows:
            f.write(r + "\n")


def test_csv_load_multiline_and_timestamps(spark):
    d = tempfile.mkdtemp(prefix="ll-csv-")
    paths = {}
    for name in TABLE_NAMES:
        paths[name] = os.path.join(d, f"{name}.csv")
        _write(paths[name], ",".join(f.name for f in COMMERCE_SCHEMAS[name].fields), [])
    _write(paths["reviews"], ",".join(f.name for f in COMMERCE_SCHEMAS["reviews"].fields),
           ['r1,o1,5,,"line one\nline two",2018-01-01 10:00:00,2018-01-02 00:00:00',
            'r2,o2,1,t,,not a date,2018-01-02 00:00:00'])
    _write(paths["orders"], ",".join(f.name for f in COMMERCE_SCHEMAS["orders"].fields),
           ["o1,c1,delivered,2018-01-01 10:00:00,,,,2018-01-10 00:00:00"])
    t = load_csv_tables(spark, paths)
    rev = {r["review_id"]: r for r in t.reviews.collect()}
    assert rev["r1"]["review_comment_message"] == "line one\nline two"  # embedded newline kept
    assert rev["r1"]["review_creation_date"] == dt.datetime(2018, 1, 1, 10)
    assert rev["r2"]["review_creation_date"] is None                      # unparseable -> null
    o = t.orders.first()
    assert o["order_purchase_timestamp"] == dt.datetime(2018, 1, 1, 10) and o["order_approved_at"] is None
    man = {r["table_name"]: (r["rows"], r["ok"]) for r in
           row_count_manifest(t.as_dict(), {"reviews": 2, "orders": 3}).collect()}
    assert man["reviews"] == (2, True) and man["orders"] == (1, False) and man["sellers"] == (0, None)


def test_export_round_trip(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "k long, s string, x double")
    base = tempfile.mkdtemp(prefix="ll-exp-")
    p1 = export_table(df, os.path.join(base, "pq"))
    assert sorted(spark.read.parquet(p1).collect()) == sorted(df.collect())
    p2 = export_table(df, os.path.join(base, "csv"), fmt="csv")
    back = spark.read.schema(df.schema).option("header", True).csv(p2)
    assert sorted(back.collect()) == sorted(df.collect())
