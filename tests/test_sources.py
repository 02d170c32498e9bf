import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.workbook_maker import workbook_bytes
from tablescope.plans import views
from tablescope.sources import csv_files, csv_records, names, workbooks


def test_short_rows_stay_and_long_rows_go(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,x,y\n2,z\n3,y,z,w\n5,\"p,q\",r\n")
    table = csv_files.read_csv(spark, str(tmp_path))
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, "x", "y"), (2, "z", None), (5, "p,q", "r")]
    assert table.count() == 3


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("k,v\né,1\n".encode())
    (tmp_path / "l.csv").write_bytes("k,v\né,2\n".encode("latin-1"))
    table = csv_files.read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in table.collect()) == [("é", 1), ("é", 2)]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("city,price\nRome,1\nParis,2\n")
    (tmp_path / "b.csv").write_text("price,city,more\n3,Bonn,x\n4,Ulm,y,long\n5\n")
    (tmp_path / "c.csv").write_bytes("city,price\nNîmes,6\n".encode("latin-1"))
    (tmp_path / "d.csv").write_bytes("\ufeffcity,price\nTromsø,7\n".encode())
    (tmp_path / "e.csv").write_bytes("city,price\nŁódź,8\n".encode("utf-16"))
    table = csv_files.read_csv(spark, str(tmp_path))
    assert dict(table.dtypes) == {"city": "string", "price": "bigint", "more": "string"}
    assert sorted(map(tuple, table.select("price", "city", "more").collect())) == [
        (1, "Rome", None), (2, "Paris", None), (3, "Bonn", "x"), (5, None, None), (6, "Nîmes", None), (7, "Tromsø", None), (8, "Łódź", None),
    ]


def test_blank_in_a_path(spark, tmp_path):
    folder = tmp_path / "my files"
    folder.mkdir()
    (folder / "a b.csv").write_bytes("k,k\né,1\n".encode("latin-1"))
    (folder / "c%20d.csv").write_bytes("k,k\né,2\n".encode())
    table = csv_files.read_csv(spark, str(folder))
    assert sorted(map(tuple, table.collect())) == [("é", 1), ("é", 2)] and table.columns == ["k", "k.1"]


def test_wide_whole_numbers_stay_apart(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c,d\n1234567890123456789,12345678901234567890,1" + "0" * 40 + ",1.5\n1234567890123456788,12345678901234567891,2,7\n")
    table = csv_files.read_csv(spark, str(tmp_path))
    assert table.dtypes == [("a", "bigint"), ("b", "decimal(38,0)"), ("c", "string"), ("d", "double")]
    assert table.select("a").distinct().count() == table.select("b").distinct().count() == 2


def test_names_and_types(spark, tmp_path):
    (tmp_path / "n.csv").write_text(" a ,Unnamed: 1,b,c\n1,9,True,NA\n,8,False,1.5\n")
    table = csv_files.read_csv(spark, str(tmp_path))
    assert table.dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "double")]
    assert names.clean_names(spark.createDataFrame([(1, 2)], "`Unnamed: 0` int, `Unnamed: x` int")).columns == ["Unnamed: x"]


def test_texts_that_fit_each_type(spark):
    whole = ["1", " -2 ", "+3", "9" * 18, "9" * 19, "9" * 38, "9" * 39, "N/A", "", None]
    mixed = ["1e3", "\t4", ".5", "true", " FALSE", "True ", "t", "\u00a07", "1-2", "-"]
    df = spark.createDataFrame(list(zip(whole, mixed, [None] * 10)), "`a b` string, `c.d` string, e string")
    got = {r["column"]: tuple(r)[1:] for r in csv_files._fitting(df).collect()}
    # n, whole, long, wide, number, truth
    assert got == {"a b": (7, 7, 4, 6, 7, 0), "c.d": (10, 0, 0, 0, 4, 3)}
    typed = csv_files.infer_column_types(df)
    assert dict(typed.dtypes) == {"a b": "string", "c.d": "string", "e": "string"}


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(" a", 1.5, None), ('q"u,o', 2.0, "x")], "k string, v double, w string")
    csv_files.write_csv(df, str(tmp_path / "out"))
    back = csv_files.read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    csv_files.write_parquet(df, str(tmp_path / "pq"), ["k"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_workbook_folder(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(["id", "name"], [[1, "x & y"], [2, None]]))
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(["name", "id", "more"], [["z", 3, 1.5]]))
    table = workbooks.read_workbooks(spark, str(tmp_path))
    assert dict(table.dtypes) == {"id": "bigint", "name": "string", "more": "double"}
    got = sorted(tuple(r) for r in table.select("id", "name", "more").collect())
    assert got == [(1, "x & y", None), (2, None, None), (3, "z", 1.5)]


def test_workbook_dates_and_repeated_names(spark, tmp_path):
    day, noon = dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29, 12, 30, 15)
    (tmp_path / "a.xlsx").write_bytes(workbook_bytes(["k", "k", "d"], [[1, 2, day], [3, 4, noon], [5, None, None]]) + b"\n")
    table = workbooks.read_workbooks(spark, str(tmp_path))
    assert sorted(map(tuple, table.select("k", F.col("`k.1`"), "d").collect())) == [(1, 2, "2024-02-29"), (3, 4, "2024-02-29 12:30:15"), (5, None, None)]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no data"):
        csv_files.read_csv(spark, str(tmp_path))


def _as_csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def test_line_breaks_in_quotes_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    texts = ["plain", 'say "x"', "a,b", "two\nlines", "\n\n", 'q\n"\n,', "win\r\ndows", "old\rmac", "long " * 300 + "\n" + "x" * 2000, ""]
    rows = [(i, rng.choice(texts), rng.choice(texts), "end") for i in range(240)]
    (tmp_path / "a.csv").write_bytes(_as_csv([("id", "one", "two\nnames", "z"), *rows[:140]]).encode())
    (tmp_path / "b.csv").write_bytes(_as_csv([("two\nnames", "id"), *[(t, i) for i, _, t, _ in rows[140:200]]], "\r\n").encode())
    (tmp_path / "c.csv").write_bytes(_as_csv([("id", "one"), *[(i, "caf\xe9\n" + t) for i, t, _, _ in rows[200:240]]]).encode("latin-1"))
    (tmp_path / "d.csv").write_bytes(b'id,one\n750,"no break"\n751,5" disk\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        table = csv_files.read_csv(spark, str(tmp_path))
        got = {r["id"]: (r["one"], r["two\nnames"], r["z"]) for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {i: (a or None, b or None, z) for i, a, b, z in rows[:140]}
    want |= {i: (None, b or None, None) for i, _, b, _ in rows[140:200]} | {i: ("caf\xe9\n" + a, None, None) for i, a, _, _ in rows[200:240]}
    want |= {750: ("no break", None, None), 751: ('5" disk', None, None)}
    missing = ("", None)
    show = lambda d: {k: tuple(None if x in missing else x for x in v) for k, v in d.items()}
    assert show(got) == show(want)


def test_state_of_a_line():
    inside = csv_records.ends_inside
    assert inside(b'a,"b', False) and not inside(b'a,"b"', False) and not inside(b'5" disk', False) and inside(b'x,"a ""b', False)
    assert not inside(b'b",c', True) and inside(b'b",c,"d', True) and inside(b'b"",c', True) and inside(b"", True) and not inside(b"", False)


def test_quotes_left_open(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,x\n2,"never\nclosed\n')
    table = csv_files.read_csv(spark, str(tmp_path))
    assert sorted(map(tuple, table.collect())) == [(1, "x"), (2, "never\nclosed")]


@pytest.fixture(scope="module")
def far_keys(spark, tmp_path_factory):
    """A tiny star schema whose order keys are so large that sums of row ids pass 64 bits."""
    folder = tmp_path_factory.mktemp("far")
    base = 9 * 10**12 // 4
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "EUROPE")]), "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N", 0)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int", [(1, "C", 0)]), "part": ("p_partkey bigint, p_type string, p_brand string", [(1, "T", "B")]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate timestamp", [(base + i, 1, dt.datetime(1996, 1, 2)) for i in range(120)]),
        "lineitem": (
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double",
            [(base + i, 1, 1, 1, 2.0, 3.0, 0.0) for i in range(120)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _check_key_sums(spark, folder, name):
    found = QUERIES[name](spark, folder)
    rids = [row["rid"] for row in views.dirty(spark, folder).select("rid").collect()]
    assert dict(found.dtypes)["rid_sum"] == "decimal(38,0)"
    rows = found.collect()
    assert sum(int(r["rid_sum"]) for r in rows) == sum(rids) > 2**63 and sum(r["n"] for r in rows) == len(rids)
    assert max(int(r["rid_sum"]) for r in rows) >= 2**63


def test_key_sums_beyond_64_bits_in_mixed_encodings(spark, far_keys):
    _check_key_sums(spark, far_keys, "csv_encoding_mix")


def test_key_sums_beyond_64_bits_with_other_headers(spark, far_keys):
    _check_key_sums(spark, far_keys, "csv_header_orders")


def test_key_sums_beyond_64_bits_with_quoted_breaks(spark, far_keys):
    _check_key_sums(spark, far_keys, "csv_quoted_breaks")


def test_rows_of_a_long_sheet_are_whole_and_dates_are_made_once(monkeypatch):
    made = []

    class Days(workbooks.timedelta):
        def __new__(cls, **parts):
            made.append(parts)
            return dt.timedelta(**parts)

    monkeypatch.setattr(workbooks, "timedelta", Days)
    day = dt.datetime(2024, 1, 5)
    content = workbook_bytes(["k", "d"], [[i, day + dt.timedelta(days=i % 3)] for i in range(9_000)])
    rows = list(workbooks._sheet_rows(content))
    assert rows[1:4] == [(2, {0: "0", 1: "2024-01-05"}), (3, {0: "1", 1: "2024-01-06"}), (4, {0: "2", 1: "2024-01-07"})]
    assert [n for n, _ in rows] == list(range(1, 9_002)) and rows[-1][1] == {0: "8999", 1: "2024-01-07"} and len(made) == 3
