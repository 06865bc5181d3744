import datetime as dt

from pyspark.sql import functions as F

from pricewise.operators import quality as Q

HDR = ["file_row", "date", "market", "state", "district", "variety", "min_price", "max_price", "modal_price"]


def rows(spark, data):
    return spark.createDataFrame(data, ",".join(f"{c} string" if c != "file_row" else "file_row long" for c in HDR))


def test_validate_rules_first_failure_wins(spark):
    df = rows(spark, [
        (0, "2024-01-01", "M1", "S1", "D1", "Red", "1000", "2000", "1500"),
        (1, "2024-01-01", "M2", "S1", "D1", "Red", "1100", "2100", "1600"),
        (2, "2024-01-02", "M1", "S1", "D1", "Red", "1000", "2000", "2900"),   # modal above max
        (3, "2024-01-02", None, "S1", "D1", "Red", "1000", "2000", "1500"),            # missing market
        (4, "2024-01-02", "X", "S1", "D1", "Red", "abc", "2000", "1500"),              # text price
        (5, "2024-01-02", "X", "S1", "D1", "Red", "NaN", "2000", "1500"),              # NaN price
        (6, "2024-01-02", "X", "S1", "D1", "Red", "3000", "2000", "2500"),             # min > max
        (7, "2024-01-02", "X", "S1", "D1", "Red", "0", "0", "0"),                      # zero
        (8, "not a date", "X", "S1", "D1", "Red", "1", "2", "1"),                      # bad date
    ])
    got = {r.file_row: r.reject_reason for r in Q.validate_prices(df).collect()}
    assert got[0] is None and got[1] is None
    assert got[2] == Q.REASON_MODAL
    assert got[3] == Q.REASON_MISSING
    assert got[4] == Q.REASON_BAD_PRICE and got[5] == Q.REASON_BAD_PRICE
    assert got[6] == Q.REASON_MIN_MAX
    assert got[7] == Q.REASON_NOT_POSITIVE
    assert got[8] == Q.REASON_BAD_DATE
    rep = Q.reject_report(Q.validate_prices(df), show=5).first()
    assert rep.success_count == 2 and rep.error_count == 7
    assert rep.errors.startswith("Row 4: " + Q.REASON_MODAL)
    assert rep.errors.endswith("... and 2 more errors")


def _prices(spark, data):
    return spark.createDataFrame(data, "id long, date date, market string, modal_price double")


def test_upsert_later_rows_win_and_idempotent(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    target = _prices(spark, [(1, d1, "A", 10.0), (2, d1, "B", 20.0)])
    src = spark.createDataFrame([(None, d1, "A", 11.0, 0), (None, d1, "A", 12.0, 1), (9, d2, "A", 13.0, 2)],
                                "id long, date date, market string, modal_price double, file_row long")
    once = Q.upsert_prices(target, src)
    got = sorted((r.id, r.date, r.market, r.modal_price) for r in once.collect())
    assert got == [(1, d1, "A", 12.0), (2, d1, "B", 20.0), (9, d2, "A", 13.0)]
    twice = Q.upsert_prices(once, src)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_upsert_numbers_inserted_rows(spark):
    d = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    target = _prices(spark, [(7, d[0], "A", 10.0), (3, d[1], "A", 20.0)])
    src = spark.createDataFrame([(x, "A", 30.0 + i, i) for i, x in enumerate(d)], "date date, market string, modal_price double, file_row long")
    got = sorted((r.date, r.id, r.modal_price) for r in Q.upsert_prices(target, src).collect())
    assert got == [(x, {0: 7, 1: 3}.get(i, 6 + i), 30.0 + i) for i, x in enumerate(d)]
    given = src.withColumn("id", F.when(F.col("file_row") == 5, 100).cast("long"))
    ids = {r.date: r.id for r in Q.upsert_prices(target, given).collect()}
    assert ids[d[0]] == 7 and ids[d[5]] == 100 and sorted(ids[x] for x in d if x not in (d[0], d[1], d[5])) == list(range(101, 138))


def test_csv_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    """Several files, quoted fields, and splits from a few lines to whole files."""
    from pricewise.sources.files import read_prices_csv
    head = "date,market,state,district,variety,min_price,max_price,modal_price,arrival_quantity\n"
    for name, n in (("a", 700), ("b", 1), ("c", 90)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f'2024-01-01,"{name}, {i}",S{"x" * (i % 50)},D,Red,1,3,2,{i}\n' for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = read_prices_csv(spark, str(tmp_path)).select("market", "arrival_quantity", "file_row").collect()
            assert len(rows) == 791 and all(int(r.arrival_quantity) == r.file_row for r in rows), size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_delete_by_filter_keeps_null_predicate_rows(spark):
    df = spark.createDataFrame([(1, 90.0), (2, None), (3, 50.0)], "id long, confidence_interval double")
    kept, n = Q.delete_by_filter(df, F.col("confidence_interval") >= 80)
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    assert n.first().deleted == 1
    assert kept.count() + n.first().deleted == df.count()


def test_update_and_toggle(spark):
    df = spark.createDataFrame([(1, True, 5.0), (2, False, 6.0)], "id long, is_active boolean, v double")
    ch = spark.createDataFrame([(2, 60.0)], "id long, v double")
    assert {r.id: r.v for r in Q.update_by_key(df, ch).collect()} == {1: 5.0, 2: 60.0}
    t = Q.toggle_flag(df, spark.createDataFrame([(1,)], "id long"))
    assert {r.id: r.is_active for r in t.collect()} == {1: False, 2: False}


def test_check_unique_users(spark):
    users = spark.createDataFrame([("ann", "a@x"), ("bob", "b@x")], "username string, email string")
    cand = spark.createDataFrame([("ann", "new@x"), ("cid", "b@x"), ("dan", "d@x")], "username string, email string")
    got = {r.username: r.status for r in Q.check_unique_users(users, cand).collect()}
    assert got == {"ann": "username exists", "cid": "email exists", "dan": "accepted"}


def test_csv_line_numbers_are_exact_per_file(spark, tmp_path):
    from pricewise.sources.files import read_prices_csv
    hdr = "date,market,state,district,variety,min_price,max_price,modal_price,arrival_quantity\n"
    (tmp_path / "a.csv").write_text(hdr + "".join(f"2024-01-01,A{i},S,D,V,1,3,2,0\n" for i in range(3)))
    (tmp_path / "b.csv").write_text(hdr + "".join(f"2024-01-02,B{i},S,D,V,1,3,{9 if i == 1 else 2},0\n" for i in range(4)))
    df = read_prices_csv(spark, str(tmp_path))
    got = sorted((r.market, r.file_row) for r in df.collect())
    assert got == [("A0", 0), ("A1", 1), ("A2", 2), ("B0", 0), ("B1", 1), ("B2", 2), ("B3", 3)]
    rep = Q.reject_report(Q.validate_prices(df)).first()
    assert rep.errors == "Row 3: " + Q.REASON_MODAL


def test_csv_columns_by_name(spark, tmp_path):
    from pricewise.sources.files import read_prices_csv
    (tmp_path / "c.csv").write_text("market,modal_price,date,state,district,variety,max_price,min_price\n"
                                    "Q,15,2024-01-01,S,D,V,20,10\n")
    r = Q.validate_prices(read_prices_csv(spark, str(tmp_path / "c.csv"))).first()
    assert (r.market, r.min_price, r.modal_price, r.max_price, r.arrival_quantity, r.reject_reason) == \
        ("Q", 10.0, 15.0, 20.0, 0.0, None)


def test_flags_changes_and_candidates(spark):
    from pricewise.functions import predicates as P
    from pricewise.operators import quality as Q
    m = spark.createDataFrame([(1, True), (2, False)], "id int, is_read boolean")
    ids = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [r.is_read for r in Q.set_flag(m, ids, True, "is_read").collect()] == [True, True]
    changes = spark.createDataFrame([(1, False, 1), (1, True, 2)], "id int, is_read boolean, at int")
    assert sorted((r.id, r.is_read) for r in Q.update_by_key(m, changes, order_col="at").collect()) == [(1, True), (2, False)]
    assert Q.update_by_key(m, changes.drop("at")).count() == 2
    users = spark.createDataFrame([("old", "o@x")], "username string, email string")
    new = spark.createDataFrame([("a", "a@x"), ("a", "b@x"), ("c", "a@x"), ("old", "z@x")], "username string, email string").coalesce(1)
    got = {(r.username, r.email): r.status for r in Q.check_unique_users(users, new).collect()}
    twins = spark.createDataFrame([(i, "same", f"{i}@x") for i in (5, 2, 9)], "n long, username string, email string").repartition(3)
    assert {r.n: r.status for r in Q.check_unique_users(users, twins, order_col="n").collect()} == {2: "accepted", 5: "username exists", 9: "username exists"}
    assert got == {("a", "a@x"): "accepted", ("a", "b@x"): "username exists", ("c", "a@x"): "email exists", ("old", "z@x"): "username exists"}
    names = spark.createDataFrame([("all",), ("b",)], "name string")
    assert names.filter(P.contains("name", "all")).count() == 1 and names.filter(~P.exact("name", "all")).count() == 1


def test_upsert_joins_only_rows_between_the_keys_of_the_upload(spark):
    """stored rows outside the upload's range of keys take no part in a join; null keys match nothing and stay."""
    import datetime as dt

    from pyspark.sql import functions as F

    from pricewise.operators.quality import upsert_prices
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    schema = "id long, market string, date date, modal_price double"
    rows = [(i, f"M{i % 3}", day(i // 3), float(i)) for i in range(90)] + [(900, None, day(3), 1.0), (901, "M1", None, 2.0)]
    target = spark.createDataFrame(rows, schema)
    new = [(None, "M1", day(10), 5.0), (None, "M1", day(40), 6.0), (None, None, day(3), 7.0)]
    got = sorted(map(tuple, upsert_prices(target, spark.createDataFrame(new, schema)).collect()), key=str)
    kept = [r for r in rows if (r[1], r[2]) != ("M1", day(10))]
    ids = sorted(r[0] for r in got if r not in kept)
    assert sorted(ids) == [31, 902, 903] and all(r in got for r in kept) and len(got) == len(rows) + 2
    assert (31, "M1", day(10), 5.0) in got
    none = upsert_prices(target, spark.createDataFrame([], schema))
    assert sorted(map(tuple, none.collect()), key=str) == sorted(rows, key=str)
    tagged = target.withColumn("modal_price", F.when(F.col("date") > day(20), F.raise_error(F.lit("joined")).cast("double")).otherwise(F.col("modal_price")))
    plan = upsert_prices(tagged, spark.createDataFrame(new[:1], schema))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("2024-01-11") >= 2
