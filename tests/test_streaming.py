from pricewise.streaming.ingest import read_table, start_price_ingest

HDR = "date,market,state,district,variety,min_price,max_price,modal_price,arrival_quantity\n"


def test_file_stream_upserts_and_rejects(spark, tmp_path):
    up, table, rej, ck = (str(tmp_path / n) for n in ("up", "table", "rej", "ck"))
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text(HDR + "2024-01-01,A,S,D,Red,10,20,15,5\n2024-01-01,B,S,D,Red,10,20,25,5\n")
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    (tmp_path / "up" / "b.csv").write_text(HDR + "2024-01-01,A,S,D,Red,10,20,18,5\n2024-01-02,A,S,D,Red,10,20,19,\n")
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    got = sorted((str(r.date), r.market, r.modal_price, r.arrival_quantity) for r in read_table(spark, table).collect())
    assert got == [("2024-01-01", "A", 18.0, 5.0), ("2024-01-02", "A", 19.0, 0.0)]
    assert [r.market for r in spark.read.parquet(rej).collect()] == ["B"]


def test_replay_duplicates_order_and_fresh_checkpoint(spark, tmp_path):
    """A duplicate key in the first batch, a replayed batch, two files with one key, and a fresh checkpoint."""
    import os
    import shutil
    import time
    up, table, rej, ck = (str(tmp_path / n) for n in ("up", "table", "rej", "ck"))
    (tmp_path / "up").mkdir()
    row = lambda price: HDR + f"2024-01-01,A,S,D,Red,10,20,{price},5\n"
    prices = lambda: [r.modal_price for r in read_table(spark, table).collect()]
    (tmp_path / "up" / "a.csv").write_text(row(19) + "2024-01-01,A,S,D,Red,10,20,11,5\n")
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    assert prices() == [11.0]
    for name in ("0", ".0.crc"):
        if os.path.exists(f"{ck}/commits/{name}"):
            shutil.move(f"{ck}/commits/{name}", str(tmp_path / f"lost{name}"))  # the batch is done, its commit is not known
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    assert prices() == [11.0]
    (tmp_path / "up" / "z_old.csv").write_text(row(12))
    (tmp_path / "up" / "b_new.csv").write_text("\n".join(row(13).split("\n")) + "\n" * 3)
    now = int(time.time())
    os.utime(tmp_path / "up" / "z_old.csv", (now + 60, now + 60))
    os.utime(tmp_path / "up" / "b_new.csv", (now + 120, now + 120))
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    assert prices() == [13.0]
    start_price_ingest(spark, up, table, rej, str(tmp_path / "ck2")).awaitTermination()  # all files again; the latest upload holds
    assert prices() == [13.0]


def test_batch_rewrites_only_its_months(spark, tmp_path):
    """Three batches: untouched months keep their files, replaced writes go after one more batch, ids stay unique."""
    up, table, rej, ck = (str(tmp_path / n) for n in ("up", "table", "rej", "ck"))
    (tmp_path / "up").mkdir()
    files = lambda month: sorted(str(f.relative_to(table)) for f in (tmp_path / "table" / "data").glob(f"*/month={month}"))

    def ingest(name, *rows):
        (tmp_path / "up" / name).write_text(HDR + "".join(f"{d},{m},S,D,Red,10,20,{p},5\n" for d, m, p in rows))
        start_price_ingest(spark, up, table, rej, ck).awaitTermination()
        return {(str(r.date), r.market): (r.id, r.modal_price) for r in read_table(spark, table).collect()}

    one = ingest("a.csv", ("2024-01-05", "A", 11), ("2024-01-06", "A", 12), ("2024-02-01", "A", 13))
    assert sorted(i for i, _ in one.values()) == [1, 2, 3]
    january, february = files("2024-01"), files("2024-02")
    two = ingest("b.csv", ("2024-02-01", "A", 14), ("2024-02-02", "B", 15))
    assert files("2024-01") == january and len(files("2024-02")) == 2 and february[0] in files("2024-02")
    assert two == {**one, ("2024-02-01", "A"): (one["2024-02-01", "A"][0], 14.0), ("2024-02-02", "B"): (4, 15.0)}
    three = ingest("c.csv", ("2024-02-03", "C", 16), ("2024-03-01", "C", 17))
    assert files("2024-01") == january and february[0] not in files("2024-02") and len(files("2024-02")) == 2
    assert sorted(i for i, _ in three.values()) == [1, 2, 3, 4, 5, 6]
    assert {k: three[k] for k in two} == two


def test_a_batch_holds_no_executor_memory_and_leaves_no_staged_rows(spark, tmp_path):
    """the typed rows of a batch are a table that goes with the batch, not a cache."""
    up, table, rej, ck = (str(tmp_path / n) for n in ("up", "table", "rej", "ck"))
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.csv").write_text(HDR + "2024-01-01,A,S,D,Red,10,20,15,5\n2024-01-01,B,S,D,Red,10,20,25,5\n")
    from pyspark.sql import DataFrame
    used, cache = [], DataFrame.cache
    DataFrame.cache = lambda self: used.append(1) or cache(self)
    try:
        start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    finally:
        DataFrame.cache = cache
    assert read_table(spark, table).count() == 1 and not used
    assert not list((tmp_path / "table" / "_staged").glob("*"))
