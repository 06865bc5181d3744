"""What an ingested batch leaves on disk."""
import gzip
import os

from pricewise.streaming.ingest import read_table, start_price_ingest

HDR = "date,market,state,district,variety,min_price,max_price,modal_price,arrival_quantity\n"


def stored_tables(spark):
    from pricewise.session import shared_path
    top = shared_path(spark, "stored").removeprefix("file:")
    return {f"{name}/{x}" for name in (os.listdir(top) if os.path.isdir(top) else []) for x in os.listdir(f"{top}/{name}")}


def test_batches_leave_no_tables_and_read_packed_uploads(spark, tmp_path):
    """the upsert's own tables go with the batch, and an upload may be compressed."""
    up, table, rej, ck = (str(tmp_path / n) for n in ("up", "table", "rej", "ck"))
    (tmp_path / "up").mkdir()
    before = stored_tables(spark)
    with gzip.open(tmp_path / "up" / "a.csv.gz", "wt") as f:
        f.write(HDR + "2024-01-01,A,S,D,Red,10,20,15,5\n2024-02-01,B,S,D,Red,10,20,16,5\n2024-02-01,B,S,D,Red,10,20,17,5\n")
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    with gzip.open(tmp_path / "up" / "b.csv.gz", "wt") as f:
        f.write(HDR + "2024-01-01,A,S,D,Red,10,20,18,5\n2024-01-02,C,S,D,Red,10,20,-1,5\n2024-01-03,C,S,D,Red,10,20,19,5\n")
    start_price_ingest(spark, up, table, rej, ck).awaitTermination()
    got = sorted((r.id, str(r.date), r.market, r.modal_price) for r in read_table(spark, table).collect())
    assert got == [(1, "2024-01-01", "A", 18.0), (2, "2024-02-01", "B", 17.0), (3, "2024-01-03", "C", 19.0)]
    assert stored_tables(spark) == before
    assert not os.listdir(f"{table}/_staged")


def test_a_packed_export_reads_back(spark, tmp_path):
    from datetime import date

    from pricewise.schemas import PRICES
    from pricewise.sources.files import export_prices_csv
    rows = [(i, date(2024, 1, 1 + i), "A", "S", "D", "Red", 10.0, 20.0, 15.0, 5.0) for i in range(5)]
    p = spark.createDataFrame(rows, "id long, date date, market string, state string, district string, variety string, "
                              "min_price double, max_price double, modal_price double, arrival_quantity double").select(*[f.name for f in PRICES.fields])
    plain, packed = (spark.read.option("header", True).csv(export_prices_csv(p, str(tmp_path / c), compression=c)) for c in ("none", "gzip"))
    assert sorted(plain.collect()) == sorted(packed.collect()) and plain.count() == 5
    assert all(f.endswith((".csv.gz", ".crc", "_SUCCESS")) for f in os.listdir(tmp_path / "gzip"))
