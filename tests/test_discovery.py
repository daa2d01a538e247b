"""Choice of files by their names, scans of the chosen ones only, workbooks, and digests by ranges."""

import datetime
import hashlib
import io
import zipfile
from datetime import date
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from replen.operators import maintenance
from replen.sources import digests, discovery, files

HEADER = "order_id,sale_date,sku,quantity,unit_price,total_amount\n"


def line(order):
    return f"{HEADER}{order},2020-02-03,CH0010101,2,1.5,3.0\n,,,,,\n"


def workbook(rows, late=False, inline=False):
    """Bytes of a small workbook; texts are shared or inline, numbers plain, None is no cell."""
    shared, out = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, str) and inline:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><workbookPr date1904="{int(late)}"/><sheets><sheet name="a" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>' for s in shared)}</sst>")
    return data.getvalue()


def test_best_files_are_chosen_by_name_alone(spark, tmp_path):
    inner = tmp_path / "[old] files"
    inner.mkdir()
    (inner / "20200101-20201231.csv").write_text(line("o1"))
    (tmp_path / "20210101_20210401.csv").write_text(line("o3"))
    (tmp_path / "20220101-20220201.csv").write_text(line("o4"))
    for bad in ("20200101-20200630.parquet", "20210101-20210301.parquet", "2021.parquet", "20219901-20210501.parquet"):
        (tmp_path / bad).write_bytes(b"not parquet")  # opening one of these would fail
    listed = discovery.listing(spark, str(tmp_path))
    assert listed.columns == ["path", "name", "length", "modified"] and listed.count() == 7
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 0)  # content would raise
    try:
        assert {r.length for r in discovery.listing(spark, str(tmp_path), "*.parquet").collect()} == {11}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    rows = discovery.load_sales(spark, str(tmp_path))
    assert {r.order_id for r in rows.collect()} == {"o1", "o3", "o4"} and len(rows.inputFiles()) == 3
    row = rows.where("order_id = 'o3'").first()
    assert (row.source_file, row.file_start, row.file_end, row.quantity) == ("20210101_20210401.csv", date(2021, 1, 1), date(2021, 4, 1), 2)
    assert [r.order_id for r in discovery.load_sales(spark, str(tmp_path), date(2022, 5, 1)).collect()] == ["o4"]
    assert discovery.load_sales(spark, str(tmp_path), date(2019, 1, 1)).count() == 0


def test_files_that_span_years(spark):
    names = ["20200601-20210531.csv", "20210101-20210430.csv", "20210101-20210430.xlsx", "20210601-20220131.csv"]
    found = discovery.sales_files(spark.createDataFrame([(f"/d/{n}", n) for n in names], "path string, name string"))
    assert sorted(r["name"] for r in discovery.best_per_year(found).collect()) == [names[0], names[3]]
    assert [r["name"] for r in discovery.newest_of_year(found, date(2021, 2, 2)).collect()] == [names[3]]
    assert [r["name"] for r in discovery.newest_of_year(found, date(2020, 2, 2)).collect()] == [names[0]]


def test_a_snapshot_a_day(spark, tmp_path):
    head = "sku,product_name,net_price,gross_price,total_stock,available_stock,is_active\n"
    (tmp_path / "20210101.csv").write_text(head + "a,x,1,1,5,5,1\nb,x,1,1,5,5,0\n")
    (tmp_path / "20210101.parquet").write_bytes(b"not read")
    (tmp_path / "20210108.csv").write_text(head + "a,x,1,1,7,7,1\n")
    (tmp_path / "stock.csv").write_text(head)
    assert sorted((r.snapshot_date, r.available_stock) for r in discovery.load_stock(spark, str(tmp_path)).collect()) == [(date(2021, 1, 1), 5), (date(2021, 1, 8), 7)]
    latest = discovery.load_latest_stock(spark, str(tmp_path))
    assert [r.available_stock for r in latest.collect()] == [7] and len(latest.inputFiles()) == 1
    cached = spark.createDataFrame([(date(2021, 1, 8),), (None,)], "snapshot_date date")
    fresh = discovery.load_stock(spark, str(tmp_path), cached)
    assert [r.available_stock for r in fresh.collect()] == [5] and len(fresh.inputFiles()) == 1


def test_forecast_versions_prefer_workbooks(spark, tmp_path):
    direct = "forecast_2021_01_01_generated_2020_12_01.csv"
    (tmp_path / direct).write_text("forecast_date,sku,forecast\n2021-01-01,a,9\n")
    assert [(r.generated_date, r.forecast) for r in discovery.load_forecasts(spark, str(tmp_path)).collect()] == [(date(2020, 12, 1), 9.0)]
    for day in ("2021-01-05", "2021-02-05"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "forecast_a.csv").write_text(f"forecast_date,sku,forecast\n{day},a,1.5\n")
    (tmp_path / "2021-01-05" / "forecast_a.xlsx").write_bytes(workbook([("sku", "forecast", "forecast_date"), ("a", 2.5, 44201), ("b", None, "2021-01-06 00:00:00")]))
    rows = discovery.load_forecasts(spark, str(tmp_path))
    assert sorted((r.generated_date, r.sku, r.forecast, r.forecast_date) for r in rows.collect() if r.sku == "a") == [
        (date(2021, 1, 5), "a", 2.5, date(2021, 1, 5)), (date(2021, 2, 5), "a", 1.5, date(2021, 2, 5))]
    assert rows.where("sku = 'b'").select("forecast_date", "forecast").first() == (date(2021, 1, 6), None)
    near = discovery.load_forecasts(spark, str(tmp_path), date(2021, 2, 1))
    assert {r.generated_date for r in near.collect()} == {date(2021, 2, 5)} and discovery.load_forecasts(spark, str(tmp_path), date(2021, 7, 1)).count() == 0


@pytest.mark.parametrize("inline", [False, True])
def test_workbooks(spark, tmp_path, inline):
    day = datetime.date(2020, 2, 3)
    serial = lambda first: (day - first).days
    body = [("SKU ", "order_id", None, "Quantity", "sale_date", "total_amount"), ("CH<01", "o1", "x", 2, serial(date(1899, 12, 30)), "3,5"), (), (None, "o2", None, 2.0, None, 4.25)]
    (tmp_path / "20200101-20201231.xlsx").write_bytes(workbook(body, inline=inline))
    (tmp_path / "20210101-20211231.xlsx").write_bytes(workbook([body[0], ("z", "o3", None, 1, serial(date(1904, 1, 1)), None)], late=True, inline=inline))
    (tmp_path / "20220101-20221231.xlsx").write_bytes(workbook([], inline=inline))
    got = {r.order_id: (r.sku, r.quantity, r.sale_date, r.total_amount, r.unit_price, r.file_end.year) for r in discovery.load_sales(spark, str(tmp_path)).collect()}
    assert got == {"o1": ("CH<01", 2, day, None, None, 2020), "o2": (None, 2, None, 4.25, None, 2020), "o3": ("z", 1, day, None, None, 2021)}


def test_outlet_file_of_the_last_year(spark):
    names = ["Outlet 2020.csv", "outlet_2021.csv", "OUTLET2021.XLSX", "outlet.csv"]
    found = spark.createDataFrame([(f"/d/{n}", n) for n in names], "path string, name string")
    assert [(r["name"], r["format"]) for r in discovery.newest_outlet_file(found).collect()] == [(names[2], "xlsx")]


def tree(data, size):
    parts = [hashlib.sha256(data[i : i + size]).hexdigest() for i in range(0, max(len(data), 1), size)]
    if len(parts) == 1:
        return parts[0]
    nodes = [hashlib.sha256(",".join(parts[i : i + digests.FAN]).encode()).hexdigest() for i in range(0, len(parts), digests.FAN)]
    return hashlib.sha256(f"{len(data)}:{','.join(nodes)}".encode()).hexdigest()


def test_digests_do_not_depend_on_tasks(spark, tmp_path):
    sizes = {"one": 100, "two": 101, "many": 100 * 4096 * 2 + 7, "a b%20#?": 350}
    data = {n: bytes((i * 31 + i // 251) % 256 for i in range(k)) for n, k in sizes.items()}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    listed = discovery.listing(spark, str(tmp_path))
    (tmp_path / "empty").write_bytes(b"")
    data["empty"] = b""
    listed = listed.select("path", "name", "length").unionByName(spark.createDataFrame([(f"file:{tmp_path}/empty", "empty", 0)], "path string, name string, length long"))
    want = {n: tree(d, 100) for n, d in data.items()}
    for tasks in (1, 7):
        assert {r["name"]: r.file_hash for r in digests.file_digests(listed, tasks, 100).collect()} == want
    whole = {r["name"]: r.file_hash for r in digests.file_digests(listed).collect()}
    assert whole == {n: hashlib.sha256(d).hexdigest() for n, d in data.items()}  # what a log of plain digests holds
    assert digests.file_digests(listed.where("false")).count() == 0
    (tmp_path / "two").write_bytes(b"x")  # shorter than it was listed
    with pytest.raises(Exception, match="shorter"):
        digests.file_digests(spark.createDataFrame([(f"file:{tmp_path}/two", 101)], "path string, length long")).collect()


def test_each_content_is_admitted_once(spark, tmp_path):
    for n, text in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y"), ("d.csv", "z")):
        (tmp_path / n).write_text(text)
    found = digests.file_digests(discovery.listing(spark, str(tmp_path))).withColumn("file_type", F.lit("sales"))
    log = maintenance.import_log(found.where("name = 'd.csv'"))
    first = maintenance.admitted(found, log)
    assert [r["name"] for r in first.orderBy("name").collect()] == ["a.csv", "c.csv"]
    assert maintenance.admitted(found, log.unionByName(maintenance.import_log(first))).count() == 0
    other = found.withColumn("file_type", F.lit("stock"))
    assert maintenance.admitted(other, log).count() == 3


def test_current_year_file_starts_in_the_year(spark):
    rows = [("a", "20200601-20210531.csv"), ("b", "20210101-20210430.csv"), ("c", "20210601-20220131.csv")]
    start, end = files.span_in_name(F.col("source_file"))
    df = spark.createDataFrame(rows, "order_id string, source_file string").withColumns({"file_start": start, "file_end": end})
    assert [r.order_id for r in files.current_year_file(df, date(2021, 5, 1)).collect()] == ["c"]
