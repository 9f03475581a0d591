import pytest
from pyspark.sql import functions as F

from folioscope.sources import metric_import
from folioscope.sources.bulk import Refused
from folioscope.sources.metric_import import Limits, MetricStore

HEADER = "title,issn_l,issn,eissn,metric_year,category,jif,quartile,status,source"


def put(folder, *rows, header=HEADER, name="m.csv", bom=False):
    path = folder / name
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def row(issn="0378-5955", year=2025, category="x", jif="12.50", quartile="Q1", status="known", source="s", title="A"):
    return f"{title},{issn},,,{year},{category},{jif},{quartile},{status},{source}"


def test_an_import_is_a_transaction(spark, tmp_path):
    store = MetricStore(spark, str(tmp_path / "store"))
    one = put(tmp_path, row(), row(category="y", jif="", quartile="", status="unknown"), row(jif="12.5"), bom=True)
    first = store.take(one, "2026-01-01")
    assert first[0] == 1 and first[2:] == ("s", "2026-01-01", 3, 2, 1)
    assert store.take(one, "2026-02-02") == first and len(store.receipts()) == 1
    stored = lambda: sorted((r["issn_l"], r["metric_year"], r["category"], r["jif"]) for r in store.read().collect())
    held = [("0378-5955", "2025", "x", "12.5"), ("0378-5955", "2025", "y", None)]
    assert stored() == held
    # one key differs: nothing of the file counts
    with pytest.raises(Refused, match="1 keys differ"):
        store.take(put(tmp_path, row(category="new"), row(jif="13"), name="b.csv"), "2026-01-01")
    assert stored() == held and len(store.receipts()) == 1
    second = store.take(put(tmp_path, row(category="new", jif="0.10"), row(jif="0012.500", title="other"), name="c.csv"), "2026-01-03")
    assert (second.number, second.input, second.inserted, second.unchanged) == (2, 2, 1, 1)
    assert stored() == sorted([*held, ("0378-5955", "2025", "new", "0.1")])
    # rows without a receipt count for nothing
    spark.createDataFrame([("z", "1", "c")], "issn_l string, metric_year string, category string").write.parquet(str(tmp_path / "store/rows/000000000003=x"))
    (tmp_path / "store/receipts/000000000003").write_text('{"number": 3')
    assert stored() == sorted([*held, ("0378-5955", "2025", "new", "0.1")]) and len(store.receipts()) == 2


@pytest.mark.parametrize(
    ("rows", "header", "limits", "told"),
    [
        ([row()], HEADER.replace("issn_l,issn,", "issn_l, ,"), Limits(), "no name"),
        ([row()], HEADER.replace("eissn", "issn"), Limits(), "twice"),
        ([row()], HEADER.replace("jif", "impact"), Limits(), "missing"),
        ([], HEADER, Limits(), "no rows"),
        ([row(), row(category="y")], HEADER, Limits(rows=1), "more than 1 rows"),
        ([row()], HEADER, Limits(size=10), "bytes"),
        ([row(category="c" * 50)], HEADER, Limits(field_bytes=40), "row 2: field_bytes"),
        ([row(), row(category="y", source="t")], HEADER, Limits(), "several sources"),
        ([row(), row(issn="0378-5954")], HEADER, Limits(), "row 3: issn_l"),
        ([row(jif="1.1234567")], HEADER, Limits(), "decimal_places"),
        ([row(jif="-1")], HEADER, Limits(), "jif"),
        ([row(jif="1e3")], HEADER, Limits(), "jif"),
        ([row(quartile="Q5")], HEADER, Limits(), "quartile"),
        ([row(year=25)], HEADER, Limits(), "metric_year"),
        ([row(status="maybe")], HEADER, Limits(), "status"),
        ([row(jif="")], HEADER, Limits(), "known_without_value"),
        ([row(status="unknown")], HEADER, Limits(), "unknown_with_value"),
        ([row() + ",more"], HEADER, Limits(), "columns"),
        ([row(jif="1"), row(jif="2")], HEADER, Limits(), "1 keys differ"),
    ],
)
def test_a_file_gets_one_verdict(spark, tmp_path, rows, header, limits, told):
    store = MetricStore(spark, str(tmp_path / "store"))
    with pytest.raises(Refused, match=told):
        store.take(put(tmp_path, *rows, header=header), "2026-01-01", limits)
    assert store.receipts() == [] and store.read() is None


def test_decimals_have_one_text(spark):
    values = ["0", "00.0", "1.50", "01.5", "10", "0.001000", ".5", "5.", "", " 7.0 ", "1,5", None]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(metric_import.decimal_text(F.col("v")).alias("d")).collect()
    assert [r["d"] for r in got] == ["0", "0", "1.5", "1.5", "10", "0.001", None, None, None, "7", None, None]
