"""The source of dated readings: what a query filters is what is asked for."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from lodeweave.sources import service

ASK = '''
import json, os, uuid
def ask(request):
    open(os.path.join(request["path"], f"asked-{uuid.uuid4().hex}"), "w").write(json.dumps(request))
    day = request["start"]
    if request["place"] == "Nowhere":
        return None
    rows = [{"date": f"{day[:4]}-{m:02d}-01T00:00:00", "station": "s" + str(m % 2), "value": m} for m in range(1, 13) if day <= f"{day[:4]}-{m:02d}-01" <= request["end"]]
    return json.dumps({"count": len(rows), "results": rows[request["offset"] - 1 : request["offset"] - 1 + request["limit"]]})
'''


@pytest.fixture
def ask(spark, tmp_path):
    (tmp_path / "asks_for_tests.py").write_text(ASK)
    spark.sparkContext.addPyFile(str(tmp_path / "asks_for_tests.py"))
    service.register(spark)
    table = spark.read.format("readings").options(fetch="asks_for_tests:ask", places=json.dumps(["Rome", "Oslo", "Nowhere"]), start="2018-06-15", end="2020-12-31", limit="5", path=str(tmp_path)).load()

    def asked():
        out = []
        for f in tmp_path.glob("asked-*"):
            out.append(json.loads(f.read_text()))
            f.unlink()
        return sorted((r["place"], r["start"], r["end"], r["offset"]) for r in out)

    return table, asked


def test_filters_become_requests(spark, ask):
    table, asked = ask
    assert table.count() == 2 * (6 + 12 + 12)
    every = asked()
    assert len({r[:3] for r in every}) == 9 and ("Nowhere", "2018-06-15", "2018-12-31", 1) in every and ("Rome", "2019-01-01", "2019-12-31", 11) in every
    rows = table.where("city = 'Rome' and date >= '2019-11-01' and date < '2020-02-01'").collect()
    assert sorted((r.date.isoformat()[:10], r.stationid, r.city, r.value) for r in rows) == [("2019-11-01", "s1", "Rome", 11.0), ("2019-12-01", "s0", "Rome", 12.0), ("2020-01-01", "s1", "Rome", 1.0)]
    assert asked() == [("Rome", "2019-11-01", "2019-12-31", 1), ("Rome", "2020-01-01", "2020-02-01", 1)]
    assert table.where(F.col("city").isin("Oslo", "Paris") & (F.col("date") == "2020-03-01")).count() == 1
    assert asked() == [("Oslo", "2020-03-01", "2020-03-01", 1)]
    assert table.where("city = 'Paris'").count() == 0 and table.where("date > '2021-05-01'").count() == 0 and asked() == []
    # what isn't a place or a date is checked by Spark
    assert table.where("value > 11 and city = 'Oslo'").count() == 3 and len({r[:3] for r in asked()}) == 3


def test_recorded_answers(spark, tmp_path):
    service.register(spark)
    (tmp_path / "Rome_2019-01-01_1.json").write_text(json.dumps({"count": 1, "results": [{"date": "2019-05-01T00:00:00", "station": "s", "value": None}]}))
    (tmp_path / "Rome_2020-01-01_1.json").write_text(json.dumps({"metadata": {}}))
    table = spark.read.format("readings").options(places='["Rome"]', start="2019-01-01", end="2020-06-01", path=str(tmp_path)).load()
    assert [(r.date.year, r.stationid, r.value) for r in table.collect()] == [(2019, "s", None)]


def test_years():
    assert list(service.years(date(2019, 12, 31), date(2021, 1, 1))) == [(date(2019, 12, 31), date(2019, 12, 31)), (date(2020, 1, 1), date(2020, 12, 31)), (date(2021, 1, 1), date(2021, 1, 1))]
    assert list(service.years(date(2020, 1, 2), date(2020, 1, 1))) == []
