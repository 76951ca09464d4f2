"""Written dates and what they may mean."""

from datetime import date

from pagewright.functions import dates as D
from pyspark.sql import functions as F

CASES = {
    "2024-03-05": ("2024-03-05", "2024-03-05"), "2024-03-05T10:00:00Z": ("2024-03-05", "2024-03-05"), "5 March 2024": ("2024-03-05", "2024-03-05"), "March 5th, 2024": ("2024-03-05", "2024-03-05"),
    " 1st  of Sept. 2020 ": ("2020-09-01", "2020-09-01"), "Feb 2024": ("2024-02-01", "2024-02-29"), "2023-2": ("2023-02-01", "2023-02-28"), "2024": ("2024-01-01", "2024-12-31"),
    "5/3/2024": ("2024-03-05", "2024-05-03"), "25.3.2024": ("2024-03-25", "2024-03-25"), "3/25/2024": ("2024-03-25", "2024-03-25"), "4/4/2024": ("2024-04-04", "2024-04-04"),
    "2024-02-30": None, "31/31/2024": None, "soon": None, "": None, None: None, "20245": None, "v2024": None,
}


def test_intervals(spark):
    rows = spark.createDataFrame([(v,) for v in CASES], "value string").select("value", D.date_interval(F.col("value")).alias("d"))
    assert {r["value"]: r["d"] and tuple(map(date.isoformat, r["d"])) for r in rows.collect()} == CASES


def test_conflicts(spark):
    rows = [(1, "updated", "2024"), (1, "updated", "March 2024"), (1, "updated", "3/4/2024"), (1, "made", "2020"), (1, "made", "2021-01-01"), (2, "updated", "5/3/2024"), (2, "updated", "3 May 2024"), (3, "made", "soon"), (None, None, "2024"), (None, None, "2023")]
    got = {(r["page_id"], r["kind"]): (r["dates"], r["conflict"]) for r in D.date_conflicts(spark.createDataFrame(rows, "page_id int, kind string, value string")).collect()}
    assert got == {(1, "updated"): (3, False), (1, "made"): (2, True), (2, "updated"): (2, False), (None, None): (2, True)}
