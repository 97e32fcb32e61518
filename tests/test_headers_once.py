"""The date in the name of a wide table's column is parsed once a column."""

from labtrail.sources.history import unpivot_history


def test_dates_of_columns_are_not_parsed_per_cell(spark):
    wide = spark.createDataFrame([("c", "TSH", "1", "2", None), ("c", "Zinc", "", "3", "4")], ["Test_Category", "Test_Name", "1-2-2024_City Lab", "odd", "3-2-2024"])
    out = unpivot_history(wide, "x.csv", {"name": "P"}, default_lab="General Lab", reformat_dates=True)
    rows = sorted((r.Test_Name, r.Test_Date, r.Lab_Name, r.Result, str(r.Test_Date_dt)) for r in out.collect())
    assert rows == [("TSH", "01-02-2024", "City Lab", "1", "2024-02-01"), ("TSH", "odd", "General Lab", "2", "None"), ("Zinc", "03-02-2024", "General Lab", "4", "2024-02-03"), ("Zinc", "odd", "General Lab", "3", "None")]
    plan = unpivot_history(wide, "x.csv", reformat_dates=True).select("Test_Date")._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in plan.split("Expand")[0].split("Join")[0].lower() and "BroadcastHashJoin" in unpivot_history(wide, "x.csv")._jdf.queryExecution().sparkPlan().toString()
