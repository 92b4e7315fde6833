"""Views that several reads share."""

from rankloom.plans.views import view, views


def test_line_items_are_aggregated_once(spark, tmp_path):
    rows = [(o, o % 7, o % 60, o % 3, float(o % 50), float(o), o % 10 / 100, o % 8 / 100) for o in range(200)]
    table = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    for name, df in zip(("run", "qrels", "qrels_jg"), views(spark, str(tmp_path), "run", "qrels", "qrels_jg"), strict=True):
        assert "lineitem" not in df.inputFiles()[0] and "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(df.collect()) == sorted(view(spark, str(tmp_path), name).collect())
