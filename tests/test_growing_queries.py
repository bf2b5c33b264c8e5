"""Samples and overviews are registered over tables that grow."""

from widen.plans.registry import load_all


def test_sample_and_overview_of_orders(spark):
    queries, _ = load_all()
    rows = {sf: spark.read.parquet(f"/root/testdata/{sf}/orders.parquet").count() for sf in ("sf0.001", "sf0.01")}
    assert rows["sf0.001"] < rows["sf0.01"]
    for sf, n in rows.items():
        d = f"/root/testdata/{sf}"
        assert queries["table_overview_orders"](spark, d).collect()[0].n_rows == n
        assert [r["rank"] for r in queries["head_sample_orders"](spark, d).collect()] == [1, 2, 3]
