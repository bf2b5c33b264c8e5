"""Driver contract: entry() smoke check and registry consistency."""

import __spark_entry__ as e


def test_entry_runs(spark):
    df = e.entry(spark)
    n = df.count()
    assert n == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert df.columns[-3:] == ["o_totalprice", "o_orderpriority", "o_orderstatus"]


def test_every_oracle_has_a_query():
    qs, os_ = e.queries(), e.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 70


def test_sample_of_queries_run_on_smallest_data(spark):
    qs = e.queries()
    for name in ["augment_lineitem", "detect_keys", "cramers_v_2x2", "find_joinable", "ingest_replies",
                 "balance_classes", "macro_f1"]:
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0
