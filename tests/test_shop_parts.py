"""The made site's pages are dealt out before they are parsed."""

from pyspark.sql import functions as F

from siteloom.plans.shop import shop_tables


def test_customers_are_not_one_task(spark, sf_dir):
    headings = shop_tables(spark, sf_dir)["fx_headings"].where("page_id >= 1000000000000").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()
    assert max(r.n for r in headings) < sum(r.n for r in headings) / 2
