"""All tabs counted in one pass equal each tab by itself."""

from siteloom.operators import views
from siteloom.plans.fixtures import tables


def test_counts_equal_tabs(spark, sf_dir):
    t = tables(spark, sf_dir)
    t["violations"] = spark.createDataFrame([(1,), (12,), (12,)], "page_id long")
    d = views.enrich(t, "example.com").cache()
    got = {r.tab: r.n for r in views.tab_counts(d, t).collect()}
    assert got == {name: views.tab(d, name, t).count() for name in views.TABS}
    empty = t | {"fx_sitemap": t["fx_sitemap"].limit(0)}
    assert {r.tab: r.n for r in views.tab_counts(d, empty).collect()}["sitemaps"] == d.count()
