"""Issues of pages whose titles and headings end inside a character reference, as cutting markup to so many characters leaves them."""

import duckdb
import pytest

from siteloom.plans import registry

QUERIES = ("crawl_page_rules", "issue_list", "issue_groups", "issues_by_severity", "crawl_issue_summary")


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Titles of 27 characters and a reference cut at each place: decoded, an open one leaves a title under 30. Two pages share each URL."""
    ends = [r[:n] for r in ("&amp;", "&quot;", "&lt;", "&copy;") for n in range(1, len(r) + 1)]
    titles = [f"{k:02d} wide titles of pages wix{e}" for k, e in enumerate(reversed(ends))]
    rows = [(k, f"https://t.example.net/en/{k // 2}", f'<!DOCTYPE html><html lang="en"><head><title>{t}</title></head><body><h1>{t}</h1><a href="/en/{k}">to {t}</a><p>Some text.</p></body></html>') for k, t in enumerate(titles)]
    path = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, cut, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{cut}/pages.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    expected = sorted(tuple(map(str, r)) for r in cur.fetchall())
    assert expected and sorted(tuple(map(str, r)) for r in registry.queries()[name](spark, cut).select(*names).collect()) == expected


def test_issue_list_has_one_order(spark, cut):
    """Issues of one type and URL are ordered by their element."""
    found = [tuple(r) for r in registry.queries()["issue_list"](spark, cut).select("issue_type", "url", "element").collect()]
    assert len(found) > len({r[:2] for r in found}) and found == sorted(found)
