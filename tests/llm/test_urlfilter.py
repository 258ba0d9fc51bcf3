import datetime as dt

import pytest

from loomspark.llm import urlfilter as u


def test_as_of(spark):
    entries = spark.createDataFrame([("bad.org", "host", "spam", "add", "2024-01-10"), ("bad.org", "host", "spam", "drop", "2024-02-10"), ("ok.com/ads", "prefix", "ads", "add", "2024-01-01"), ("sub.bad.org", "host", "worse", "add", "2024-01-01"), (None, "host", "x", "add", "2024-01-01")], "pattern string, kind string, category string, action string, day string").withColumn("day", u.F.col("day").cast("date"))
    d = dt.date
    rows = [(1, "http://bad.org/x", d(2024, 1, 9)), (2, "http://WWW.Bad.org:80/x", d(2024, 1, 10)), (3, "http://a.bad.org", d(2024, 2, 9)), (4, "http://bad.org", d(2024, 2, 10)), (5, "http://sub.bad.org./", d(2024, 1, 15)), (6, "https://u@ok.com/ads/1?q", d(2024, 1, 1)), (7, "http://ok.com/adsx", d(2024, 1, 1)), (8, None, d(2024, 1, 1)), (9, "http://bad.org", None), (10, "nonsense", d(2024, 1, 15)), (2, "http://WWW.Bad.org:80/x", d(2024, 1, 10)), (11, "http://notbad.org", d(2024, 1, 15))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, fetched date, pattern string")
    got = sorted(((r.page_id, r.pattern) for r in u.evaluate(df, entries).collect() if r.blocked))
    assert got == [(2, "bad.org"), (2, "bad.org"), (3, "bad.org"), (5, "sub.bad.org"), (6, "ok.com/ads")]
    assert u.evaluate(df, entries).count() == len(rows)
    assert u.evaluate(df, entries.where("false")).where("blocked").count() == 0
    assert u.evaluate(df.where("false"), entries).count() == 0


def entry_list(spark, *rows):
    return spark.createDataFrame([(p, k, "c", "add", "2024-01-01") for p, k in rows], "pattern string, kind string, category string, action string, day string").withColumn("day", u.F.col("day").cast("date"))


def test_kinds_and_long_urls(spark):
    """A prefix isn't a host, nor a host a prefix; only as many keys as the list's bounds allow; empty steps don't count."""
    day = dt.date(2024, 5, 1)
    urls = ["http://a.org/x/y/z", "http://sub.a.org/x/y", "http://a.org//x///y?q", "http://b.co.uk/", "http://co.uk", "http://c.org/p", "http://d.org/" + "s/" * 200_000]
    df = spark.createDataFrame([(i, x, day) for i, x in enumerate(urls)], "page_id long, url string, fetched date")
    entries = entry_list(spark, ("A.org/x//y/", "prefix"), ("b.co.uk", "host"), ("c.org/p", "host"), ("d.org/s/s", "prefix"))
    got = {r.page_id: r.pattern for r in u.evaluate(df, entries).collect()}
    assert got == {0: "a.org/x/y", 1: None, 2: "a.org/x/y", 3: "b.co.uk", 4: None, 5: None, 6: "d.org/s/s"}
    assert df.select(u.F.size(u.keys_of(u.F.col("url"), 2, 2)).alias("n")).agg(u.F.max("n")).first()[0] <= 4
    with pytest.raises(Exception, match="no kind of entry"):
        u.evaluate(df, entry_list(spark, ("a.org", "other"))).collect()
