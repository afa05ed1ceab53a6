from pyspark.sql import functions as F

from scenemill.llm import queries as q
from scenemill.llm import url_filter
from tests.oracle import connect, differences


def brute(captures, entries):
    out = {}
    for page, url, day in captures:
        host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].split(":")[0].lower()
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        path = rest[len(rest.split("/")[0]) :]
        first = "/".join(path.split("/")[:2])
        labels = host.split(".")
        keys = ([host + first] if len(first) > 1 else []) + [".".join(labels[i:]) for i in range(len(labels))]
        best = None
        for pos, key in enumerate(keys):
            for name in {e[0] for e in entries}:
                past = [e for e in entries if e[0] == name and e[1] == key and e[2] <= day]
                if past:
                    last = max(past, key=lambda e: (e[2], e[3]))
                    if last[3] != "remove":
                        best = min(x for x in (best, (pos, last[3], name, key)) if x is not None)
        out[page, day] = ("pass", None, None) if best is None else (best[1], best[3], best[2])
    return out


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = [tuple(r) for r in q.page_captures(pages).collect()]
    entries = [tuple(r) for r in q.page_list(pages).collect()]
    got = {(r.page_id, r.day): (r.verdict, r.rule, r["list"]) for r in q.queries()["op3_url_temporal_filter"](spark, sf_dir).collect()}
    assert got == brute(captures, entries) and {v[0] for v in got.values()} > {"pass"}


def test_as_of(spark):
    entries = spark.createDataFrame([("l", "ads.com", 5, "block"), ("l", "ads.com", 9, "remove"), ("l", "ok.ads.com", 6, "allow"), ("l", None, 1, "block"), ("l", "ads.com", 5, "allow")], "list string, rule string, day int, action string")
    rows = [(1, "http://x.ads.com/a", 4), (2, "http://x.ads.com/a", 5), (3, "http://x.ads.com", 8), (4, "http://x.ads.com", 9), (5, "http://ok.ads.com/", 7), (6, None, 7), (7, "", 7), (8, "no url", 7), (9, "http://ads.com", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, day int").withColumns({"rule": F.lit(1), "list": F.lit(2)})
    got = {r.page_id: r.verdict for r in url_filter.judge(df, entries).collect()}
    assert got == {1: "pass", 2: "block", 3: "block", 4: "pass", 5: "allow", 6: "pass", 7: "pass", 8: "pass", 9: "pass"}
    assert url_filter.judge(df.limit(0), entries).count() == 0
    assert {r.verdict for r in url_filter.judge(df, entries.limit(0)).collect()} == {"pass"}


def test_same_as_sql(spark, sf_dir):
    sql = q.oracle_sql()["op3_url_temporal_filter"]
    assert not differences(q.queries()["op3_url_temporal_filter"](spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df())


def test_odd_hosts_ties_and_repeats(spark):
    entries = spark.createDataFrame([("b", "ads.com", 1, "block"), ("a", "ads.com", 1, "block"), ("b", "ads.com/x", 1, "allow"), ("a", "ads.com/x", 1, "block"), ("a", "[::1]", 1, "block"), ("a", "ads.com", 1, "block")], "list string, rule string, day int, action string")
    rows = [(1, "http://ADS.com./y", 5), (2, "http://u:p@ads.com:80/x/z?q", 5), (3, "https://[::1]:8080/a", 5), (4, "http://ads.com/y", 5), (4, "http://ads.com/y", 5), (5, "http://ads.com/" + "z" * 200_000, 5), (None, "http://ads.com", 5), (6, "http://...", 5)]
    got = {r.page_id: (r.verdict, r.rule, r["list"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, day int"), entries).collect()}
    assert got == {1: ("block", "ads.com", "a"), 2: ("allow", "ads.com/x", "b"), 3: ("block", "[::1]", "a"), 4: ("block", "ads.com", "a"), 5: ("block", "ads.com", "a"), None: ("block", "ads.com", "a"), 6: ("pass", None, None)}
