import re

from anchorline.llm import url_filter as U
from anchorline.llm.registry import QUERIES, URL_RULES
from tests.llm.plain import FOLDER

ODD = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "http://x.com?q=/en/", "http://x.com#f/en/", "https://x.net/es/1?u=a/b#c",
    "x://y.com://z/en/", "http://example.com/en", "http://example.com/en/1", "http://www.example.com/en/1",
    "http://a.www.example.com/en/1", "http://wwwexample.com/en/1", "http://com/", "http://É.com/é", "http://notnet/es/1",
    "http://a.net/es/", "http://a.net/es", "://h/p", "http://a.com/\nx",
]


def plain(url):
    """Host, path, rule and its verdict."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for text, verdict in URL_RULES:
        rule_host, rule_path = text.split("/", 1)
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path)
        if fits and (best[0] is None or len(text) > len(best[0])):
            best = (text, verdict)
    return host, path, *best


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(ODD)], "page_id long, url string, path string")
    got = U.apply_rules(U.with_host_and_path(df), URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.label) for r in got} == {i: plain(u) for i, u in enumerate(ODD)}


def judged(spark, rows, **limits):
    df = spark.createDataFrame(rows, "host string, path string, label string")
    return {(r.host, r.path): r for r in U.judge(df, **limits).collect()}


def test_templates_generalise_merge_and_reject(spark):
    rows = [("a", f"/ads/{i}.html", "block") for i in range(8)] + [("a", f"/ads/x{i}y.html", None) for i in range(5)]
    rows += [("a", f"/news/{i}", "allow") for i in range(8)] + [("a", "/news/99", None)]
    rows += [("a", f"/{c}{d}/page", None) for c in "abcdefghij" for d in "klmno"]  # many rare branches
    rows += [("b", "/ads/1.html", None)]
    got = judged(spark, rows)
    assert got["a", "/ads/x1y.html"].rejected is False or got["a", "/ads/x1y.html"].template == got["a", "/ads/1.html"].template
    assert got["a", "/ads/3.html"].rejected and not got["a", "/news/99"].rejected
    assert got["a", "/news/99"].template_purity == 1 / 10 and got["a", "/ads/3.html"].template_purity == 9 / 10
    assert got["a", "/ak/page"].template == got["a", "/jo/page"].template == "/*/page"
    assert got["b", "/ads/1.html"].template_purity == 0.5 and not got["b", "/ads/1.html"].rejected  # per host


def test_branches_with_other_labels_stay_apart(spark):
    rows = [("a", f"/es/{i}", "block") for i in range(20)] + [("a", f"/en/{i}", None) for i in range(60)]
    rows += [("a", f"/fr/{i}", "block") for i in range(15)] + [("a", f"/de/{i}", None) for i in range(50)]
    got = judged(spark, rows)
    assert got["a", "/es/1"].template == got["a", "/fr/1"].template != got["a", "/en/1"].template
    assert got["a", "/en/1"].template == got["a", "/de/1"].template
    assert got["a", "/fr/2"].rejected and not got["a", "/de/2"].rejected


def test_edge_cases(spark):
    deep = "/" + "/".join(f"s{i}" for i in range(40))
    rows = [("", "", None), ("a", "", None), ("a", "/", "block"), ("a", deep, "allow"), ("a", deep, "allow"), ("a", "/" + "x" * 20_000, None)]
    df = spark.createDataFrame(rows, "host string, path string, label string")
    assert U.judge(df).count() == len(rows)
    assert U.judge(df.limit(0)).count() == 0


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = QUERIES["op4_url_filter"](spark, FOLDER).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain(pages[r.page_id])
        method = "block" if r.template_purity >= 0.8 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or method)
