import random

import numpy as np

from strata.llm.registry import URL_RULES
from strata.llm.url_filter import DigestArray, digest_file, host_and_path, judge_urls


def by_definition(url, rules, default="allow"):
    host, path = host_and_path(url)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), len(h), rule, verdict))
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_host_and_path():
    assert host_and_path("HTTP://A.Org/x/y?q#f") == ("a.org", "/x/y")
    assert host_and_path("a://É.COM#x/y") == ("É.com", "")
    assert host_and_path("http://h?x/y") == ("h", "")
    assert host_and_path("no scheme") == ("", "") == host_and_path(None)
    assert host_and_path("x:///p") == ("", "/p")


def test_rules_by_definition(spark):
    rng = random.Random(5)
    urls = [None, "", "x", "http://org", "http://org/", "http://.org/", "http://xorg/", "ftp://a.b.example.org/en/12#t",
            "http://EXAMPLE.org/es/q", "http://example.org/es", "http://com/fr/", "http://é.com/de/x" * 2000]
    urls += [f"http://{rng.choice(['a.', '', 'x.y.'])}{rng.choice(['example.org', 'org', 'com', 'net'])}"
             f"/{rng.choice(['es/', 'en/1', 'en/2', 'fr/', 'de/', ''])}{rng.choice(['', 'z', '?q', '#t'])}" for _ in range(300)]
    urls += urls[:20]
    rows = [(None if i == 3 else i // 2, u, "h", "r", "v") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")
    got = sorted(map(tuple, judge_urls(pages, URL_RULES).collect()), key=repr)
    want = sorted(((i, *by_definition(u, URL_RULES)) for i, u, *_ in rows), key=repr)
    assert got == want


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judge_urls(pages, URL_RULES).collect() == []
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert judge_urls(pages, [], default="block").collect()[0].verdict == "block"


def test_equal_keys_are_told_apart_by_the_string(tmp_path, monkeypatch):
    import strata.llm.url_filter as U
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "a.bin"
    path.write_bytes(digest_file([("block", "a/x"), ("allow", "b/y")]))
    array = DigestArray(str(path))
    assert [array.verdicts[i] if i >= 0 else None for i in array.find([b"b/y", b"a/x", b"c/z"])] == [0, 1, None]
    assert np.all(array.keys == 7)


def test_very_long_hosts_make_few_keys(spark):
    host = "a." * 500_000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{host}/en/1x"), (2, f"http://{host[:-1]}/en/1x"), (3, "http://" + "b" * 1_000_000 + "/fr/")],
                               "page_id long, url string")
    got = {r.page_id: (r.host, r.rule) for r in judge_urls(df, [("block", "example.org/en/1"), ("allow", "org/")]).collect()}
    assert got[1] == (host, "example.org/en/1") and got[2][1] is None and got[3][1] is None
