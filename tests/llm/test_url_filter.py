import numpy as np

from tagwell.llm import url_filter

URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/es/x", "http://a.example.org/en/12?q", "https://a.b.org", "http://org/", "http://x.com/fr/?a#b", "http://x.com:80/fr/",
        "ftp://com/de/", "http://notexample.org/es/", "x?u=http://c.com/de/1", "http://É.com/de/", "http://a.org?x/y", "http://example.org/es/x", "http://example.org/es/x"]


def brute(url, rules, default="allow"):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([len(rest), *(rest.find(c) for c in "/?#" if c in rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:]
        path = tail[: min([len(tail), *(tail.find(c) for c in "?#" if c in tail)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {i: brute(u, url_filter.RULES) for i, u in enumerate(URLS)}


def test_empty_table_and_empty_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.filter_urls(pages.where("false")).collect() == []
    assert [tuple(r) for r in url_filter.filter_urls(pages, rules=()).collect()] == [(1, "a.org", "/", None, "allow")]


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda h, p: 7)
    url_filter.build(url_filter.RULES, f"file://{tmp_path}/r")
    array = url_filter.DigestArray(f"file://{tmp_path}/r")
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    hits = array.probe([b"org\n/", b"com\n/de/", b"else\n/"])
    assert [array.string(i) for i in hits[:2]] == [b"org\n/", b"com\n/de/"] and hits[2] == -1
    assert isinstance(hits, np.ndarray)
