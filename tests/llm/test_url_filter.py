import string

import pytest

from sparkmend.llm import url_filter as uf
from sparkmend.llm.queries import URL_RULES

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
URLS = [
    "https://a.example.org/es/1", "http://example.org/en/12", "http://EXAMPLE.org/en/2", "http://x.com/fr/q?u=/de/", "http://com/de/",
    "http://notexample.org/es/", "http://myorg/x", "http://a.org", "http://a.org?x=1", "ftp://A.b.ORG/x#y", None, "", "no scheme",
    "http://", "://org/", "http://É.org/ü?", "http://u@org:80/", "http://a.org/é\nb/c", "x://y.com/fr/://z.org/", "http://" + "a." * 500 + "org/" + "p" * 5000,
    "http://example.org/es/1", "http://example.org/es/1",
]


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(LOW), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


RULE_SETS = [URL_RULES, [*URL_RULES, ("a.org", "", "block"), ("com", "/fr/", "block"), ("é.org", "/ü", "block"), ("", "/x", "block"), ("y.com", "/fr/:", "allow")], []]


@pytest.mark.parametrize("rules", RULE_SETS)
@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_against_brute_force_both_ways(spark, rules, bound):
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id int, url string, cand string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    effective = {(h, p): v for h, p, v in rules if h}
    if ("com", "/fr/") in effective and len(rules) > 6:
        effective[("com", "/fr/")] = "block"  # a repeated rule blocks if any of its rows does
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.filter_urls(df, table, max_index_bytes=bound).collect()}
    assert got == {i: brute(u, [(h, p, v) for (h, p), v in effective.items()]) for i, u in enumerate(URLS)}
    assert uf.filter_urls(df.limit(0), table, max_index_bytes=bound).collect() == []


def test_colliding_keys_are_told_apart(tmp_path):
    import numpy as np

    raws = [b"a/x", b"b/y", b"c/z"]
    body = uf.MAGIC + np.array([3], "<i8").tobytes() + np.array([5, 5, 9], "<i8").tobytes()
    body += np.array([3, 6, 9], "<i8").tobytes() + np.array([1, 1, 1], "<i4").tobytes() + bytes([0, 1, 0]) + b"".join(raws)
    (tmp_path / "i.bin").write_bytes(body)
    index = uf.Index(str(tmp_path / "i.bin"))
    assert list(index.find(np.array([5, 5, 9, 9, 7]), ["b/y", "a/x", "c/z", "no", "a/x"], [1] * 5)) == [1, 0, 2, -1, -1]
