import random

from tallyforge.llm import url_filter
from tallyforge.llm.queries import RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def verdict(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, "allow"
    best = max(f[:3] for f in fit)
    return host, path, best[2], max(f[3] for f in fit if f[:3] == best)


ODD = [None, "", "example.org/es/", "http://", "HTTP://Sub.EXAMPLE.org/es/x?y#z", "http://example.org", "http://example.org?x=/es/", "a://b://example.com/fr/",
       "http://notexample.org/es/", "http://example.org/en/1", "http://example.org/en/12/3", "http://x.com/de/#a", "http://com/de/", "http://É.COM/fr/é",
       "http://a..org/", "line\nbreak://x.org/es/\n", "http://x.org//es/", "http://" + "a." * 60 + "org/" + "p" * 5000]


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    urls = ODD + [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(['example', 'other', 'Q'])}.{rng.choice(['org', 'com', 'net'])}"
                  f"{rng.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/x', '/de/'])}{rng.choice(['', '9', '?q=1', '#f'])}" for _ in range(300)]
    rows = [(i, u, "h", "r", "v") for i, u in enumerate(urls)] + [(7, urls[7], "h", "r", "v"), (None, urls[20], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, verdict string")
    rules = [*RULES, ("block", "org", "/"), ("allow", "c.example.com", ""), ("block", "example.org", "/es/"), ("allow", "EXAMPLE.net", "/de/")]
    for held in (RULES, rules):
        got = url_filter.judge_pages(pages, url_filter.rule_table(spark, held))
        lowered = [(v, h.lower(), p) for v, h, p in held]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *verdict(u, lowered)) for i, u, *_ in rows), key=repr)


def test_no_rules_no_pages_and_null_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    none = url_filter.judge_pages(pages, url_filter.rule_table(spark, []), otherwise="block")
    assert sorted(tuple(r) for r in none.select("page_id", "rule", "verdict").collect()) == [(1, None, "block"), (2, None, "block")]
    nulls = spark.createDataFrame([(None, "org", "/"), ("block", None, "/"), ("block", "org", None), ("block", "org", "/")], url_filter.RULE_SCHEMA)
    assert {r.verdict for r in url_filter.judge_pages(pages.where("page_id = 1"), nulls).collect()} == {"block"}
    assert url_filter.judge_pages(pages.where("false"), url_filter.rule_table(spark, RULES)).collect() == []
