"""URL rules against a brute-force version."""

import random

from pacewright.llm.url_rules import judged_urls


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_against_brute_force(spark):
    rng = random.Random(3)
    labels, parts = ["a", "b", "com", "net", "É", ""], ["/", "a", "b", "/a", "en", "é", "%"]
    rules = {}
    for _ in range(60):
        h = ".".join(rng.choice(labels[:4]) for _ in range(rng.randint(1, 3)))
        rules[h, "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))] = rng.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "nothing", "://", "http://", "x://COM", "http://a.com?x#y", "a://b://com/a"]
    urls += ["h://" + ".".join(rng.choice(labels).upper() for _ in range(rng.randint(1, 5))) + "".join(rng.choice([*parts, "?", "#"]) for _ in range(rng.randint(0, 6))) for _ in range(500)]
    urls += ["h://" + "a." * 60 + "com/" + "/a" * 100_000, "h://b.com/" + "x" * 300_000 + "?y"]  # very long ones
    rows = [(k, u) for k, u in enumerate(urls)] + [(1, ""), (None, "x://com/"), (9, urls[9])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' host", "0 slice")
    found = judged_urls(df, spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((k, *brute(u, rules))) for k, u in rows)
    none = judged_urls(df, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(rows)
    assert judged_urls(df.limit(0), df.selectExpr("'com' host", "'/' path", "'block' verdict")).count() == 0
