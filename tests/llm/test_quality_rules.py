"""Quality rules against a brute-force version."""

import random
import re

from pacewright.llm.quality_rules import quality_filtered, quality_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_base_measures(spark):
    rng = random.Random(4)
    parts = ["a", "b", "é", "日本", "#x", "<|", "\n", "\n", " \n", "\t", "\r\n", "\u00a0", "word", "a b c", "a b c d", "same line\n", "", "  "]
    texts = [None, "", " ", "\n", "a", "a b c", "a b c a b c", "x " * 60] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'h' source", "1 host", "2 body")
    found = {r[0]: tuple(r)[1:7] for r in quality_report(df).collect()}
    assert found == {k: base(t) for k, t in enumerate(texts)}


def test_frequent_lines(spark):
    def own(k):
        return " ".join(f"w{k}x{j}" for j in range(60))

    rows = [(k, f"{own(k)}\nShared  LINE here\n", "a") for k in range(30)]
    rows += [(100 + k, "\n".join(["shared line here"] * 40) + "\n" + " ".join(f"v{k}x{j}" for j in range(60)), "a") for k in range(3)]
    rows += [(200 + k, f"{own(999)}\nonly copies have this line\n", "b") for k in range(50)]  # exact copies count once
    rows += [(300, None, "a"), (None, own(5000) + "\nshared line here", None), (1, f"{own(1)}\nShared  LINE here\n", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {(r["doc_id"], r["n_removed_words"], r["kept"]) for r in quality_report(df, line_documents=20).collect()}
    assert (0, 0, True) in report and (1, 3, True) in report and (29, 3, True) in report
    assert {(100 + k, 120, False) for k in range(3)} <= report
    assert {(200 + k, 0, True) for k in range(50)} <= report
    assert (300, 0, False) in report and (None, 0, True) in report
    assert quality_report(df, line_documents=20).count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in quality_filtered(df, line_documents=20).collect()}
    assert kept[0] == rows[0][1] and kept[5] == own(5) + "\n" and 100 not in kept
    assert quality_filtered(df, line_documents=20).columns == df.columns
    assert quality_report(df.limit(0)).count() == 0


def brute_removed(rows, limit):
    """{(id, text): words of frequent lines} of rows (id, text, host) with ids and hosts."""
    normal = {t: [n for n in (" ".join(WORD.findall(x)).lower() for x in (t or "").split("\n")) if n] for _, t, _ in rows}
    held, first = {}, {}
    for k, t, h in rows:
        for n in normal[t]:
            held.setdefault((h, n), set()).add(t)
            first[h, n] = min(k, first.get((h, n), k))
    return {(k, h): sum(len(n.split()) for n in normal[t] if len(held[h, n]) > limit and first[h, n] != k) for k, t, h in rows}


def test_documents_that_share_several_lines(spark):
    rng = random.Random(6)
    shared = {h: [" ".join(f"{h}{j}s{i}" for i in range(rng.randint(1, 9))) for j in range(12)] for h in "ab"}
    rows = []
    for k in range(160):
        h = rng.choice("aab")
        lines = [x.upper() if rng.random() < 0.3 else x for x in rng.sample(shared[h], rng.choice([3, 8, 12]))]
        rows.append((k, "\n".join([*lines, " ".join(f"w{k}x{j}" for j in range(55))]), h))
    rows += [(200 + j, t, h) for j, (_, t, h) in enumerate(rng.choices(rows, k=60))]  # exact copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (20, 50):
        removed = brute_removed(rows, limit)
        found = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in quality_report(df, line_documents=limit).collect()}
        assert found == {k: (removed[k, h], not base(t)[5] and 2 * removed[k, h] <= base(t)[0]) for k, t, h in rows}
        assert any(removed.values())


def test_limit_is_the_same_on_large_hosts(spark):
    def own(k):
        return " ".join(f"w{k}x{j}" for j in range(50))

    rows = [(k, f"{own(k)}\nshared line here" if k < 25 else own(k), h) for h, n in (("small", 100), ("large", 3000)) for k in range(n)]
    rows += [(5000 + k, own(9), "small") for k in range(3000)]  # exact copies do not raise the limit
    df = spark.createDataFrame([(k + 10000 * (h == "large"), t, h) for k, t, h in rows], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["n_removed_words"] for r in quality_report(df, line_documents=20).filter("n_removed_words > 0").collect()}
    assert found == {k + at: 3 for at in (0, 10000) for k in range(1, 25)}


def test_edges(spark):
    own = " ".join(f"w{j}" for j in range(60))
    rows = [(1, own, None, "a", 1), (2, own + " x", "", "b", 2), (3, None, "h", None, 3), (4, "", "h", None, 4), (5, " ".join(f"v{j}" for j in range(200_000)), "h", "c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _gone string, _id int").selectExpr("*", "1 body", "2 lines", "3 kept", "4 each", "5 host")
    found = quality_filtered(df)
    assert found.columns == df.columns and {(r["doc_id"], r["_gone"], r["_id"]) for r in found.collect()} == {(1, "a", 1), (2, "b", 2), (5, "c", 5)}
    assert quality_filtered(df.limit(0)).count() == 0
    # a null host is not the empty one: two halves of a frequent line stay under the limit
    lines = [(k, " ".join(f"u{k}x{j}" for j in range(60)) + "\nshared line", None if k % 2 else "") for k in range(30)]
    df = spark.createDataFrame(lines, "doc_id long, text string, source string")
    assert quality_report(df, line_documents=20).filter("n_removed_words > 0").count() == 0
    assert quality_report(df, line_documents=14).filter("n_removed_words > 0").count() == 28
