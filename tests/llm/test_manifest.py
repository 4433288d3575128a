"""The Merkle manifest against a plain version."""

import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from pacewright.llm.manifest import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(row, more=0):
    k, text, lang, source, n = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (k, source, lang, None if n is None else n + more, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        yield ("L" if i % 2 else "R", level[i ^ 1]) if i ^ 1 < len(level) else ("N", "")
        i //= 2


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:  # null ids first, rows of one id by leaf
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in groups[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    found = Counter()
    for j, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[j], i), *path(top, j)]
            folded = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for side, s in steps:
                folded = h(s, folded) if side == "L" else h(folded, s)
            root = top[-1][0]
            found[r[0], leaf(r), trees[j][-1][0], root, h(*[s for _, s in steps]), folded, folded == root] += 1
    return found


def manifest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 slot", "'x' g", "2 path", "3 hash", "4 nodes")
    return merkle_manifest(df, tampered=F.crc32(F.col("id").cast("string")) % 7 == 0)


def check(spark, rows):
    assert Counter(tuple(r) for r in manifest(spark, rows).collect()) == brute(rows)


def row(rng, k, lang):
    return (k, rng.choice([None, "", "é\n日本", "w" * rng.randint(1, 40)]), lang, rng.choice([None, "", "s1"]), rng.choice([None, 0, 7]))


def test_groups_over_several_ranges(spark):
    rng = random.Random(8)
    ids = [*range(-50, 700), *rng.sample(range(-(10**12), 10**12), 600), *range(8185, 8200)]
    rng.shuffle(ids)
    check(spark, [row(rng, k, rng.choices([None, "", "en", "de", "日"], [1, 1, 20, 3, 2])[0]) for k in ids])


def test_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    rows = [row(rng, rng.choice([None, *range(40)]), rng.choice([None, "en", "de"])) for _ in range(300)]
    rows += [(5, "hot", "en", "s", 3)] * 300 + [(None, "hot", "en", "s", 3)] * 300  # one id, and no id, of a third of the rows each
    rng.shuffle(rows)
    check(spark, rows)


def test_few_rows(spark):
    check(spark, [(3, "a", "en", "s", 1)])
    check(spark, [(None, None, None, None, None)])
    check(spark, [(k, "long " * 200_000, lang, "s", 1) for k, lang in ((1, "b"), (2, "a"), (-3, None))])
    assert manifest(spark, []).count() == 0


def test_a_root_tells_tables_apart(spark):
    rows = [(k, "t", "en", "s", 1) for k in range(20)]
    roots = {manifest(spark, r).first()["root"] for r in (rows, rows[::-1], [*rows[1:], (0, "u", "en", "s", 1)], rows[1:], [*rows, rows[0]])}
    assert len(roots) == 4
