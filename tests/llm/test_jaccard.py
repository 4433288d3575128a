"""The Jaccard join against a brute-force version."""

import random
import re
import string

import pytest

from pacewright.llm import jaccard
from pacewright.llm.components import components
from pacewright.llm.jaccard import jaccard_components, one_of_each_group


def shingles(text):
    if text is None:
        return frozenset()
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """{id: (size, component)} of rows (id, text)."""
    sets = {k: shingles(t) for k, t in rows}
    ids = sorted(sets)
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), root(k)) for k in ids}


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 6))) for _ in range(400)]
    passage = rng.choices(words, k=50)
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.6:  # a copy with some edits of any earlier document: long chains and fans
            text = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if text:
                    at = rng.randrange(len(text))
                    text[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
        else:
            text = rng.choices(words, k=rng.choice([0, 1, 3, 4, 5, 6, 7, 8, 12, 30, 60, 200]))
            if kind > 0.8:
                text += passage
        rows.append((k * 7 % 1009, " ".join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, component_id int").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert found == brute(rows)


def test_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(120)]
    rows = [(k, " ".join(base)) for k in range(40)]
    for k in range(40, 240):
        text = list(base)
        for _ in range(rng.randint(1, 7)):
            text[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(text)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute(rows)


def test_edges(spark):
    rows = [(None, "a b c d e f"), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A\tB"), (3, "a b"), (4, "b a"), (4, "b a"), (10, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r[0], r[1], r[2]) for r in jaccard_components(df).collect()), key=str)
    assert found == sorted([(None, 2, None), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 3), (9, 1, 3), (3, 1, 3), (4, 1, 4), (4, 1, 4), (10, 2, 10)], key=str)
    assert jaccard_components(df.limit(0)).count() == 0
    kept = sorted((r[0] for r in one_of_each_group(df).collect()), key=str)
    assert kept == sorted([None, 5, 6, 7, 3, 4, 10], key=str)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)] + [(7, 7), (200, 199)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 50)}, 199: 199, 200: 199}


def test_copies_without_id_come_first(spark):
    text = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(text)), (None, " ".join(text)), (1, " ".join(text)), (2, " ".join([*text[:-1], "other"])), (3, " ".join(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted(((r[0], r[1], r[2]) for r in jaccard_components(df).collect()), key=str)
    assert found == sorted([(None, 56, None), (None, 56, None), (1, 56, 1), (2, 56, 1), (3, 56, 1)], key=str)
    assert sorted((r[0] for r in one_of_each_group(df).collect()), key=str) == [1, None, None]


def test_one_id_of_different_texts(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    a, b, c = text(1), text(2), text(2) + " more"
    long = text(9, 150_000)
    rows = [(5, a), (5, b), (5, b), (3, c), (8, long), (9, long + " end"), (10, ""), (10, ""), (11, None), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "2 body", "3 root", "4 `class`", "5 n").repartition(3)
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(5, a), (3, c), (8, long), (10, ""), (11, None), (None, a), (None, a)], key=str)
    assert one_of_each_group(df.limit(0)).count() == 0


def template_texts(n, rng, words=400, changed=11):
    template = [f"t{j}" for j in range(words)]
    out = []
    for k in range(n):
        text = list(template)
        for j, at in enumerate(rng.sample(range(words), changed)):
            text[at] = f"own{k}x{j}"
        out.append((k, " ".join(text)))
    return out


def test_texts_of_one_template_give_few_pairs(spark, monkeypatch):
    rows = template_texts(1000, random.Random(21))
    rows += [(2000 + k, rows[k][1].replace("t7 ", "other7 ")) for k in range(0, 1000, 100)]  # near copies among them
    counted = []
    compared = jaccard._compared

    def counting(pairs, sets):
        pairs = pairs.checkpoint()
        counted.append(pairs.count())
        return compared(pairs, sets)

    monkeypatch.setattr(jaccard, "_compared", counting)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()}
    assert found == {k: k - 2000 if k >= 2000 else k for k, _ in rows}
    assert sum(counted) < 10 * len(rows), counted


@pytest.mark.parametrize("overlap", [0.70, 0.76, 0.9])
def test_open_pairs_keep_every_link(spark, overlap):
    """Sketches bound what two sets share: no pair that links is left out."""
    import numpy as np

    rng = np.random.default_rng(17)
    core = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = {k: np.unique(np.concatenate([core[rng.random(300) < (2 * overlap / (1 + overlap)) ** 0.5], rng.integers(0, 1 << 64, rng.integers(0, 60), dtype=np.uint64)])) for k in range(700)}
    rest = spark.createDataFrame([(key, k, len(s), 0, k) for k, s in sets.items() for key in ((1, 2) if k % 2 else (1,))], "key long, id long, n long, p int, root long")
    sketches = spark.createDataFrame([(k, jaccard.sketch(s)) for k, s in sets.items()], "id long, sketch binary")
    leaders = spark.createDataFrame([(1, 900), (2, 900)], "key long, other long")
    found = {(r["a"], r["b"]) for r in jaccard.open_pairs(rest, leaders, sketches).collect()}
    held = {k: set(s.tolist()) for k, s in sets.items()}
    links = {(a, b) for a in range(700) for b in range(a + 1, 700) if 7 * len(held[a] & held[b]) >= 3 * (len(held[a]) + len(held[b]))}
    assert links <= found and len(found) < 700 * 699 / 2


def test_elements_stay_where_they_lie(spark, monkeypatch):
    """A comparison moves pairs, and one side's elements with them, but neither table of elements."""
    plans, compared = [], jaccard._compared
    has = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def seen(pairs, sets):
        found = compared(pairs, sets)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(jaccard, "_compared", seen)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(6)] + [(9, "nothing like the others at all")]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", has)
    assert found == {**dict.fromkeys(range(6), 0), 9: 9}
    assert plans[0].count("Exchange hashpartitioning") == 2


def test_jobs_do_not_grow_with_partitions(spark):
    """Counts and wanted rows come in one job each, not in one for each partition."""
    df = spark.createDataFrame([(k, f"text {k} of its own words x{k} y{k} z{k}") for k in range(20)], "doc_id long, text string")
    has = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.sparkContext.setJobGroup("jaccard_jobs", "")
        assert jaccard.jaccard_components(df).count() == 20
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("jaccard_jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in has.items():
            spark.conf.set(k, v)
    assert jobs < 60, jobs


def test_hashes_are_packed_to_three_bytes():
    import zlib

    import numpy as np

    numbers = np.sort(np.random.default_rng(5).integers(0, 1 << 40, 1 << 20, dtype=np.uint64))
    for some in (numbers, numbers[:1], numbers[:0], np.array([0, 0, 7, (1 << 40) - 1], dtype=np.uint64)):
        assert (jaccard._unpacked(jaccard._packed(some)) == some).all()
    assert len(zlib.compress(jaccard._packed(numbers), 1)) < 3.1 * len(numbers)
