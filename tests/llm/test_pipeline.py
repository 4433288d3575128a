"""The corpus pipeline: each stage against a brute-force version, and odd rows."""

import random
import re

import pytest

import corpus_pipeline
from pacewright.llm.quality_model import difference, quality_model
from pacewright.llm.tokens import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for k in range(700):
        bad = k % 6 == 5
        text = " ".join(rng.choice(words) + (rng.choice(["##", "$%", "&&"]) if bad else "") for _ in range(rng.randint(40, 160)))
        if k % 6 in (2, 3) and rows:
            text = rng.choice(rows[::6])[1] + ("" if k % 6 == 2 else " " + rng.choice(words))
        if k % 6 == 1:
            text += "\nAll rights reserved by the site\nSee our other pages too"
        rows.append((k, text, "en", "host" if k % 3 else None, len(text)))
        labels.append((k, 0 if bad else 1))
    rows += [(9001, None, None, None, None), (9002, "", "en", "host", 0), (None, rows[0][1], "en", "host", 1), (9003, " ".join(f"long{j % 5000}" for j in range(120_000)), "en", "host", 1), rows[10]]
    return rows, labels


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 id", "'x' body", "2 gone")
    df.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def kept_after(spark, folder):
    """What each stage makes of all that the one before it kept: [(name, input, output)]."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder).persist()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, given):
    steps = kept_after(spark, given)
    assert [n for n, *_ in steps] == ["quality_classifier", "quality_rules", "near_duplicates", "packing"]
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for _, before, after in steps[:3]:
        assert after.columns == before.columns

    # classifier: the score of every text by hand
    _, before, after = steps[0]
    model = quality_model(before, spark.read.parquet(f"{given}/labels.parquet"))
    packers = model.compressors()
    good = lambda t: model.base + model.slope * difference(memoryview((t or "").encode()), packers) >= 0
    assert pairs(after) == [x for x in pairs(before) if good(x[1])]

    # rules: base measures and frequent lines by hand
    _, before, after = steps[1]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    normal = lambda line: " ".join(WORD.findall(line)).lower()
    held, first = {}, {}
    for k, t, h in rows:
        for n in {normal(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((h, n), set()).add(t)
            if k is not None:
                first[h, n] = min(k, first.get((h, n), k))
    want = []
    for k, t, h in rows:
        words = WORD.findall(t or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        covered = len({j for i, w in enumerate(windows) if count[w] > 1 for j in (i, i + 1, i + 2)})
        gone = {n for n in map(normal, (t or "").split("\n")) if n and len(held[h, n]) > 100 and (k is None or first[h, n] != k)}
        lost = sum(len(normal(x).split()) for x in (t or "").split("\n") if normal(x) in gone)
        if len(words) >= 50 and 2 * covered <= len(words) and 2 * lost <= len(words):
            want.append((k, "\n".join(x for x in t.split("\n") if normal(x) not in gone)))
    assert pairs(after) == sorted(want, key=str)

    # near duplicates: components by hand
    _, before, after = steps[2]
    rows = sorted({(k, t) for k, t in pairs(before) if k is not None})
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [WORD.findall(t.lower())]]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 4 * min(len(a), len(sets[j])) >= 3 * max(len(a), len(sets[j])) and 7 * len(a & sets[j]) >= 3 * (len(a) + len(sets[j])):
                x, y = label[i], label[j]
                label = [min(x, y) if c in (x, y) else c for c in label]
    ids = {k for k, (c, _) in enumerate(zip(label, rows, strict=True)) if c == k}
    assert pairs(after) == sorted([rows[k] for k in ids] + [(None, t) for k, t in pairs(before) if k is None], key=str)

    # packing: every id once, in windows without holes
    _, before, after = steps[3]
    pieces = after.collect()
    library = tokenizer("byte_bpe_50k.json")
    for k, t in pairs(before):
        if k is not None:
            own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == k)
            assert [s for s, *_ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))]
            assert {n for *_, n in own} == {len(library.encode(t, add_special_tokens=False).ids) + 1} == {sum(n for _, n, _ in own)}


def test_run(spark, given, tmp_path):
    found = corpus_pipeline.run(spark, given)
    assert found.count() > 0 and set(found.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    docs = spark.read.parquet(f"{given}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{given}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
