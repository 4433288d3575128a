"""The compression classifier on held-out rows."""

import math
import random
import zlib

import pytest

from pacewright.llm.quality_model import good_documents, quality_model, quality_scores


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = k % 3 == 0
        rows.append((k, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text) if bad else " ".join(text) + "."))
        labels.append((k, 0 if bad else 1))
    df = spark.createDataFrame([*rows, (None, None), (7000, "")], "doc_id long, text string").selectExpr("*", "1 score")
    marks = spark.createDataFrame([*labels, (None, 1), (1, 0), (3, None)], "doc_id long, quality int")
    model = quality_model(df, marks)
    found = quality_scores(df, model).collect()
    assert len(found) == 602 and all(0 <= r["score"] <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in [*range(600), 7000] if zlib.crc32(str(k).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] < 600) >= 0.97 * (len(held) - 1)
    # by hand: blocks of 512 bytes under either dictionary, one difference per byte, one curve
    packers = model.compressors()
    texts = {k: (t or "").encode() for k, t in [*rows, (None, None), (7000, "")]}
    for r in found:
        raw = texts[r["doc_id"]]
        good, bad = (sum(len(c.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) for c in packers)
        d = (bad - good) / len(raw) if raw else 0.0
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, model.base + model.slope * d)))), abs=1e-9)
    long = spark.createDataFrame([(1, rows[1][1] * 3000), (2, rows[3][1] * 3000)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in quality_scores(long, model).collect()} == {1: 1, 2: 0}
    kept = good_documents(df, model)
    assert kept.columns == df.columns and 150 < kept.count() < 450
    none = quality_model(df, marks.limit(0))
    assert {r["score"] for r in quality_scores(df, none).collect()} == {0.5}
    assert quality_scores(df.limit(0), model).count() == 0
