"""A compression classifier of text quality.

Two zstandard dictionaries are built, from well and badly labelled texts. A text is cut into blocks of
fixed size and every block compressed with either dictionary; with the total sizes g (good) and b (bad) of a
text of n bytes, the normalised difference is (b - g) / n. A logistic curve over this one number makes it a
calibrated score: the chance that the text's label is 1. Nothing else of a text enters its score.

Only a bounded sample of labelled texts is used to fit: ``SAMPLE`` ids of each label, chosen by hash, one text
each, of it the first ``TEXT_CHARS`` characters, and at most ``TEXT_BYTES`` bytes of all texts of a label. Half
of them build the dictionaries, the other half fit the curve. Every text is scored whole.

Null and empty texts score as the curve has it for no difference; rows are scored one by one, so
repeated rows, null ids and further columns change nothing. Ids with contradicting labels, and ids
without text, are not used to fit; of an id with several texts the least one is. Where one of the labels is
missing altogether every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewright.llm.shared import bounded_batches, hand_back, in_python, lean, only
from pacewright.llm.textgrid import text_slices

SAMPLE, TEXT_CHARS, TEXT_BYTES = 2000, 1 << 16, 8 << 20
BLOCK, DICTIONARY, LEVEL = 512, 110_000, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    base: float
    slope: float = 0.0

    def compressors(self) -> list:
        out = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * differences, -30, 30)))

    def scores_of(self, column: pa.Array, compressors: list) -> np.ndarray:
        """The scores of a column of texts."""
        found: list[float] = []
        for _, data, bounds in text_slices(column):
            raw, at = memoryview(np.ascontiguousarray(data)), bounds.tolist()
            found += [difference(raw[a:b], compressors) for a, b in zip(at[:-1], at[1:], strict=True)]
        return self.scores(np.array(found, dtype=float))


def difference(raw: memoryview, compressors: list) -> float:
    """By how much less the dictionary of good texts leaves of a text than that of bad ones, per byte."""
    n = len(raw)
    if not n:
        return 0.0
    good, bad = (sum(len(c.compress(raw[k : k + BLOCK])) for k in range(0, n, BLOCK)) for c in compressors)
    return (bad - good) / n


def fitted(rows: list[tuple[str, int, int]]) -> QualityModel:
    """A model of (text, label, half): rows of half 0 build the dictionaries, rows of half 1 fit the curve."""
    trained = []
    for label in (1, 0):
        blocks = [raw[k : k + 4 * BLOCK] for t, q, half in rows if q == label and not half for raw in [t.encode()] for k in range(0, len(raw), 4 * BLOCK)]
        try:
            trained.append(zstandard.train_dictionary(DICTIONARY, blocks).as_bytes())
        except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself serves
            trained.append(b"".join(blocks)[:DICTIONARY] or b"-" * 16)
    share = float(np.mean([q for _, q, _ in rows])) if rows else 0.5
    model = QualityModel(*trained, base=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    held = [(t, q) for t, q, half in rows if half]
    if len({q for _, q in held}) < 2:
        return model
    compressors = model.compressors()
    d, y = np.array([difference(memoryview(t.encode()), compressors) for t, _ in held]), np.array([q for _, q in held], dtype=float)
    centre, spread = d.mean(), d.std() + 1e-9
    x = np.column_stack([np.ones(len(d)), (d - centre) / spread])
    w, ridge = np.zeros(2), np.diag([0, 1e-2])
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(2), x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.base, model.slope = float(w[0] - w[1] * centre / spread), float(w[1] / spread)
    return model


def in_fold(id_column: str) -> F.Column:
    """Whether a row is held out: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE, text_chars: int = TEXT_CHARS, text_bytes: int = TEXT_BYTES) -> QualityModel:
    """A model fitted on labelled rows that are not held out."""
    marked = only(labels, id=id_column, label=label_column).filter("id is not null and label in (0, 1)")
    marked = marked.filter(~in_fold("id")).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    order = F.xxhash64("id")
    chosen = [marked.filter(F.col("label") == q).orderBy(order, "id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).select("id", "label"))  # at most 2 * sample rows
    texts = only(df, id=id_column, text=text_column).filter("text is not null and text <> ''").withColumn("text", F.substring("text", 1, text_chars))
    texts = texts.join(chosen, "id").groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("o", order)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("o", "id"))
    texts = texts.withColumn("bytes", so_far).filter(F.col("bytes") <= text_bytes)
    rows = texts.select("text", "label", F.pmod("o", F.lit(2)).alias("half"), "o", "id").orderBy("o", "id").collect()  # bounded by the sample
    model = fitted([(r["text"], r["label"], r["half"]) for r in rows])
    del rows
    hand_back()
    return model


def quality_scores(df: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, held_out, score and predicted."""
    given = only(df, id=id_column, text=text_column).select("id", "text", in_fold("id").alias("held_out"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            score = model.scores_of(batch.column(1), compressors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    out = in_python(given, scored, f"id {given.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("id", id_column)


def good_documents(df: DataFrame, model: QualityModel, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` without the rows whose text scores under ``least``; columns as they were.

    Only the text goes to Python, and only its score comes back.
    """
    bounded_batches(df)

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = model.compressors()
        for column in columns:
            yield pa.array(model.scores_of(column, compressors))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scored)(columns)

    return df.filter(score(F.col(f"`{text_column}`")) >= least)
