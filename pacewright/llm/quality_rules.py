"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one document: too few words, or too many of them in three-word windows that come
again. Then lines are normalised (lower case, white space squeezed) and hashed, and for each host the
distinct documents that hold a line are counted. A line in more documents than the limit is removed,
except from the document of smallest id that holds it; a document that loses more than half of its words
so is depleted and rejected. The limit is a number of documents, the same on hosts of every size.

Copies must not make each other's lines frequent: documents are told apart by the hash of their whole
text, so exact copies count as one document and different texts never do.

A null text has no words and fails the base rules; a null host is a host of its own. Repeated rows get
the same verdict each. Rows without id keep no line for being first. Texts are measured whole; further columns are
ignored by the report and kept by the filter. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewright.llm.shared import only, released, written

LEAST_WORDS, LINE_DOCUMENTS = 50, 100
_SPACE = r"\\x20\\x09-\\x0D"
_NORMAL = f"lower(trim(regexp_replace(l, '[{_SPACE}]+', ' ')))"


def _measured(given: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and ``each``: of every line with a
    word the hash of its normalised text and the number of its words."""
    d = given.withColumn("words", F.expr(f"array_remove(split(coalesce(text, ''), '[{_SPACE}]+'), '')"))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    d = d.withColumn("n_symbols", F.expr("coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)").cast("long"))
    d = d.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))")).drop("words")
    # three-word windows; of those that come again, how many words they cover
    d = d.withColumn("windows", F.expr("if(n_words < 3, array(), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])))")).drop("hashes")
    d = d.withColumn("placed", F.expr("if(size(array_distinct(windows)) = size(windows), array(), sort_array(transform(windows, (w, i) -> named_struct('w', w, 'i', i))))")).drop("windows")
    d = d.withColumn("m", F.size("placed"))
    again = "transform(filter(placed, (p, k) -> (k > 0 and placed[greatest(k - 1, 0)].w = p.w) or (k < m - 1 and placed[least(k + 1, m - 1)].w = p.w)), p -> p.i)"
    covered = f"aggregate(sort_array({again}), named_struct('n', 0L, 'e', 0), (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.e), 'e', i + 3), a -> a.n)"
    d = d.withColumn("n_repeat_words", F.expr(covered)).drop("placed", "m")
    d = d.withColumn("lines", F.expr(f"filter(split(coalesce(text, ''), '\\n', -1), l -> l rlike '[^{_SPACE}]')"))
    d = d.withColumn("n_dup_lines", F.expr("size(lines) - size(array_distinct(transform(lines, l -> xxhash64(l))))").cast("long"))
    d = d.withColumn("each", F.expr(f"transform(transform(lines, l -> {_NORMAL}), l -> named_struct('line', xxhash64(l), 'n', cast(size(split(l, ' ')) as long)))")).drop("lines")
    return d.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"))


def _gone(told: DataFrame, documents: int) -> DataFrame:
    """(g_host, g_id, g_body, lost, gone): words and lines that each document loses; documents that lose none are left out."""
    lines = told.select("host", "id", "body", F.posexplode("each").alias("pos", "l")).select("host", "id", "body", "pos", "l.line", "l.n")
    different = lines.groupBy("host", "line", "body").agg(F.min("id").alias("first"))
    counted = different.groupBy("host", "line").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    frequent = counted.filter(F.col("documents") > documents).select("host", "line", "first")
    gone = lines.join(frequent, ["host", "line"]).filter("first is null or id is null or id <> first")
    # rows that come twice have each line twice at the same place
    gone = gone.select("host", "id", "body", "pos", "line", "n").distinct().groupBy("host", "id", "body")
    return gone.agg(F.sum("n").alias("lost"), F.collect_set("line").alias("gone")).select(*[F.col(c).alias(f"g_{c}") for c in ("host", "id", "body")], "lost", "gone")


def _host(host: Column) -> Column:
    return F.when(host.isNull(), "").otherwise(F.concat(F.lit("="), host.cast("string")))


def _judged(df: DataFrame, id_column: str, text_column: str, host_column: str, documents: int) -> tuple[DataFrame, DataFrame]:
    """(id, host, body, measures, n_removed_words, kept, gone) of each document, and the table they are read from. Texts are read once: their measures and
    the hashes of their lines are written, and lines are counted from there."""
    given = only(df, id=id_column, text=text_column, host=host_column)
    given = given.withColumn("host", _host(F.col("host"))).withColumn("body", F.xxhash64("text"))
    told = written(_measured(given).drop("text"), "lines")
    found = told.join(_gone(told, documents), F.expr("id <=> g_id and body = g_body and host = g_host"), "left").drop("each")
    found = found.withColumn("n_removed_words", F.coalesce("lost", F.lit(0).cast("long")))
    return found.withColumn("kept", F.expr("not base_failed and 2 * n_removed_words <= n_words")), told


def quality_report(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """One row per row of ``df``: its id, the measures of the base rules, base_failed, n_removed_words and kept."""
    found, _ = _judged(df, id_column, text_column, host_column, line_documents)
    return found.select(F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def quality_filtered(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """The rows of ``df`` that the rules keep, their texts without frequent lines; other columns as they were."""
    judged, told = _judged(df, id_column, text_column, host_column, line_documents)
    verdicts = judged.groupBy("id", "host", "body")
    # written first: a filter on what the rules measure would otherwise be pushed into the measuring and repeat it
    verdicts = written(verdicts.agg(F.first("kept").alias("kept"), F.first("gone").alias("gone")), "verdicts").filter("kept")
    released(told)
    own = f"v{uuid.uuid4().hex}_"  # names that no column of df has
    verdicts = verdicts.select(*[F.col(c).alias(own + c) for c in ("id", "host", "body", "gone")])
    text, gone = F.col(f"`{text_column}`"), F.col(f"{own}gone")
    same = F.col(f"`{id_column}`").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(text) == F.col(f"{own}body")) & (_host(F.col(f"`{host_column}`")) == F.col(f"{own}host"))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda l: ~F.array_contains(gone, F.xxhash64(F.lower(F.trim(F.regexp_replace(l, r"[\x20\x09-\x0D]+", " ")))))), "\n")
    shown = F.when(gone.isNull(), text).otherwise(left).alias(text_column)
    return df.join(verdicts, same).select(*[shown if c == text_column else F.col(f"`{c}`") for c in df.columns])
