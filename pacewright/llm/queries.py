"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewright.llm.chat import formatted_digests
from pacewright.llm.jaccard import jaccard_components
from pacewright.llm.manifest import merkle_manifest
from pacewright.llm.ordering import training_order
from pacewright.llm.packing import packed
from pacewright.llm.pieces import piece_round_trip
from pacewright.llm.quality_model import quality_model, quality_scores
from pacewright.llm.quality_rules import quality_report
from pacewright.llm.secrets import BASE_RULES, MORE_RULES, Rule, secret_report
from pacewright.llm.search import ranked_documents
from pacewright.llm.shared import table
from pacewright.llm.token_counts import token_counts
from pacewright.llm.url_rules import judged_urls
from pacewright.llm.vectors import linked_vectors

#: Documents of one host that may hold a line: the whole table of a small corpus has few lines in 100.
LINE_DOCUMENTS = 20
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return formatted_digests(rows)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judged_urls(table(spark, sf_dir, "pages"), rules)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_scores(documents, quality_model(documents, table(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_round_trip(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), line_documents=LINE_DOCUMENTS)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("id").cast("string")) % 7 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_url_filters": op2_url_filters,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality_rules": op5_quality_rules,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_packing": op7_packing,
        "op8_training_order": op8_training_order,
        "op9_token_counts": op9_token_counts,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_secret_scans": op11_secret_scans,
        "op12_ranked_search": op12_ranked_search,
        "op13_merkle_manifest": op13_merkle_manifest,
        "pipeline": pipeline,
    }


OP2_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT any_value(p.page_id) AS page_id, any_value(p.host) AS host, any_value(p.path) AS path,
       arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY k
"""


def _spans_sql(place: int, rule: Rule) -> str:
    """Spans of a rule: its matches are put between two marks, so pieces of the text tell where they are."""
    pattern = "".join(f"[{c.upper()}{c}]" if c.islower() and inside == 0 else c for c, inside in _outside_classes(rule.pattern)) if rule.any_case else rule.pattern
    quoted = pattern.replace("'", "''")
    return f"""
SELECT k, {place} AS place, '{rule.kind}' AS kind, begun AS s, begun + length(hit) AS e FROM (
  SELECT k, i, split_part(piece, chr(2), 1) AS hit, sum(length(piece)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (i - 2) AS begun
  FROM (SELECT k, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT k, string_split(regexp_replace(text, '({quoted})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS pieces FROM d)))
WHERE i > 1 AND length(regexp_extract(hit, '{quoted}', {rule.group})) >= {rule.least}"""


def _outside_classes(pattern: str) -> list[tuple[str, int]]:
    """Each character of a pattern with 1 where it stands in a class or belongs to a hexadecimal escape."""
    found, inside = [], 0
    for i, c in enumerate(pattern):
        inside = 1 if c == "[" else inside
        found.append((c, int(inside or "\\x" in pattern[max(0, i - 3) : i + 1])))
        inside = 0 if c == "]" else inside
    return found


#: The two marks are put out of the texts first, by a character that no rule asks for.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(text, chr(1) || chr(2), chr(9731) || chr(9731)) AS text FROM documents),
spans AS ({" UNION ALL ".join(_spans_sql(k, r) for k, r in enumerate([*BASE_RULES, *MORE_RULES]))}),
joined AS (SELECT k, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < {len(BASE_RULES)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM spans GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (k)
"""

OP12_SQL = r"""
WITH i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
d AS (SELECT row_number() OVER () AS j, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
tf AS (SELECT j, doc_id, n, term, count(*) AS tf FROM (SELECT j, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
share AS (SELECT j, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))) AS s FROM tf JOIN weight USING (term), total),
score AS (SELECT k, item_id, j, doc_id, sum(s)::BIGINT AS score FROM (SELECT k, item_id, unnest(terms) AS term FROM i) JOIN share USING (term) GROUP BY ALL HAVING sum(s) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS r FROM score)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 20
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


#: crc32 goes byte by byte through its table; paths are lists of siblings, each marked with its side.
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT *, row_number() OVER () AS k, n_chars + CASE WHEN xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 7 = 0 THEN 1 ELSE 0 END AS told FROM documents, crc),
leaves AS (
  SELECT k, doc_id, lang, sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} || {_field("text")}) AS leaf,
    sha256({_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("told")} || {_field("text")}) AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM d),
tree AS (
  SELECT 0 AS lvl, lang, slot, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, slot // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY slot)) FROM tree WHERE n > 1 GROUP BY lvl, lang, slot // 2, (n + 1) // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM tree WHERE n = 1),
over AS (
  SELECT 0 AS lvl, slot, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, slot // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY slot)) FROM over WHERE n > 1 GROUP BY lvl, slot // 2, (n + 1) // 2),
steps AS (
  SELECT l.k, t.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.slot < t.slot THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM (SELECT k, lang, unnest(range(0, 63)) AS lvl, slot >> unnest(range(0, 63)) AS at FROM leaves) l
  JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.lvl = l.lvl AND t.slot = l.at AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = l.lvl AND s.slot = xor(l.at, 1)
  UNION ALL
  SELECT l.k, 100 + t.lvl, CASE WHEN s.h IS NULL THEN 'N' WHEN s.slot < t.slot THEN 'L' || s.h ELSE 'R' || s.h END
  FROM (SELECT k, unnest(range(0, 63)) AS lvl, r.slot >> unnest(range(0, 63)) AS at FROM leaves JOIN subroots r ON r.lang IS NOT DISTINCT FROM leaves.lang) l
  JOIN over t ON t.lvl = l.lvl AND t.slot = l.at AND t.n > 1
  LEFT JOIN over s ON s.lvl = l.lvl AND s.slot = xor(l.at, 1)),
paths AS (SELECT k, list(step ORDER BY lvl) AS path FROM steps GROUP BY k),
found AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM over WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_concat([l.changed], coalesce(path, [])), lambda h, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p USING (k))
SELECT *, folded_root = root AS verified FROM found
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": OP2_SQL, "op11_secret_scans": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
