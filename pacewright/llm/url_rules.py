"""URL rules as a sort-merge range join, in DataFrame operations only.

A rule is (host, path, verdict); it fits its host and all subdomains where the URL's path starts with the
rule's. Under reversed host labels and path as the sort key, a rule of a host is the interval of keys that
begin with its own, and rules of one host nest. URLs and rules are sorted together and swept once: at each
URL the last rule passed carries its stack (itself and the rules it lies in), and the topmost entry whose
interval still holds the URL is the active rule. A URL enters once for each suffix of its host that is no
longer than the longest rule host; the longest rule found wins.

Sweeps run over slices of the URLs (a hash of id and URL, several per shuffle partition), each with all
rules, so no host, however common, gathers in one task.

A null URL or one without ``://`` has an empty host and path. A URL without a rule, or with a null one
(rules with a null host, path or verdict are ignored), gets ``default``. Of rules with the same host and
path the verdict that sorts last holds. Repeated rows are kept; an empty table of pages or rules is fine. URLs of any
length are judged whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewright.llm.shared import only

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path`` of the column ``url``."""
    after = F.expr(f"if({url} is null or instr({url}, '://') = 0, '', substring({url}, instr({url}, '://') + 3))")
    df = df.withColumn("after", after).withColumn("raw_host", F.regexp_extract("after", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(after, length(raw_host) + 1)"), "^[^?#]*", 0)
    return df.withColumn("host", F.translate("raw_host", UPPER, LOWER)).withColumn("path", path).drop("after", "raw_host")


def _nested(rules: DataFrame) -> DataFrame:
    """(key, path, stack): of each rule the rules it lies in and itself, outermost first."""
    given = only(rules, host="host", path="path", verdict="verdict").filter("host is not null and path is not null and verdict is not null")
    given = given.withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    given = given.withColumn("key", F.expr("concat(array_join(reverse(split(host, '[.]', -1)), '.'), '.')"))
    given = given.withColumn("entry", F.expr("named_struct('chars', length(path), 'path', path, 'rule', concat(host, path), 'host_chars', length(host), 'verdict', verdict)"))
    prefixes = given.select("key", "path", F.explode(F.expr("sequence(0, length(path))")).alias("n")).selectExpr("key", "path", "substring(path, 1, n) part")
    outer = given.select("key", F.col("path").alias("part"), "entry")
    return prefixes.join(outer, ["key", "part"]).groupBy("key", "path").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def judged_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: its id, host, path, rule (host and path of the rule that holds, or null) and verdict."""
    spark = pages.sparkSession
    stacks = _nested(rules)
    depth = stacks.agg(F.max(F.size(F.split("key", "[.]", -1))).alias("d")).first()["d"] or 0
    slices = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    urls = with_host_and_path(only(pages, id=id_column, url=url_column), "url")
    urls = urls.withColumn("slice", F.pmod(F.xxhash64("id", "url"), F.lit(slices)).cast("int")).drop("url")
    labels = F.expr(f"slice(reverse(split(host, '[.]', -1)), 1, {max(1, depth)})")
    levels = F.expr("transform(sequence(1, size(labels)), j -> named_struct('level', j, 'key', concat(array_join(slice(labels, 1, j), '.'), '.')))")
    points = urls.withColumn("labels", labels).select("slice", "id", "host", "path", F.inline(levels))
    starts = stacks.select(F.explode(F.expr(f"sequence(0, {slices - 1})")).alias("slice"), "key", "path", "stack")

    points = points.select("slice", "key", "path", F.lit(1).alias("kind"), "id", "host", "level")
    swept = points.unionByName(starts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("slice").orderBy("key", "path", "kind")
    last = F.last(F.when(F.col("kind") == 0, F.struct("key", "stack")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    active = F.expr("if(passed.key = key, try_element_at(filter(passed.stack, r -> startswith(path, r.path)), -1), null)")
    found = swept.withColumn("passed", last).filter("kind = 1").withColumn("active", active)
    best = F.max(F.expr("if(active is null, null, named_struct('chars', length(active.rule), 'host_chars', active.host_chars, 'rule', active.rule, 'verdict', active.verdict))"))
    each = found.groupBy("slice", "id", "host", "path").agg(best.alias("best"), F.sum(F.expr("if(level = 1, 1, 0)")).alias("times"))
    rows = each.select("id", "host", "path", "best", F.explode(F.expr("sequence(1, cast(times as int))")))
    return rows.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
