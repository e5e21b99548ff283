"""URL filters by a path-template tree.

Paths of one host are cut into segments. A segment that is a number, a hash or a date, alone or with an ending, is
variable from the start; where a place in the tree has many different segments for its rows, all of them are. Rows then
share templates such as /en/*. Sibling branches, templates that differ in one segment only, are merged where the
labelled share of bad rows of a branch does not differ from that of its siblings by more than Z standard errors. A
template is rejected when its labelled badness, smoothed towards the overall share with STRENGTH pseudo-labels, reaches
LIMIT. Explicit rules come before the method: the longest fitting one decides.

The tree is worked on level by level, however deep it is; a path leaves when it is alone in its place, so that a few
very long paths cost little. All steps are DataFrame aggregations over distinct (host, shape) rows; a host or template with a large share of all
rows is aggregated before every shuffle and joined back by a broadcast of a bounded list of hot shapes.

Edge cases: a null url, or one without ://, has empty host and path and is judged like any other row of that (host, path); without
labels the overall share is taken as STRENGTH pseudo-labels at PRIOR. Repeated rows and ids are judged one by one.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, bounded_map, materialize

MANY, ROWS_EACH, Z, STRENGTH, LIMIT, PRIOR, STEP = 16, 4.0, 1.96, 8.0, 0.5, 0.1, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query: (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    has = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.when(has, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def by_rules(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """rule and verdict columns over `host` and `path`; rules is a short list given by the caller."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest comes last and so stands outermost
        h, slash, p = r.partition("/")
        h = h.translate(str.maketrans(UPPER, LOWER))
        fits = (F.col("host") == h) | F.col("host").endswith("." + h)
        fits = fits & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments with variable ones made *."""
    x = lambda s: F.regexp_replace(s, r"^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?=$|\.[A-Za-z]{1,5}$)", "*")
    return F.transform(F.split(path, "/"), x)


def _by_level(rows: DataFrame, column: str, level: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """level(rows, d) for d = 1, 2, ... up to the longest path; after every STEP levels the rows leave whose first d segments no
    other template of the host shares."""
    deepest, done, d = rows.agg(F.max(F.size(column))).first()[0] or 0, [], 0
    while d < deepest:
        d += 1
        rows = materialize(level(rows, d), "tree")
        if d % STEP == 0 and d < deepest:
            whole = F.concat_ws("/", column)
            rows = rows.withColumn("place", F.xxhash64(F.slice(column, 1, d)))
            shared = rows.groupBy("host", "place").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi")).where("lo <> hi").select("host", "place", F.lit(True).alias("__on"))
            rows = materialize(rows.join(shared, ["host", "place"], "left").drop("place"), "tree")
            done.append(rows.where("__on IS NULL").drop("__on"))
            rows = rows.where("__on").drop("__on")
            deepest = rows.agg(F.max(F.size(column))).first()[0] or 0
    return reduce(DataFrame.unionByName, [*done, rows])


def generalised(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) with template: segments of places with many different ones made *."""

    def level(tree: DataFrame, d: int) -> DataFrame:
        at = F.get("template", F.lit(d - 1))
        tree = tree.withColumn("place", F.concat_ws("/", F.slice("template", 1, d - 1)) if d > 1 else F.lit(""))
        here = tree.where(at.isNotNull()).groupBy("host", "place", at.alias("seg")).agg(F.sum("n").alias("n"))
        wide = here.groupBy("host", "place").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        wide = wide.where((F.col("k") >= MANY) & (F.col("n") < ROWS_EACH * F.col("k"))).select("host", "place", F.lit(True).alias("wide"))
        new = F.transform("template", lambda s, i: F.when(F.col("wide") & (i == d - 1), F.lit("*")).otherwise(s))
        return tree.join(wide, ["host", "place"], "left").withColumn("template", F.when(F.col("wide"), new).otherwise(F.col("template"))).drop("place", "wide")

    return _by_level(shapes.withColumn("template", F.col("shape")), "template", level)


def judged(tree: DataFrame) -> DataFrame:
    """tree with merged template, its purity and the method's verdict."""
    leaf = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    total = leaf.agg(F.coalesce((F.sum("bad") + F.lit(STRENGTH * PRIOR)) / (F.sum("labelled") + F.lit(STRENGTH)), F.lit(PRIOR)).alias("base")).first()[0]
    total = PRIOR if total is None else float(total)

    def level(leaf: DataFrame, d: int) -> DataFrame:  # siblings that differ in segment d only
        leaf = leaf.withColumn("group", F.transform("final", lambda s, i: F.when(i == d - 1, F.lit("*")).otherwise(s)))
        node = leaf.groupBy("host", "group", "final").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        pool = node.groupBy("host", "group").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"), F.count(F.lit(1)).alias("k"))
        node = node.join(pool.where("k > 1"), ["host", "group"])
        # a branch against its siblings together; branches without labels follow their siblings
        rest, rest_bad = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        rate = (F.col("pb") + STRENGTH * total) / (F.col("pl") + STRENGTH)
        gap = F.abs((F.col("b") + STRENGTH * total) / (F.col("l") + STRENGTH) - (rest_bad + STRENGTH * total) / (rest + STRENGTH))
        alike = gap <= Z * F.sqrt(rate * (1 - rate) * (1 / (F.col("l") + STRENGTH) + 1 / (rest + STRENGTH)))
        node = node.where(alike).select("host", "final", F.col("group").alias("to"))
        return leaf.drop("group").join(node, ["host", "final"], "left").withColumn("final", F.coalesce("to", "final")).drop("to")

    leaf = _by_level(leaf.withColumn("final", F.col("template")), "final", level)
    final = leaf.groupBy("host", "final").agg(F.sum("labelled").alias("fl"), F.sum("bad").alias("fb"))
    purity = (F.col("fb") + STRENGTH * total) / (F.col("fl") + STRENGTH)
    final = final.select("host", "final", F.round(purity, 6).alias("badness"), F.when(purity >= LIMIT, "block").otherwise("allow").alias("method"))
    leaf = leaf.select("host", "template", "final").join(final, ["host", "final"])
    return tree.select("host", "shape", "template", "n").join(leaf, ["host", "template"])


def url_filter(pages: DataFrame, bad_labels: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, badness. bad_labels: (url_number, bad 0/1), one row for each number;
    it labels the pages whose last whole number in the path it is."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)")
    rows = materialize(rows.withColumn("shape", shape(F.col("path"))).withColumn("number", number), "urls")
    seen = rows.groupBy("host", "shape", "number").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.join(bad_labels.select(F.col("url_number").alias("number"), "bad"), "number", "left")
    shapes = seen.groupBy("host", "shape").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad").isNotNull(), F.col("n")).otherwise(0)).alias("labelled"), F.sum(F.coalesce(F.col("bad") * F.col("n"), F.lit(0))).alias("bad"))
    tree = materialize(judged(generalised(materialize(shapes, "shapes"))), "templates")
    hot = tree.where(F.col("n") > max(1, rows.count() // HOT_SHARE)).drop("n")
    out = bounded_map(pages.sparkSession, tree.drop("n"), hot, rows.drop("number"), ["host", "shape"], "inner")
    rule, verdict = by_rules(rules)
    return out.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("method")).alias("verdict"), F.concat_ws("/", "final").alias("template"), "badness"
    )


def bad_labels(labels: DataFrame) -> DataFrame:
    """(url_number, bad) from a table of doc_id, quality, toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("url_number")).agg(F.max(bad.cast("long")).alias("bad"))
