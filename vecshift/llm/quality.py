"""Quality rules by weak supervision, in DataFrame and SQL functions only.

Every rule votes good (1), bad (0) or abstains (NULL). The rows are reduced to the vote patterns that occur (at most
3^rules of them, whatever the number of rows), expectation-maximisation over the patterns estimates for each rule how
often it says good of good documents and bad of bad ones, and a document is kept when its posterior probability of
being good reaches a threshold. No rule alone has to pass.

Edge cases: a null text counts as a text without words; it has all-zero counts and base_failed = true. Repeated rows
and ids are judged row by row. An empty table gives an empty result. Extra columns are ignored by `quality_rules`
and kept by `keep_quality`, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WS = r"[ \\t\\n\\x0B\\f\\r]+"
TRIM = r"' \t\n\u000B\f\r'"
#: Frequent function words of the languages served (fixed values, a small closed list each).
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "den", "le", "la", "les", "de", "et", "des", "el", "los", "que", "en", "y"]
#: (name, SQL condition for a bad vote, SQL condition for a good vote); both over the columns of `text_stats`.
RULES = [
    ("length", "n_words < 20", "n_words >= 60"),
    ("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("dup_lines", "10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    ("repeats", "100 * n_repeat_words > 10 * n_words", "n_words >= 20 AND 100 * n_repeat_words <= n_words"),
    ("upper", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    ("stop_words", "n_words >= 30 AND 100 * n_stop < 2 * n_words", "n_words >= 20 AND 100 * n_stop >= 5 * n_words"),
    ("stops", "n_words >= 30 AND n_stops = 0", "n_words >= 20 AND n_stops > 0 AND 4 * n_stops <= n_words"),
]
#: Starting values: P(good), and for each rule P(good vote | good) and P(bad vote | bad).
PRIOR, SURE_GOOD, SURE_BAD, ROUNDS = 0.9, 0.98, 0.6, 20
#: Pseudo-counts that keep an accuracy of a rule that rarely votes near its starting value.
WEIGHT = 10.0
THRESHOLD = 0.5

_LET = "element_at(transform(array({x}), {v} -> {body}), 1)"


def _let(v: str, x: str, body: str) -> str:
    return _LET.format(v=v, x=x, body=body)


def text_stats(text: str = "text") -> dict[str, str]:
    """SQL expressions of the counts of one text. Lambda variables serve as let-bindings, so nothing is evaluated twice."""
    t = f"coalesce(`{text}`, '')"
    words = f"filter(split(btrim({t}, {TRIM}), '{WS}'), w -> w <> '')"
    lines = rf"filter(split({t}, '\\n'), l -> btrim(l, {TRIM}) <> '')"
    hashed = "transform(w, x -> xxhash64(x))"
    windows = "CASE WHEN size(h) < 5 THEN array() ELSE transform(slice(h, 1, size(h) - 4), (x, i) -> xxhash64(x, get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))) END"
    twice = _let(
        "s",
        "array_sort(transform(g, (x, i) -> named_struct('g', x, 'i', i)))",
        "array_sort(transform(filter(s, (x, k) -> coalesce(get(s, k - 1).g = x.g, false) OR coalesce(get(s, k + 1).g = x.g, false)), x -> x.i))",
    )
    covered = "aggregate(" + twice + ", named_struct('n', 0, 'at', -5), (a, p) -> named_struct('n', a.n + least(5, p - a.at), 'at', p), a -> a.n)"
    repeat = _let("h", hashed, _let("g", windows, f"CASE WHEN size(array_distinct(g)) = size(g) THEN 0 ELSE {covered} END"))
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    per_words = _let(
        "w", words, f"named_struct('n_words', size(w), 'n_repeat_words', {repeat}, 'n_stop', size(filter(w, x -> lower(x) IN ({stop}))), 'n_stops', size(filter(w, x -> right(x, 1) IN ('.', '!', '?'))))"
    )
    per_lines = _let("l", lines, "named_struct('n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)))")
    return {
        "w": per_words,
        "l": per_lines,
        "word_chars": f"length(regexp_replace({t}, '{WS}', ''))",
        "n_symbols": f"length({t}) - length(translate({t}, '#*$%&|<>', ''))",
        "n_upper": rf"length(regexp_replace({t}, '[^\\p{{Lu}}]+', ''))",
    }


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stop", "n_stops"]


def measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and the counts."""
    one = docs.select(*keep, *[F.expr(v).alias(f"__q_{k}") for k, v in text_stats(text).items()])
    of = lambda c: f"__q_w.{c}" if c in ("n_words", "n_repeat_words", "n_stop", "n_stops") else f"__q_l.{c}" if c in ("n_lines", "n_dup_lines") else f"__q_{c}"
    return one.select(*keep, *[F.col(of(c)).cast("long").alias(c) for c in STATS])


def with_votes(stats: DataFrame) -> DataFrame:
    votes = [f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END" for _, bad, good in RULES]
    return stats.withColumn("votes", F.expr(f"array({', '.join(votes)})"))


def posteriors(voted: DataFrame) -> DataFrame:
    """votes (pattern), posterior: expectation-maximisation inside one SQL aggregate over the bounded pattern table."""
    k = len(RULES)
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    one = patterns.agg(F.expr("array_sort(collect_list(struct(votes, cast(n as double) n)))").alias("p"))
    # likelihood of a pattern under a state s (prior, g: P(1|good), b: P(0|bad)), as log odds
    odds = (
        "ln(s.prior / (1 - s.prior)) + aggregate(sequence(1, {k}), 0D, (z, j) -> z + CASE get({v}, j - 1) WHEN 1 THEN ln(get(s.g, j - 1) / (1 - get(s.b, j - 1)))"
        " WHEN 0 THEN ln((1 - get(s.g, j - 1)) / get(s.b, j - 1)) ELSE 0D END)"
    )
    post = "1 / (1 + exp(-(" + odds + ")))"
    clip = lambda x: f"least(0.9999D, greatest(0.0001D, {x}))"
    share = "(aggregate(r, {w0}D, (z, x) -> z + CASE WHEN get(x.votes, j - 1) = {hit} THEN x.n * {w} ELSE 0D END) / aggregate(r, {weight}D, (z, x) -> z + CASE WHEN get(x.votes, j - 1) IS NOT NULL THEN x.n * {w} ELSE 0D END))"
    step = _let(
        "r",
        f"transform(p, x -> named_struct('votes', x.votes, 'n', x.n, 'q', {post.format(k=k, v='x.votes')}))",
        "named_struct('prior', "
        + clip(f"(aggregate(r, {WEIGHT * PRIOR}D, (z, x) -> z + x.n * x.q) / aggregate(r, {WEIGHT}D, (z, x) -> z + x.n))")
        + f", 'g', transform(sequence(1, {k}), j -> "
        + clip(share.format(w0=WEIGHT * SURE_GOOD, hit=1, w="x.q", weight=WEIGHT))
        + f"), 'b', transform(sequence(1, {k}), j -> "
        + clip(share.format(w0=WEIGHT * SURE_BAD, hit=0, w="(1 - x.q)", weight=WEIGHT))
        + "))",
    )
    init = f"named_struct('prior', {PRIOR}D, 'g', array_repeat({SURE_GOOD}D, {k}), 'b', array_repeat({SURE_BAD}D, {k}))"
    fitted = one.select("p", F.expr(f"aggregate(sequence(1, {ROUNDS}), {init}, (s, t) -> {step})").alias("s"))
    fitted = fitted.select("s", F.explode("p").alias("x"))
    return fitted.select(F.col("x.votes").alias("votes"), F.expr(post.format(k=k, v="x.votes")).alias("posterior"))


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def _verdicts(voted: DataFrame) -> DataFrame:
    """voted (a written table with the counts and votes) with base_failed, posterior, kept."""
    model = F.broadcast(materialize(posteriors(voted), "quality_model"))  # at most 3^rules rows
    same = F.expr("transform(votes, v -> coalesce(v, 2))")
    out = voted.withColumn("__q_p", same).join(model.withColumn("__q_p", same).drop("votes"), "__q_p", "left").drop("__q_p", "votes")
    out = out.withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", F.expr(f"NOT base_failed AND coalesce(posterior, 0D) >= {THRESHOLD}"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, posterior, kept; one row per input row. Texts are read once: the counts are
    written out, and both the model and the verdicts come from them."""
    one = docs.select(F.col(key).alias("__q_id"), F.col(text).alias("__q_text"))
    out = _verdicts(materialize(with_votes(measured(one, "__q_text", ["__q_id"])), "quality"))
    return out.select(F.col("__q_id").alias(key), *STATS, "base_failed", F.round("posterior", 6).alias("posterior"), "kept")


def keep_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. The rows are written once with their votes, so
    that texts are neither measured twice nor shuffled."""
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    voted = materialize(with_votes(measured(safe, f"__c{docs.columns.index(text)}", safe.columns)), "quality")
    return _verdicts(voted).where("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
