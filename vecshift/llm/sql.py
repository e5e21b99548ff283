"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import quality as Q

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d WHERE r.c < e.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) ON d = doc_id"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS d, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.d WHERE r.c < l.y)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) ON d = vec_id"""

OP11 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(s>|(INST|SYS|ROLE)\])')) AS n, length(role) + len(regexp_extract_all(role, '[<\[]\\*/?(s>|(INST|SYS|ROLE)\])')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 6 ELSE 21 + r END))::BIGINT AS formatted_chars, 0::BIGINT AS n_rewrites FROM e GROUP BY conv_id"""

OP12 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2, ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, text, array_to_string(w[1:x], '') AS p, array_to_string(w[x + 1:y], '') AS m, array_to_string(w[y + 1:n], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def op5() -> str:
    """Counts, votes, and the rounds of expectation-maximisation written out."""
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END" for _, bad, good in Q.RULES)
    stop = ", ".join(f"'{x}'" for x in Q.STOP_WORDS)
    clip = lambda x: f"least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, {x}))"
    w = f"{Q.WEIGHT}::DOUBLE"
    start = f"s0 AS MATERIALIZED (SELECT unnest(range(1, {len(Q.RULES) + 1})) AS j, {Q.PRIOR}::DOUBLE AS prior, {Q.SURE_GOOD}::DOUBLE AS g, {Q.SURE_BAD}::DOUBLE AS b)"
    post = "q{i} AS MATERIALIZED (SELECT id, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + sum(CASE v WHEN 1 THEN ln(g / (1 - b)) WHEN 0 THEN ln((1 - g) / b) ELSE 0 END)))) AS q FROM pv JOIN s{i} USING (j) GROUP BY id, n, prior)"
    step = (
        "s{k} AS MATERIALIZED (SELECT j, (SELECT " + clip(f"({w} * {Q.PRIOR} + sum(n * q)) / ({w} + sum(n))") + " FROM q{i}) AS prior, "
        + clip(f"({w} * {Q.SURE_GOOD} + coalesce(sum(pv.n * q) FILTER (v = 1), 0)) / ({w} + coalesce(sum(pv.n * q) FILTER (v IS NOT NULL), 0))") + " AS g, "
        + clip(f"({w} * {Q.SURE_BAD} + coalesce(sum(pv.n * (1 - q)) FILTER (v = 0), 0)) / ({w} + coalesce(sum(pv.n * (1 - q)) FILTER (v IS NOT NULL), 0))") + " AS b FROM pv JOIN q{i} USING (id) GROUP BY j)"
    )
    rounds = [start]
    for i in range(Q.ROUNDS):
        rounds += [post.format(i=i), step.format(i=i, k=i + 1)]
    rounds.append(post.format(i=Q.ROUNDS))
    return rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {_WORDS.format(t="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) >= 5)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE twice) GROUP BY r),
m AS MATERIALIZED (SELECT t.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
 len(l) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop, len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_stops FROM t LEFT JOIN c USING (r)),
x AS MATERIALIZED (SELECT *, [{votes}] AS votes FROM m),
p AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n, row_number() OVER (ORDER BY votes) AS id FROM x GROUP BY votes),
pv AS MATERIALIZED (SELECT id, n, unnest(range(1, {len(Q.RULES) + 1})) AS j, unnest(votes) AS v FROM p),
{", ".join(rounds)}
SELECT doc_id, {", ".join(Q.STATS)}, {Q.BASE_FAILED} AS base_failed, round(q, 6) AS posterior, NOT ({Q.BASE_FAILED}) AND q >= {Q.THRESHOLD} AS kept FROM x JOIN p ON x.votes IS NOT DISTINCT FROM p.votes JOIN q{Q.ROUNDS} USING (id)"""
