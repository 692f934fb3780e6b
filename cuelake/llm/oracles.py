"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from . import quality_rules as q


def quality_rules_sql() -> str:
    """Counts by windows over unnested words; expectation-maximisation as a recursive query over the vote patterns."""
    n = range(1, len(q.RULES) + 1)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in q.RULES)
    term = lambda i, gu, gd, bu, bd: f"CASE v[{i}] WHEN 1 THEN ln({gu} / {bu}) WHEN -1 THEN ln({gd} / {bd}) ELSE ln((1 - {gu} - {gd}) / (1 - {bu} - {bd})) END"
    logit = "ln(p / (1 - p)) + " + " + ".join(term(i, f"gu{i}", f"gd{i}", f"bu{i}", f"bd{i}") for i in n)
    names = [f"{c}{i}" for i in n for c in ("gu", "gd", "bu", "bd")]
    start = dict(zip(("gu", "gd", "bu", "bd"), (*q.ON_GOOD, *q.ON_BAD)))
    share = lambda vote, w, s: f"(sum(CASE WHEN v[{{i}}] = {vote} THEN n * {w} ELSE 0 END) + CAST({q.PRIOR * s} AS DOUBLE)) / (sum(n * {w}) + {q.PRIOR})"
    raw = {"gu": share(1, "q", start["gu"]), "gd": share(-1, "q", start["gd"]), "bu": share(1, "(1 - q)", start["bu"]), "bd": share(-1, "(1 - q)", start["bd"])}
    raws = ", ".join(f"{raw[c].format(i=i)} AS {c}{i}" for i in n for c in raw)
    held = ", ".join(f"gu{i}, least(gd{i}, bd{i} / {q.TRUST}), least(bu{i}, gu{i}), bd{i}" for i in n)
    starts = ", ".join(f"CAST({start[x[:2]]} AS DOUBLE)" for x in names)
    blank = r"\x20\x09-\x0D"
    count = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '[^{blank}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS g FROM w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, range(0, {q.WINDOW}) AS r(o) GROUP BY rid),
s AS MATERIALIZED (SELECT d.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[{blank}]', '', 'g')) AS word_chars, {count('#*$%&|<>')} AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines, {count(q.CAPITALS)} AS n_capitals, {count('!')} AS n_exclamations,
  {count(r"^\p{L}\p{N}\s\x0B.,;:?'-".replace("'", "''"))} AS n_odd, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…][{blank}]*$'))) AS n_ended_lines,
  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_twins
  FROM d JOIN w ON d.rid = w.rid LEFT JOIN cov ON cov.rid = d.rid),
x AS MATERIALIZED (SELECT *, [{votes}] AS v FROM s),
pat AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY v),
em(k, p, {', '.join(names)}) AS (SELECT 0, CAST({q.SHARE} AS DOUBLE), {starts}
  UNION ALL SELECT k + 1, p, {held} FROM (SELECT k, (sum(n * q) + CAST({q.PRIOR * q.SHARE} AS DOUBLE)) / (sum(n) + {q.PRIOR}) AS p, {raws} FROM (SELECT em.k, v, n, 1 / (1 + exp(-({logit}))) AS q FROM em, pat WHERE k < {q.ROUNDS}) GROUP BY k)),
fit AS (SELECT * FROM em WHERE k = {q.ROUNDS}),
j AS (SELECT x.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1 / (1 + exp(-({logit}))) AS q FROM x, fit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept FROM j"""


def jaccard_join_sql(k: int = 4, percent: int = 85) -> str:
    """Links by counting shared n-grams of all pairs that share one, components by a recursive query."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.rid < y.rid GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
s AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.first_id AS component_id
FROM d LEFT JOIN n ON n.rid = d.rid JOIN (SELECT r.a, min(o.doc_id) AS first_id FROM r JOIN d o ON o.rid = r.b GROUP BY r.a) m ON m.a = d.rid"""


def minhash_dedup_sql() -> str:
    """The exact links: signatures may miss one only with a chance that is no sum of a table's pairs."""
    return f"SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM ({jaccard_join_sql(4, 80)})"


def fill_in_middle_sql() -> str:
    """Units by a regular expression, parts as joined slices of their list; what is restored is the text."""
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draw = lambda i: f"CAST('0x' || h[{8 * i - 7}:{8 * i}] AS UBIGINT)"
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    prefix, middle, suffix = part("1", "a"), part("a + 1", "b"), part("b + 1", "n")
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{unit}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {draw(1)} % (len(u) + 1) AS x, {draw(2)} % (len(u) + 1) AS y, {draw(3)} % 100 AS f, {draw(4)} % 100 AS g FROM d),
e AS (SELECT *, CAST(least(x, y) AS BIGINT) AS a, CAST(greatest(x, y) AS BIGINT) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR f >= 50 THEN 'plain' WHEN g < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length({prefix}) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length({middle}) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || {prefix} || '<S>' || {suffix} || '<M>' || {middle} ELSE '<S>' || {suffix} || '<P>' || {prefix} || '<M>' || {middle} END) AS output_sha256, sha256(t) AS restored_sha256
FROM e"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard_join_sql(), "op9_quality_rules": quality_rules_sql(), "op11_fill_in_middle": fill_in_middle_sql(), "op13_minhash_dedup": minhash_dedup_sql()}
