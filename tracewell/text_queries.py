"""Queries over texts, beside their SQL: completeness, abandonment, formats, repetition, actionability, relevance and grounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import actionability as act
from tracewell.functions import completeness as C
from tracewell.functions import drift as D
from tracewell.functions import grounding as G
from tracewell.functions import patterns as P
from tracewell.functions import repetition as R
from tracewell.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]


def pairs(c: DataFrame) -> DataFrame:
    """(conv_id, task, answer): the first user turn and the last assistant turn."""
    return c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("task"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pairs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(pairs(table(spark, sf_dir, "conversations")))


def _formats(d: DataFrame) -> DataFrame:
    return d.select("doc_id", *(F.coalesce(rule, F.lit(False)).cast("int").alias(f"is_{name}") for name, rule in C.formats(F.col("text")).items()))


def _sql(pattern: str) -> str:
    """A pattern as a SQL string in RE2's dialect."""
    return "'" + pattern.replace(r"\z", "$").replace("(?i:", "(?i:").replace("'", "''") + "'"


def _claims_sql(source: str, item: str, text: str) -> str:
    """chosen (item, cs): claims by kind, the spans of each pattern in turn, those that overlap earlier ones left out; by regular expressions that find whole spans, and a fold over the list."""
    trim = lambda x: f"regexp_replace(regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+', ''), '[ \\t\\n\\x0B\\f\\r]+$', '')"
    no_claim = " OR ".join(f"regexp_matches(x, {_sql(p)})" for p in P.NON_CLAIM)
    placed = lambda found, kind, sure, rule: f"list_filter(list_transform(list_filter(list_transform({found}, lambda x: {trim('x')}), lambda x: {rule} AND NOT ({no_claim})), lambda x: {{'s': CAST(instr(t, x) - 1 AS INT), 'e': CAST(instr(t, x) - 1 + length(x) AS INT), 'kind': '{kind}', 'confidence': CAST({sure} AS DOUBLE), 'claim': x}}), lambda x: x.s >= 0)"
    spans = [placed(f"regexp_extract_all(p, {_sql('([^.!?' + chr(92) + 'n]*?' + sign + '[^.!?' + chr(92) + 'n]*)')}, 1)", kind, sure, "length(x) >= 15") for kind, sign, sure in P.CLAIM_KINDS]
    parts = "string_split(regexp_replace(regexp_replace(p, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), '\\n\\s*([A-Z])', chr(1) || '\\1', 'g'), chr(1))"
    spans.append(placed(parts, "factual", 0.5, f"length(x) BETWEEN 20 AND 500 AND regexp_matches(x, {_sql(P.FACTUAL)}) AND NOT regexp_matches(x, {_sql(P.POINTING)})"))
    listed = " || ".join(f"({x})" for x in spans)
    return f"""texts AS (SELECT {item}, coalesce({text}, '') AS t, regexp_replace(regexp_replace(coalesce({text}, ''), {_sql("```(?s:.*?)```")}, ' ', 'g'), {_sql(P.INLINE_CODE)}, ' ', 'g') AS p FROM {source}),
spans AS (SELECT {item}, {listed} AS cs FROM texts),
chosen AS (SELECT {item}, list_sort(list_reduce(list_transform(cs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS cs FROM spans WHERE len(cs) > 0)"""


def _referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, answer, reference): the last assistant turn against all turns before it, in order."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = c.groupBy("conv_id").agg(turns.alias("turns"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    at = lambda rule: F.array_join(F.transform(F.filter("turns", rule), lambda t: t["text"]), " ")
    return c.select("conv_id", at(lambda t: (t["turn"] == F.col("last")) & (t["role"] == "assistant")).alias("answer"), at(lambda t: t["turn"] < F.col("last")).alias("reference"))


# ---- SQL -----------------------------------------------------------------------


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def any_of(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(m(text, p) for p in patterns) + ")"


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def i_of(rule: str) -> str:
    return f"CAST({rule} AS INT)"


_DOCS = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '\s+\z', '') AS rt, regexp_replace(regexp_replace(coalesce(text, ''), '\s+\z', ''), '^\s+', '') AS t FROM documents),
l AS (SELECT *, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '')[-1], '') AS last,
  {n_of("text", "[^ \\t\\n\\r\\f\\x0B]+")} AS words, regexp_replace(regexp_replace(regexp_replace(text, {q(P.ABBREVIATION)}, 'ABBR', 'g'), '\d+\.\d+', 'NUM', 'g'), '\.{{2,}}', 'ELLIPSIS', 'g') AS plain FROM d),
b AS (SELECT *, {n_of("plain", "[.!?]+(?:\\s|\\z)")} AS ends FROM l),
c AS (SELECT *, CASE WHEN ends > 0 THEN ends WHEN t <> '' THEN 1 ELSE 0 END AS sentences, (length(t) < 20 AND NOT {m("t", P.SHORT_ANSWER)}) OR {any_of("t", P.STUB)} AS stub, {any_of("rt", P.TRUNCATED)} AS truncated,
  words > 50 AND NOT {m("last", "[.!?:;)\\]}`\"']\\z")} AND NOT {m("last", "^(?:[-*•]\\s|\\d+[.)]\\s|#{1,6}\\s|```)")} AS open_end FROM b)
"""
# The state of the fold is the open quote, or '-', and then the open brackets; X once a bracket has closed another.
_FOLD = r"""list_reduce(regexp_extract_all(regexp_replace(text, '\\["''`]', '', 'g'), '[\[\](){}"''`]'), lambda acc, c: CASE WHEN acc = 'X' THEN 'X' WHEN acc[1] <> '-' THEN CASE WHEN acc[1] = c THEN '-' || acc[2:] ELSE acc END
  WHEN c IN ('"', '''', '`') THEN c || acc[2:] WHEN c IN ('(', '[', '{') THEN acc || c WHEN length(acc) > 1 AND acc[-1:] = translate(c, ')]}', '([{') THEN acc[:length(acc) - 1] ELSE 'X' END, '-')"""
_BALANCED = f"(length({_FOLD}) = 1 AND {_FOLD} <> 'X')"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '')"
_UNIQUE = r"len(list_distinct(regexp_extract_all(lower(text), '[^ \t\n\r\f\x0B]+')))"
_COMPLETE = (
    _DOCS
    + f""", ln AS (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM d), runs AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS grp FROM ln) GROUP BY doc_id, line, grp) GROUP BY doc_id),
v AS (SELECT doc_id, sentences, CASE WHEN t = '' THEN 1 ELSE CAST(stub AS INT) + CAST(truncated AS INT) END AS e, CASE WHEN t = '' THEN 0 ELSE CAST(words > 10 AND round({_UNIQUE} / CAST(greatest(words, 1) AS DOUBLE), 6) < 0.3 AS INT)
  + CAST(coalesce(run, 0) > 3 AS INT) + CAST(sentences > 2 AND words / CAST(greatest(sentences, 1) AS DOUBLE) < 3 AS INT) + CAST({" + ".join(i_of(f"contains(lower(text), {q(p)})") for p in P.FILLER)} >= 3 AS INT) + CAST(NOT {_BALANCED} AS INT) + CAST(open_end AS INT) END AS w FROM c LEFT JOIN runs USING (doc_id))
SELECT doc_id, sentences, e AS n_errors, w AS n_warnings, CAST(e = 0 AS INT) AS complete, round(greatest(0.0, 1 - 0.4 * e - 0.1 * w), 6) AS score FROM v"""
)
_ABANDON_RULES = [("abandoned", k, "warning", m("rt", p)) for k, p in P.ABANDONED.items()] + [
    ("abandoned", "mid sentence", "warning", f"length(last) > 15 AND NOT {m('last', chr(94) + '[#>|`' + chr(92) + '-*' + chr(92) + 'd' + chr(92) + '[(]')} AND NOT {m('last', '[.!?;:)' + chr(92) + ']' + chr(34) + chr(39) + '`]' + chr(92) + 'z')}"),
    ("abandoned", "unfinished marker", "warning", m("rt", P.UNFINISHED)),
    ("abandoned", "unbalanced code", "error", "coalesce(" + " OR ".join(f"length(replace(code, '{a}', '')) <> length(replace(code, '{b}', ''))" for a, b in ("{}", "[]", "()")) + ", false)"),
    ("no_progress", "repeated errors", "warning", f"{n_of('rt', P.FAILURE)} >= 3"),
]
_ABANDON = (
    _DOCS
    + ", e AS (SELECT *, CASE WHEN len(regexp_extract_all(rt, '```[\\w]*\\n([\\s\\S]*?)(?:```|\\z)', 1)) > 0 THEN array_to_string(regexp_extract_all(rt, '```[\\w]*\\n([\\s\\S]*?)(?:```|\\z)', 1), chr(10)) WHEN "
    + m("rt", "[{}\\[\\]()]")
    + " AND "
    + m("rt", "(?:function|class|const|let|var|if|for|while|import|export|def|fn)\\b")
    + " THEN rt END AS code FROM c WHERE length(text) >= 10)\n"
    + "\nUNION ALL ".join(f"SELECT doc_id, {q(k)} AS kind, {q(s)} AS signal, {q(v)} AS severity FROM e WHERE {rule}" for k, s, v, rule in _ABANDON_RULES)
)
_FORMATS = rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+\z', ''), '^\s+', '') AS t FROM documents), r AS (SELECT *, string_split(t, chr(10)) AS rows FROM d), s AS (SELECT *, CASE WHEN contains(rows[1], chr(9)) THEN chr(9) ELSE ',' END AS sep FROM r)
SELECT doc_id, {i_of("json_valid(t) AND t <> ''")} AS is_json, {i_of(m("t", "(?m)^#{1,6}\\s+") + " OR " + m("t", "(?m)^[-*+]\\s|^\\d+\\.\\s|^```|^>"))} AS is_markdown, {i_of("starts_with(t, '---') OR " + m("t", "(?m)^[\\w-]+:\\s"))} AS is_yaml,
  {i_of("starts_with(t, '<?xml') OR (starts_with(t, '<') AND ends_with(t, '>'))")} AS is_xml, CAST(len(rows) >= 2 AND len(list_filter(rows[2:], lambda x: regexp_matches(x, '\S') AND len(string_split(x, sep)) <> len(string_split(rows[1], sep)))) = 0 AS INT) AS is_csv FROM s"""

_FIRST = "p AS (SELECT conv_id, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS task, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id)"


def _type_sql() -> str:
    return "CASE " + " ".join(f"WHEN {' AND '.join(m('lower(task)', p) for p in needed)} THEN {q(name)}" for name, needed in P.RESPONSE_TYPE) + " ELSE 'general' END"


def _actionability_sql() -> str:
    count = {"code-snippet": P.CODE, "file-reference": P.FILE, "command": P.COMMAND, "url-reference": P.URL, "specific-value": P.VALUE}
    e = {k: n_of("s", p) for k, p in count.items()} | {"imperative": i_of(m("s", P.IMPERATIVE)), "step": i_of(m("s", P.STEP)), "decision-point": i_of(m("s", P.DECISION)), "example": i_of(m("s", P.EXAMPLE) + " AND length(s) > 30")}
    f = {k: "(" + " + ".join(i_of(m("s", p)) for p in ps) + ")" for k, ps in (("hedge", P.HEDGE), ("platitude", P.PLATITUDE), ("weasel-word", P.WEASEL))}
    f["restatement"] = i_of("length(task) > 10 AND len(w) > 4 AND len(list_filter(w, lambda x: list_contains(asked, x))) > 0.6 * len(w)")
    f["generic-advice"] = i_of(f"length(s) < 80 AND NOT {any_of('s', [P.CODE, P.FILE, P.URL, P.VALUE])} AND {m('s', P.GENERIC)}")
    f["circular"] = i_of(m("s", P.CIRCULAR))
    f["non-answer"] = i_of(f"{m('s', P.NON_ANSWER)} AND NOT {any_of('s', P.COMMITTED)}")
    weights = " UNION ALL ".join(f"SELECT {q(k)} AS rtype, {a} AS wi, {b} AS ws, {c} AS we" for k, (a, b, c) in P.RESPONSE_WEIGHTS.items())
    x = lambda k: '"' + k + '"'
    return (
        f"WITH {_FIRST}, t AS (SELECT *, {_type_sql()} AS rtype FROM p), wt AS ({weights}),\n"
        f"parts AS (SELECT conv_id, list_concat(flatten(list_transform(regexp_split_to_array(answer, {q(act.BLOCK)}), lambda x: regexp_extract_all(x, {q(act.SENTENCE)}))), regexp_extract_all(answer, {q(act.BLOCK)})) AS found FROM p),\n"
        "one AS (SELECT conv_id, unnest(list_filter(list_transform(found, lambda x: regexp_replace(regexp_replace(x, '\\s+\\z', ''), '^\\s+', '')), lambda x: x <> '')) AS s FROM parts),\n"
        f"s0 AS (SELECT one.*, task, rtype, wi, ws, we, regexp_extract_all(lower(s), {q(act.WORD)}) AS w, regexp_extract_all(lower(task), {q(act.WORD)}) AS asked FROM one JOIN t USING (conv_id) JOIN wt USING (rtype)),\n"
        f"s1 AS (SELECT *, {', '.join(f'{v} AS {x(k)}' for k, v in e.items())}, {', '.join(f'{v} AS {x(k)}' for k, v in f.items())} FROM s0),\n"
        f"s2 AS (SELECT *, {' + '.join(map(x, e))} AS n, {' + '.join(map(x, f))} AS nf, {' + '.join(f'{x(k)} * {P.SPECIFICITY[k]}' for k in e)} AS spec, greatest({', '.join(f'CASE WHEN {x(k)} > 0 THEN {P.SPECIFICITY[k]} ELSE 0 END' for k in e)}) AS best,\n"
        '  wi * CAST("imperative" + "command" + "step" > 0 AS INT) + ws * CAST("file-reference" + "specific-value" + "code-snippet" > 0 AS INT) + we * CAST("example" + "code-snippet" > 0 AS INT) AS by_type,\n'
        f"  least(0.8, {' + '.join(f'{x(k)} * {P.PENALTY[k]}' for k in f)}) AS penalty FROM s1),\n"
        "s3 AS (SELECT conv_id, n, nf, spec, CAST(round(greatest(0, least(1, CASE WHEN n > 0 THEN 0.4 * (best + least(0.2, (n - 1) * 0.05)) + 0.6 * by_type ELSE 0 END - penalty)), 6) AS DOUBLE) AS score FROM s2),\n"
        "a AS (SELECT conv_id, count(*) AS k, avg(score) AS mean, avg(CAST(score >= 0.3 AS INT)) AS acts, avg(CAST(score < 0.3 AND nf > 0 AS INT)) AS fills, coalesce(CAST(sum(spec) AS DOUBLE) / nullif(sum(n), 0), 0.0) AS sp FROM s3 GROUP BY conv_id),\n"
        "o AS (SELECT t.conv_id, rtype AS response_type, coalesce(k, 0) AS sentences, coalesce(round(0.4 * mean + 0.3 * acts + 0.2 * sp + 0.1 * (1 - fills), 6), 0.0) AS score, coalesce(round(acts, 6), 0.0) AS actionable_ratio, coalesce(round(fills, 6), 0.0) AS filler_ratio, coalesce(round(sp, 6), 0.0) AS specificity FROM t LEFT JOIN a USING (conv_id))\n"
        "SELECT *, CAST(score >= 0.4 AND actionable_ratio >= 0.3 AS INT) AS passed FROM o"
    )


def _relevance_sql() -> str:
    def case(ending: str, least: int, tail: str, undouble: bool) -> str:
        base = f"w[:length(w) - {len(ending)}] || '{tail}'"
        if undouble:
            base = f"CASE WHEN length({base}) > 2 AND ({base})[-1:] = ({base})[-2:-2] THEN ({base})[:length({base}) - 1] ELSE {base} END"
        return f"WHEN ends_with(w, '{ending}') AND length(w) >= {max(least, 4)} THEN {base}"

    stops = ", ".join(map(q, P.STOPWORDS))
    return f"""WITH {_FIRST}, side AS (SELECT conv_id, 1 AS t, task AS x FROM p UNION ALL SELECT conv_id, 0, answer FROM p), ws AS (SELECT conv_id, t, list_filter(string_split(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND w NOT IN ({stops}) AND NOT regexp_matches(w, '^\\d{{1,3}}$')) AS ws FROM side),
one AS (SELECT conv_id, t, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws), st AS (SELECT conv_id, t, i, CASE {" ".join(case(*r) for r in P.STEM)} ELSE w END AS s FROM one),
g AS (SELECT conv_id, t, s FROM st UNION ALL SELECT conv_id, t, s || ' ' || nxt FROM (SELECT *, lead(s) OVER (PARTITION BY conv_id, t ORDER BY i) AS nxt FROM st) WHERE nxt IS NOT NULL),
n AS (SELECT conv_id, s, count(*) FILTER (t = 1) AS a, count(*) FILTER (t = 0) AS b FROM g GROUP BY ALL), k AS (SELECT conv_id, a, b, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE {G.UNSHARED} END AS w FROM n),
c AS (SELECT conv_id, sum(a * b) AS dot, sum(pow(a * w, 2)) AS na, sum(pow(b * w, 2)) AS nb FROM k GROUP BY conv_id)
SELECT p.conv_id, CASE WHEN na > 0 AND nb > 0 THEN round(dot / sqrt(na * nb), 6) ELSE 0.0 END AS relevance FROM p LEFT JOIN c USING (conv_id)"""


def _requirements_sql() -> str:
    verbs, fillers = (", ".join(map(q, x)) for x in (P.ACTION_VERBS, P.SUBJECT_FILLERS))
    ends = r"\s+and\s+|\s+then\s+|\s+also\s+|;\s*|\.\s+([A-Z])"
    trimmed = lambda x: f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return rf"""WITH {_FIRST}, t AS (SELECT conv_id, {trimmed("coalesce(task, '')")} AS task FROM p), l AS (SELECT *, list_filter(list_transform(string_split(task, chr(10)), lambda x: {trimmed("x")}), lambda x: x <> '') AS lines FROM t),
c AS (SELECT conv_id, CASE WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^[-*•]\s+'))) = 0 THEN list_transform(lines, lambda x: regexp_replace(x, '^[-*•]\s+', ''))
  WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '^\d+[.):]\s+'))) = 0 THEN list_transform(lines, lambda x: regexp_replace(x, '^\d+[.):]\s+', ''))
  ELSE string_split(regexp_replace(task, '{ends}', chr(1) || '\1', 'g'), chr(1)) END AS clauses FROM l),
d AS (SELECT conv_id, list_filter(list_transform(clauses, lambda x: {trimmed("x")}), lambda x: x <> '') AS clauses FROM c),
e AS (SELECT conv_id, unnest(clauses) AS description, generate_subscripts(clauses, 1) - 1 AS req FROM d), w AS (SELECT *, regexp_split_to_array(lower(description), '\s+') AS words FROM e),
v AS (SELECT *, coalesce(list_position(list_transform(words[1:5], lambda x: regexp_replace(x, '[^a-z]', '', 'g') IN ({verbs})), true), 0) AS verb FROM w),
s AS (SELECT *, CASE WHEN verb > 0 THEN trim(regexp_replace(array_to_string(list_filter(words[verb + 1:], lambda x: x NOT IN ({fillers})), ' '), '[^a-z0-9\s#@./_-]', '', 'g')) ELSE '' END AS subj FROM v)
SELECT conv_id, CAST(req AS INT) AS req, description, CASE WHEN verb > 0 THEN regexp_replace(words[verb], '[^a-z]', '', 'g') ELSE 'address' END AS action, CASE WHEN subj <> '' THEN subj ELSE lower(description) END AS subject, CASE WHEN subj <> '' THEN 0.8 ELSE 0.4 END AS confidence FROM s"""


#: Name -> (query, SQL for DuckDB).
_CONTENT = "regexp_extract_all(lower({x}), '[a-z0-9_]{{3,}}')"
_SPLIT = "regexp_split_to_array({x}, '[ \\t\\n\\x0B\\f\\r]+')"
_NUMBERS = "list_transform(regexp_extract_all({x}, '[0-9]+(?:\\.[0-9]+)?'), lambda n: CAST(n AS DOUBLE))"
_GROUNDING = f"""WITH last AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id),
qa AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn, role, text) FILTER (turn = last AND role = 'assistant'), '') AS answer, coalesce(string_agg(text, ' ' ORDER BY turn, role, text) FILTER (turn < last), '') AS ref FROM conversations JOIN last USING (conv_id) GROUP BY conv_id),
{_claims_sql('qa', 'conv_id', 'answer')},
c AS (SELECT conv_id, ref, row_number() OVER () AS k, x.kind AS kind, x.claim AS claim FROM (SELECT conv_id, unnest(cs) AS x FROM chosen) JOIN qa USING (conv_id)),
w AS (SELECT *, {_SPLIT.format(x='ref')} AS words, greatest(len({_SPLIT.format(x='claim')}) * 2, 100) AS n, list_distinct({_CONTENT.format(x='claim')}) AS own FROM c),
i AS (SELECT k, own, unnest(generate_series(0, greatest(0, len(words) - n), greatest(1, n // 3))) AS i, words, n FROM w),
v AS (SELECT k, i, array_to_string(words[i + 1:i + n], ' ') AS passage, own FROM i),
u AS (SELECT *, list_distinct({_CONTENT.format(x='passage')}) AS got FROM v),
l AS (SELECT k, i, passage, CASE WHEN len(own) > 0 AND len(got) > 0 THEN len(list_intersect(own, got)) / CAST(len(list_distinct(own || got)) AS DOUBLE) ELSE 0 END AS likeness FROM u),
best AS (SELECT k, likeness, CASE WHEN likeness > 0 THEN passage ELSE '' END AS passage FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY likeness DESC, i) = 1),
m AS (SELECT *, CASE WHEN contains(lower(ref), lower(claim)) THEN 1.0 ELSE best.likeness END AS near, best.likeness >= 0.4 AND len(list_filter({_NUMBERS.format(x='claim')}, lambda a: len(list_filter({_NUMBERS.format(x='passage')}, lambda b: a <> b AND abs(a - b) / greatest(a, b, 1) > 0.3)) > 0)) > 0 AS wrong FROM w JOIN best USING (k)),
judged AS (SELECT conv_id, claim, kind, round(near, 6) AS likeness, CASE WHEN regexp_matches(claim, {_sql(P.SELF_REFERENCE)}) OR ref = '' THEN 'unverifiable' WHEN near >= 0.8 THEN 'grounded' WHEN near >= 0.4 THEN CASE WHEN wrong THEN 'contradicted' WHEN near >= 0.7 THEN 'grounded' ELSE 'partial' END ELSE 'ungrounded' END AS status FROM m)
"""

REGISTRY: dict[str, tuple[Query, str | None]] = {
    "sentence_counts": (_docs(lambda d: d.select("doc_id", C.count_sentences(F.col("text")).alias("sentences"))), _DOCS + "SELECT doc_id, sentences FROM c"),
    "stub_truncation": (
        _docs(lambda d: d.select("doc_id", C.is_stub(F.col("text")).cast("int").alias("stub"), C.is_truncated(F.col("text")).cast("int").alias("truncated"), C.incomplete_ending(F.col("text")).cast("int").alias("open_end"))),
        _DOCS + "SELECT doc_id, CAST(stub AS INT) AS stub, CAST(truncated AS INT) AS truncated, CAST(open_end AS INT) AS open_end FROM c",
    ),
    "completeness": (_docs(lambda d: C.completeness(d, "doc_id")), _COMPLETE),
    "brackets": (_docs(lambda d: d.select("doc_id", C.brackets_balanced(F.col("text")).cast("int").alias("balanced"))), _DOCS + f"SELECT doc_id, CAST({_BALANCED} AS INT) AS balanced FROM c"),
    "abandonment": (_docs(lambda d: C.abandonment(d, "doc_id")), _ABANDON),
    "format_sniff": (_docs(_formats), _FORMATS),
    "repetition": (_docs(lambda d: d.select("doc_id", R.repetition(F.col("text")).alias("r")).select("doc_id", "r.*")), None),
    "line_loops": (_docs(lambda d: d.select("doc_id", R.loops(F.col("text")).alias("r")).select("doc_id", "r.*")), None),
    "tripled_blocks": (_docs(lambda d: d.select("doc_id", R.tripled_block(F.col("text")).cast("int").alias("tripled"))), None),
    "response_type": (_pairs(lambda p: p.select("conv_id", act.response_type(F.coalesce("task", F.lit(""))).alias("response_type"))), f"WITH {_FIRST} SELECT conv_id, {_type_sql()} AS response_type FROM p"),
    "actionability": (_pairs(lambda p: act.actionability(p, "conv_id")), _actionability_sql()),
    "task_relevance": (_pairs(lambda p: G.relevance(p, "conv_id")), _relevance_sql()),
    "task_requirements": (_pairs(lambda p: D.requirements(p, "conv_id")), _requirements_sql()),
    "task_drift": (_pairs(lambda p: D.drift(p, "conv_id")), None),
    "typed_claims": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.explode(G.typed_claims(F.col("text"))).alias("c")).select("doc_id", F.col("c.start").alias("start"), F.col("c.end").alias("end"), "c.kind", "c.confidence"),
        f"WITH {_claims_sql('documents', 'doc_id', 'text')} SELECT doc_id, c.s AS start, c.e AS \"end\", c.kind AS kind, c.confidence AS confidence FROM (SELECT doc_id, unnest(cs) AS c FROM chosen)",
    ),
    "claim_grounding": (lambda s, d: G.verified(_referenced(s, d), "conv_id", typed=True), _GROUNDING + "SELECT * FROM judged"),
    "hallucination": (
        lambda s, d: G.hallucination(G.verified(_referenced(s, d), "conv_id", typed=True), "conv_id"),
        _GROUNDING + """SELECT conv_id, count(*) AS claims, count(*) FILTER (status = 'grounded') AS grounded, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'ungrounded') AS ungrounded, count(*) FILTER (status = 'contradicted') AS contradicted,
  round(coalesce(avg(CASE status WHEN 'contradicted' THEN 1.0 WHEN 'ungrounded' THEN 0.8 WHEN 'partial' THEN 0.3 WHEN 'grounded' THEN 0.0 END), 0.0), 6) AS score, round(avg(CASE WHEN status IN ('grounded', 'partial') THEN 1.0 WHEN status <> 'unverifiable' THEN 0.0 END), 6) AS grounded_share FROM judged GROUP BY conv_id""",
    ),
}
