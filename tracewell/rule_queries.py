"""Queries over rules, references, versions and judgements, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import diffs, markdown, references
from tracewell.operators import confidence, constraints, verification
from tracewell.operators.constraints import Rule
from tracewell.plans.views import table
from tracewell.text_queries import _FIRST, m, pairs, q

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    Rule("names a version", "required", "keyword", "version", "warning"),
    Rule("no rights reserved", "forbidden", "phrase", "rights reserved"),
    Rule("no card numbers", "forbidden", "regex", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    Rule("no shouting", "forbidden", "regex", "[A-Z]{6,}", "warning", True),
    Rule("ends sentences", "required", "phrase", ".", "error"),
]


def _docs(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _structure(d: DataFrame) -> DataFrame:
    t = F.col("text")
    return d.select("doc_id", F.size(markdown.code_languages(t)).alias("blocks"), F.size(markdown.heading_levels(t)).alias("headings"), F.coalesce(F.array_max(markdown.heading_levels(t)), F.lit(0)).alias("deepest"), markdown.level_skips(t).alias("skips"), F.size(markdown.missing_sections(t, ["Introduction", "License"])).alias("missing"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a page: of its address and its html."""
    text = F.concat_ws(" ", F.lit("see"), F.concat(F.lit("("), "url", F.lit(").")), "html")
    return references.references(_pages(spark, sf_dir).select("page_id", text.alias("text")), "page_id")


def _unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that pages refer to and that are the path of no page's address."""
    listing = _pages(spark, sf_dir).select(F.lit("path").alias("kind"), F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1).alias("value")).distinct()
    return references.unknown(_links(spark, sf_dir).where("kind = 'path'"), listing).select("page_id", "value")


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with what they report; shipments as records of their orchestrator, and one record by worker for the rest."""
    o = table(spark, sf_dir, "orders")
    said = F.when(F.col("o_orderstatus") == "O", "pass").when(F.col("o_orderstatus") == "F", "fail").otherwise("partial")
    runs = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("w"), (F.col("o_custkey") % 10).cast("string")).alias("worker"), said.alias("outcome"), F.floor("o_totalprice").cast("long").alias("reported_ms"))
    late = F.count_if(F.col("l_returnflag") == "R")
    by_run = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(late.alias("late"), F.floor(F.sum("l_extendedprice")).cast("long").alias("ms"))
    none = F.lit(None)
    by_run = by_run.select(F.col("l_orderkey").cast("string").alias("run_id"), none.cast("string").alias("worker"), F.when(F.col("late") > 1, "error").when(F.col("late") == 1, "running").otherwise("ok").alias("exit_status"), none.cast("int").alias("exit_code"), F.col("ms").alias("measured_ms"))
    by_worker = spark.range(5).select(none.cast("string").alias("run_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("worker"), none.cast("string").alias("exit_status"), (F.col("id") % 2).cast("int").alias("exit_code"), none.cast("long").alias("measured_ms"))
    return verification.verification(runs, by_run.unionByName(by_worker))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as criteria of a judgement; four make a full one."""
    li = table(spark, sf_dir, "lineitem")
    judged = li.select(F.col("l_orderkey").alias("item"), F.round(0.5 + F.col("l_discount") * 5, 6).alias("score"), F.col("l_quantity").cast("double").alias("weight"), F.round(1 - F.col("l_tax") * 10, 6).alias("confidence"), (F.col("l_linenumber") % 3).alias("n_evidence"), F.when(F.col("l_returnflag") == "A", "good").otherwise("the line was compared with its order").alias("reasoning"))
    return confidence.assess(judged, 4)


def _compared(p: DataFrame) -> DataFrame:
    a, b = F.col("task"), F.col("answer")
    return p.select("conv_id", diffs.line_diff(a, b).alias("d"), diffs.cosmetic(a, b).cast("int").alias("cosmetic")).select("conv_id", "d.*", "cosmetic")


# ---- SQL -----------------------------------------------------------------------

_ESCAPED = {r: r.pattern() for r in RULES}


def _rule_sql(r: Rule) -> str:
    there = m("coalesce(text, '')", _ESCAPED[r])
    before = f"substr(text, 1, strpos(text, regexp_extract(text, {q(_ESCAPED[r])})) - 1)"
    place = f"len(string_split({before}, chr(10))) AS line, length(string_split({before}, chr(10))[-1]) AS col" if r.kind == "forbidden" else "NULL AS line, NULL AS col"
    return f"SELECT doc_id, {q(r.name)} AS rule, {q(r.kind)} AS kind, {q(r.severity)} AS severity, {place} FROM documents WHERE {'' if r.kind == 'forbidden' else 'NOT '}{there}"


_VIOLATIONS = "\nUNION ALL ".join(map(_rule_sql, RULES))
_HEADS = f"""WITH o AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), {q(markdown.FENCED)})) AS blocks, regexp_replace(coalesce(text, ''), {q(markdown.FENCED)}, '', 'g') AS x FROM documents),
h AS (SELECT *, list_transform(regexp_extract_all(x, {q(markdown.HEADING)}, 1), lambda s: length(s)) AS lv, list_transform(regexp_extract_all(x, {q(markdown.HEADING)}, 2), lambda s: lower(trim(s))) AS names FROM o)
SELECT doc_id, blocks, len(lv) AS headings, coalesce(list_max(lv), 0) AS deepest, len(list_filter(generate_series(2, len(lv)), lambda i: lv[i] > lv[i - 1] + 1)) AS skips, len(list_filter(['introduction', 'license'], lambda s: NOT list_contains(names, s))) AS missing FROM h"""
_URLS = rf"SELECT DISTINCT page_id, regexp_replace(unnest(regexp_extract_all(concat_ws(' ', 'see', '(' || url || ').', html), {q(references.URL)})), '[.)>,;:!?]+\z', '') AS value FROM pages"
_VERIFIED = """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_custkey % 10 AS wk, CASE o_orderstatus WHEN 'O' THEN 'pass' WHEN 'F' THEN 'fail' ELSE 'partial' END AS said, CAST(floor(o_totalprice) AS BIGINT) AS ms FROM orders),
md AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, count(*) FILTER (l_returnflag = 'R') AS late, CAST(floor(sum(l_extendedprice)) AS BIGINT) AS real FROM lineitem GROUP BY l_orderkey),
j AS (SELECT r.*, late IS NULL AND wk > 4 AS none, CASE WHEN late > 1 THEN 'fail' WHEN late = 1 THEN 'running' WHEN late = 0 THEN 'pass' WHEN wk < 5 THEN CASE WHEN wk % 2 = 0 THEN 'pass' ELSE 'fail' END END AS truth, real FROM r LEFT JOIN md USING (run_id)),
k AS (SELECT *, CAST(said = 'pass' AND coalesce(truth, '') = 'fail' AS INT) AS e, CAST(coalesce(truth, '') = 'running' AS INT) + CAST(said = 'fail' AND coalesce(truth, '') = 'pass' AS INT) + CAST(coalesce(ms > 0 AND abs(ms - real) > 60000 AND (real = 0 OR ms / CAST(real AS DOUBLE) NOT BETWEEN 0.66 AND 1.5), false) AS INT) AS w FROM j)
SELECT run_id, 'w' || wk AS worker, CASE WHEN none THEN 0.0 ELSE round(greatest(0.0, 1 - 0.6 * e - 0.2 * w), 6) END AS score, CASE WHEN none THEN 'skip' WHEN e > 0 THEN 'fail' WHEN w > 0 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN none THEN 0 ELSE e END AS n_errors, CASE WHEN none THEN 0 ELSE w END AS n_warnings FROM k"""
_ASSESSED = """WITH j AS (SELECT l_orderkey AS item, round(0.5 + CAST(l_discount AS DOUBLE) * 5, 6) AS score, CAST(l_quantity AS DOUBLE) AS weight, round(1 - CAST(l_tax AS DOUBLE) * 10, 6) AS conf, l_linenumber % 3 AS ev, l_returnflag <> 'A' AS says FROM lineitem),
a AS (SELECT item, count(*) AS n, sum(score * weight) / sum(weight) AS overall, sum(conf * weight) / sum(weight) AS self, avg(CAST(ev >= 1 AS INT)) AS evd, avg(ev) AS mev, max(score) - min(score) AS rng, stddev_pop(score) AS sd, avg(CAST(says AS INT)) AS rsn FROM j GROUP BY item),
b AS (SELECT *, abs(round(overall - 0.6, 6)) AS near, least(1.0, evd + least(0.2, mev * 0.05)) AS evs, CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, greatest(0.0, 1 - rng / 0.6) - 0.3 * greatest(0.0, (sd - 0.15) / 0.3)) END AS cons, n / 4.0 AS cov FROM a),
c AS (SELECT *, CAST(round(self, 6) < 0.4 AS INT) + CAST(evd < 0.5 AS INT) + CAST(n >= 2 AND round(rng, 6) > 0.6 AS INT) + CAST(near < 0.1 AS INT) + CAST(cov < 0.8 AS INT) + CAST(rsn < 0.5 AS INT) AS flags, round(0.25 * self + 0.2 * evs + 0.2 * cons + 0.15 * CASE WHEN near < 0.1 THEN near / 0.1 ELSE 1 END + 0.1 * cov + 0.1 * rsn + 1e-9, 6) AS confidence FROM b),
d AS (SELECT *, CASE WHEN flags >= 3 THEN 'contradictory' WHEN confidence < 0.6 THEN 'needs-review' WHEN near < 0.1 THEN 'borderline' WHEN evd < 0.5 THEN 'low-evidence' ELSE 'trust-verdict' END AS recommendation FROM c),
e AS (SELECT *, recommendation = 'trust-verdict' OR (recommendation = 'low-evidence' AND confidence >= 0.7) AS trust FROM d)
SELECT item, confidence, flags AS n_flags, recommendation, CAST(trust AS INT) AS trustworthy, CASE WHEN NOT trust THEN 'needs-human-review' WHEN round(overall, 6) >= 0.6 THEN 'pass' ELSE 'fail' END AS verdict FROM e"""

#: Name -> (query, SQL for DuckDB).
REGISTRY: dict[str, tuple[Query, str | None]] = {
    "markdown_structure": (_docs(_structure), _HEADS),
    "constraint_violations": (_docs(lambda d: constraints.violations(d, "doc_id", RULES)), _VIOLATIONS),
    "constraints_satisfied": (
        _docs(lambda d: constraints.satisfied(d, "doc_id", RULES)),
        f"WITH v AS ({_VIOLATIONS}), n AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM v GROUP BY doc_id) SELECT doc_id, coalesce(e, 0) AS n_errors, coalesce(w, 0) AS n_warnings, CASE WHEN coalesce(e, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM documents LEFT JOIN n USING (doc_id)",
    ),
    "references": (_links, None),
    "url_references": (lambda s, d: _links(s, d).where("kind = 'url'").select("page_id", "value"), _URLS),
    "unlisted_paths": (_unlisted, None),
    "verification_scores": (_verified, _VERIFIED),
    "confidence_labels": (_assessed, _ASSESSED),
    "answer_diff": (lambda s, d: _compared(pairs(table(s, d, "conversations"))), None),
    "parroting": (
        lambda s, d: pairs(table(s, d, "conversations")).select("conv_id", diffs.parrots(F.col("answer"), F.col("task")).cast("int").alias("parrots")),
        f"WITH {_FIRST}, n AS (SELECT conv_id, trim(regexp_replace(task, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS a FROM p) SELECT conv_id, CAST((length(s) > 20 AND contains(a, s)) OR a = s AS INT) AS parrots FROM n",
    ),
}
