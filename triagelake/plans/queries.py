"""The registered queries of the findings operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..functions import tables as T
from ..operators import dedup, evaluate, fp, graph, health, remediate, score, secrets, sets, suppress, threat
from ..operators.components import connected_components
from ..schema import FINDING
from ..sinks import report, texts
from .harness import F_CTE, findings, flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = F_CTE + sql if sql.lstrip().startswith(("SELECT", ",")) else sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NORM = "CASE WHEN regexp_extract({c}, '(?i)CWE-([0-9]+)', 1) <> '' THEN concat('CWE-', regexp_extract({c}, '(?i)CWE-([0-9]+)', 1)) WHEN regexp_matches({c}, '^[0-9]+$') THEN concat('CWE-', {c}) END"
_FAMILY = "CASE {c} " + " ".join(f"WHEN '{c}' THEN {k}" for k, fam in enumerate(T.CWE_FAMILIES) for c in fam) + " END"
_REACH = """CASE WHEN exposure = 'HTTP' THEN 1.0e0 WHEN exposure = 'REPO' THEN 0.8e0 WHEN exposure = 'HIST' THEN 0.5e0 WHEN exposure = 'WORKER' THEN 0.7e0
 WHEN exposure = 'STARTUP' THEN 0.4e0 WHEN exposure = 'CLI' THEN 0.3e0 WHEN exposure = 'INTNL' THEN 0.2e0
 WHEN exposure = 'TEST' THEN CASE WHEN engine = 'secrets' OR coalesce(cwe, '') IN ('CWE-259', 'CWE-798') THEN 0.8e0 ELSE 0.0e0 END
 WHEN exposure IN ('DEAD', 'NONE') THEN 0.0e0 WHEN exposure = 'UNKNOWN' OR reachable IS NULL THEN 0.5e0 WHEN reachable THEN 1.0e0 ELSE 0.0e0 END"""
_CLAMP = "least(greatest(coalesce({x}, 0.0e0), 0.0e0), 1.0e0)"
_BASE = "((((((0.30e0 * {a} + 0.20e0 * {b}) + 0.15e0 * {c}) + 0.15e0 * {d}) + 0.10e0 * {e}) + 0.05e0 * {g}) + 0.05e0 * {h}) / {t} * 100.0e0".format(
    a=_CLAMP.format(x="severity / 10.0e0"), b=_CLAMP.format(x="coalesce(epss, exploitability)"), c="CASE WHEN kev THEN 1.0e0 ELSE 0.0e0 END", d=_REACH,
    e=_CLAMP.format(x="blast_radius / 10.0e0"), g=_CLAMP.format(x="churn"), h=_CLAMP.format(x="code_health_penalty"), t=repr(sum(T.WEIGHTS.values())) + "e0")
_SCORED = f""", s0 AS (SELECT *, round(least(greatest({_BASE}, 0.0e0), 100.0e0), 2) AS v0 FROM f),
s1 AS (SELECT *, CASE WHEN is_ref_id THEN round(v0 * 0.5e0, 2) ELSE v0 END AS v1 FROM s0),
s2 AS (SELECT *, CASE WHEN rotated THEN round(v1 * 0.2e0, 2) ELSE v1 END AS v2 FROM s1),
s AS (SELECT *, CASE WHEN fp_likelihood = 'HIGH' THEN round(v2 * 0.2e0, 2) WHEN fp_likelihood = 'MEDIUM' THEN round(v2 * 0.6e0, 2) ELSE v2 END AS risk_score FROM s2) """
_FILE = "lower(replace(trim(file), chr(92), '/'))"
_RULE = "lower(trim(coalesce(nullif(cwe, ''), title)))"
_RULE_DEP = f"CASE WHEN engine = 'dependency' THEN lower(trim(title)) ELSE {_RULE} END"
_CLEAN = "substr(regexp_replace(evidence, '\\s+', '', 'g'), 1, 200)"
_FP = f""", p0 AS (SELECT *, {_RULE_DEP} AS rule, {_CLEAN} AS clean FROM f),
p1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY {_FILE}, rule, clean ORDER BY ord) - 1 AS INT) AS occurrence FROM p0),
p AS (SELECT *, substr(sha256(concat({_FILE}, ':', rule, ':', clean, ':', occurrence)), 1, 16) AS fp FROM p1) """


# Scoring and ranking -----------------------------------------------------------------------------


@query(f"{_SCORED} SELECT fid, {_BASE} AS base, risk_score FROM s")
def risk_score(spark, sf_dir):
    rows = findings(spark, sf_dir)
    scored = score.score(rows)
    return scored.select("fid", score.combine(score.signals(score.ScoringConfig()), dict(T.WEIGHTS)).alias("base"), "risk_score")


@query(f"{_SCORED} SELECT fid, engine, severity, risk_score FROM s ORDER BY risk_score DESC, severity DESC, exploitability DESC, ord LIMIT 15")
def risk_top_k(spark, sf_dir):
    return score.top(score.score(findings(spark, sf_dir)), 15).select("fid", "engine", "severity", "risk_score")


@query(" SELECT CASE WHEN severity >= 9 THEN 'critical' WHEN severity >= 7 THEN 'high' WHEN severity >= 4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM f GROUP BY 1")
def severity_bands(spark, sf_dir):
    return score.severity_bands(findings(spark, sf_dir))


@query("""WITH x AS (SELECT 1) SELECT c_custkey AS custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders, coalesce(max(n_lines), 0) AS max_lines,
  least(1.0e0, coalesce(max(o_totalprice), 0.0e0) / 500000.0e0) * 0.5e0 + least(1.0e0, count(o_orderkey) / 20.0e0) * 0.5e0 AS score
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY c_custkey""")
def risk_by_customer(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    both = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    value = F.least(F.lit(1.0), F.coalesce(F.max("o_totalprice"), F.lit(0.0)) / 500000.0) * 0.5 + F.least(F.lit(1.0), F.count("o_orderkey") / 20.0) * 0.5
    return both.groupBy(F.col("c_custkey").alias("custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.coalesce(F.max("n_lines"), F.lit(0)).alias("max_lines"), value.alias("score"))


# Suppression -------------------------------------------------------------------------------------


@query(f"{_FP} SELECT fid, rule, occurrence, fp FROM p")
def fingerprints(spark, sf_dir):
    return suppress.fingerprinted(findings(spark, sf_dir)).select("fid", "rule", "occurrence", "fp")


def _baseline(spark, sf_dir):
    return suppress.fingerprinted(findings(spark, sf_dir)).where("event_type IN ('signup', 'view')").select(F.col("fp").alias("fingerprint"))


@query(f"{_FP} SELECT fid, fp IN (SELECT fp FROM p WHERE event_type IN ('signup', 'view')) AS known FROM p")
def baseline_match(spark, sf_dir):
    return suppress.in_baseline(findings(spark, sf_dir), _baseline(spark, sf_dir)).select("fid", "known")


@query(" SELECT event_id AS id, regexp_matches(lower(t), '^(cwe-[0-9]+|b[0-9]{3}|cve-[0-9]{4}-[0-9]+|ghsa-[a-z0-9-]+)$') OR regexp_matches(lower(t), '^(scip|bandit|semgrep|rules)\\.') OR regexp_matches(t, '^[a-zA-Z0-9_-]+(\\.[a-zA-Z0-9_-]+){2,}$') AS valid FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('B', 100 + event_id % 900) WHEN 1 THEN concat('CVE-2024-', event_id) WHEN 2 THEN concat('a.b.rule', event_id) WHEN 3 THEN concat('word', event_id) ELSE 'rules.x' END AS t FROM events)")
def rule_ids(spark, sf_dir):
    t = F.expr("CASE event_id % 5 WHEN 0 THEN concat('B', 100 + event_id % 900) WHEN 1 THEN concat('CVE-2024-', event_id) WHEN 2 THEN concat('a.b.rule', event_id) WHEN 3 THEN concat('word', event_id) ELSE 'rules.x' END")
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), C.rule_id_valid(t).alias("valid"))


# Correlation -------------------------------------------------------------------------------------

_SIDE = f""", n AS (SELECT fid, ord, engine, regexp_replace(trim(file), '^(\\./|/)+', '') AS path, line, cwe, {_NORM.format(c='cwe')} AS norm,
  list_sort(list_distinct(regexp_extract_all(lower(concat(title, ' ', description)), '\\b({"|".join(T.CLASS_KEYWORDS)})\\b', 1))) AS words FROM f) """


@query(f"""{_SIDE} SELECT a.fid AS fid_a, b.fid AS fid_b FROM n a JOIN n b ON a.path = b.path AND a.line = b.line AND a.ord < b.ord AND a.engine <> b.engine
 WHERE a.engine <> 'dependency' AND b.engine <> 'dependency' AND (coalesce(a.norm = b.norm OR {_FAMILY.format(c='a.norm')} = {_FAMILY.format(c='b.norm')}, false)
 OR ((a.norm IS NULL OR b.norm IS NULL) AND list_has_any(a.words, b.words)))""")
def duplicate_pairs(spark, sf_dir):
    return dedup.duplicate_pairs(findings(spark, sf_dir))


@query(""" SELECT file, line, max(severity) AS severity, max(exploitability) AS exploitability, max(risk) AS blast, list_sort(list(DISTINCT engine)) AS engines, CAST(count(*) AS BIGINT) AS sources_count,
 bool_and(suppressed) AS suppressed, arg_max(fid, lead) AS fid FROM (SELECT *, blast_radius AS risk, (CASE WHEN suppressed THEN 0 ELSE 1 END) * 1e12 + round(severity * 10) * 1e9 + CASE engine WHEN 'semgrep' THEN 3 WHEN 'bandit' THEN 2 WHEN 'secrets' THEN 1 ELSE 0 END * 1e8 - ord AS lead FROM f) GROUP BY file, line""")
def merged_clusters(spark, sf_dir):
    out = dedup.merge_by_key(findings(spark, sf_dir), ["file", "line"])
    return out.select("file", "line", "severity", "exploitability", F.col("blast_radius").alias("blast"), "engines", "sources_count", "suppressed", "fid")


@query()
def greedy_clusters(spark, sf_dir):
    return dedup.cluster(findings(spark, sf_dir))


@query()
def deduplicated(spark, sf_dir):
    return dedup.deduplicate(findings(spark, sf_dir)).select("fid", "ord", "engine", "file", "line", "cwe", "severity", "extra.corroborating_engines", "extra.sources_count")


@query(f" SELECT fid, {_NORM.format(c='cwe')} AS norm, list_sort(list_distinct(regexp_extract_all(lower(description), '\\b({'|'.join(T.CLASS_KEYWORDS)})\\b', 1))) AS words FROM f")
def cwe_and_keywords(spark, sf_dir):
    return findings(spark, sf_dir).select("fid", C.cwe(F.col("cwe")).alias("norm"), C.keywords(F.col("description")).alias("words"))


@query(f", c AS (SELECT DISTINCT cwe, {_NORM.format(c='cwe')} AS norm FROM f WHERE cwe IS NOT NULL) SELECT a.cwe AS a, b.cwe AS b, coalesce(a.norm = b.norm OR {_FAMILY.format(c='a.norm')} = {_FAMILY.format(c='b.norm')}, false) AS compatible FROM c a, c b WHERE a.cwe <= b.cwe")
def cwe_compatibility(spark, sf_dir):
    c = findings(spark, sf_dir).where("cwe is not null").select("cwe").distinct()
    # The weaknesses in use: a handful of codes, whatever the input.
    both = c.select(F.col("cwe").alias("a")).join(c.select(F.col("cwe").alias("b")), F.col("a") <= F.col("b"))
    return both.select("a", "b", C.cwe_compatible(F.col("a"), F.col("b")).alias("compatible"))


@query(" SELECT fid, CASE WHEN file LIKE 'tests/%' THEN 'test' WHEN file LIKE './docs/%' THEN 'docs' WHEN file LIKE 'examples/%' THEN 'sample' ELSE 'production' END AS role, file LIKE 'tests/%' AS is_test, regexp_replace(file, '^(\\./|/)+', '') AS uri FROM f")
def file_roles(spark, sf_dir):
    file = F.col("file")
    return findings(spark, sf_dir).select("fid", C.file_role(file).alias("role"), C.is_test_path(file).alias("is_test"), C.report_uri(file).alias("uri"))


# Churn, health, lookups --------------------------------------------------------------------------


@query("WITH c AS (SELECT user_id, count(*) AS commits FROM events GROUP BY 1) SELECT user_id, CAST(commits AS BIGINT) AS commits, CAST(commits AS DOUBLE) / CAST((SELECT max(commits) FROM c) AS DOUBLE) AS churn FROM c")
def churn(spark, sf_dir):
    return health.normalised(_t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("commits")), "commits")


@query(", c AS (SELECT concat('root/', file) AS path, CAST(count(*) AS DOUBLE) AS n, min(ord) AS ord FROM f GROUP BY 1) SELECT fid, round(coalesce((SELECT n / (SELECT max(n) FROM c) FROM c WHERE c.path = concat('root/', f.file)), 0.0e0), 2) AS churn FROM f")
def churn_by_suffix(spark, sf_dir):
    f = findings(spark, sf_dir)
    log = f.select(F.col("ord"), F.concat(F.lit("root/"), F.col("file")).alias("line"))
    return health.churn_of(f, health.normalised(health.churn_counts(log), "commits")).select("fid", "churn")


@query(""" SELECT fid, round(least(1.0e0, CASE WHEN k * 20 > 1000 THEN 0.5e0 WHEN k * 20 > 600 THEN 0.35e0 WHEN k * 20 > 300 THEN 0.2e0 WHEN k * 20 > 150 THEN 0.1e0 ELSE 0.0e0 END
 + CASE WHEN user_id % 9 >= 7 THEN 0.3e0 WHEN user_id % 9 >= 4 THEN 0.15e0 ELSE 0.0e0 END + least(0.2e0, (fid % 7) * 0.05e0) + least(0.2e0, (fid % 5) * 0.05e0)), 2) AS penalty FROM f""")
def health_penalty(spark, sf_dir):
    rows = findings(spark, sf_dir).select("fid", (F.col("k") * 20).alias("loc"), (F.col("user_id") % 9).alias("max_nesting"), (F.col("fid") % 7).alias("bare_excepts"), (F.col("fid") % 5).alias("long_functions"))
    return health.health_penalty(rows).select("fid", "penalty")


@query(", sp AS (SELECT file, concat('fn', fid) AS name, line AS s, line + CAST(fid % 30 AS INT) AS e, ord FROM f WHERE event_type = 'view') SELECT f.fid AS pid, arg_min(name, (e - s) * 1e9 + sp.ord) AS name FROM f JOIN sp ON f.file = sp.file AND f.line BETWEEN s AND e GROUP BY 1")
def enclosing_function(spark, sf_dir):
    f = findings(spark, sf_dir)
    spans = f.where("event_type = 'view'").select("file", F.concat(F.lit("fn"), "fid").alias("name"), F.col("line").alias("start"), (F.col("line") + (F.col("fid") % 30).cast("int")).alias("end"), "ord")
    return graph.enclosing(f.select(F.col("fid").alias("pid"), "file", "line"), spans)


# Evaluation --------------------------------------------------------------------------------------


@query(", lab AS (SELECT file, line, min(verdict) AS verdict, cwe AS tail FROM f WHERE event_type = 'signup' AND cwe IS NOT NULL GROUP BY file, line, cwe), near AS (SELECT f.fid, abs(f.line - lab.line) AS gap, lab.verdict FROM f JOIN lab ON f.file = lab.file AND f.cwe = lab.tail AND abs(f.line - lab.line) <= 3) SELECT f.fid, v.verdict FROM f LEFT JOIN (SELECT fid, CASE WHEN min(gap) = 0 THEN max(verdict) FILTER (gap = 0) WHEN count(*) = 1 THEN max(verdict) END AS verdict FROM near GROUP BY fid) v ON f.fid = v.fid")
def label_lookup(spark, sf_dir):
    f = findings(spark, sf_dir)
    labels = f.where("event_type = 'signup' and cwe is not null").groupBy("file", "line", F.col("cwe").alias("tail")).agg(F.min("verdict").alias("verdict"))
    return evaluate.label_lookup(f.select("fid", "file", "line", F.col("cwe").alias("tail")), labels).select("fid", "verdict")


_R = "round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 4)"


@query(f" SELECT count(*) AS total, count_if(verdict = 'TP')::BIGINT AS tp, count_if(verdict = 'FP')::BIGINT AS fp, count_if(verdict = 'UNSURE')::BIGINT AS unsure, count_if(verdict IN ('TP', 'FP'))::BIGINT AS labelled, (count(*) - count_if(verdict IS NOT NULL))::BIGINT AS unlabelled, {_R.format(a=chr(99)+'ount_if(verdict = ' + chr(39) + 'TP' + chr(39) + ')', b='count_if(verdict IN (' + chr(39) + 'TP' + chr(39) + ', ' + chr(39) + 'FP' + chr(39) + '))')} AS precision, {_R.format(a='count_if(verdict IN (' + chr(39) + 'TP' + chr(39) + ', ' + chr(39) + 'FP' + chr(39) + '))', b='count(*)')} AS share FROM f")
def label_coverage(spark, sf_dir):
    return evaluate.coverage(findings(spark, sf_dir))


@query("WITH j AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)) SELECT source, CAST(count_if(quality = 1) AS BIGINT) AS tp, CAST(count_if(quality = 0) AS BIGINT) AS fp, round(CAST(count_if(quality = 1) AS DOUBLE) / count(*), 4) AS precision FROM j GROUP BY source")
def precision_by_source(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id")
    return evaluate.precision_by(rows.withColumn("verdict", F.when(F.col("quality") == 1, "TP").otherwise("FP")), "source")


@query(""", ex AS (SELECT CAST(fid AS INT) AS idx, file, line, cwe FROM f WHERE event_type = 'error') SELECT idx, CASE WHEN count(b.fid) = 0 THEN 'missed' WHEN bool_or(NOT coalesce(b.fp_likelihood = 'HIGH', false)) THEN 'found' ELSE 'found_but_hidden' END AS status,
 coalesce(list_sort(list(DISTINCT concat(b.file, ':', b.line)) FILTER (b.fid IS NOT NULL)), []) AS keys
 FROM ex LEFT JOIN f b ON ex.file = b.file AND abs(ex.line - b.line) <= 3 AND (ex.cwe IS NULL OR ex.cwe = b.cwe) GROUP BY idx""")
def expected_recall(spark, sf_dir):
    f = findings(spark, sf_dir)
    expected = f.where("event_type = 'error'").select(F.col("fid").cast("int").alias("idx"), "file", "line", F.lit(3).alias("tol"), F.array_compact(F.array("cwe")).alias("cwe"))
    found = f.select(F.concat("file", F.lit(":"), "line").alias("key"), "file", "line", "cwe", F.coalesce(F.col("fp_likelihood") == "HIGH", F.lit(False)).alias("hidden"))
    return evaluate.expected_recall(expected, found)


@query("""SELECT count_if(verdict = 'TP' AND h)::BIGINT AS wrongly_hidden, count_if(verdict = 'TP' AND m)::BIGINT AS wrongly_demoted,
 round(count_if(verdict = 'FP' AND h)::DOUBLE / nullif(count_if(verdict = 'FP'), 0), 4) AS caught_high, round(count_if(verdict = 'FP' AND (h OR m))::DOUBLE / nullif(count_if(verdict = 'FP'), 0), 4) AS caught_any,
 round(count_if(verdict = 'TP')::DOUBLE / nullif(count_if(verdict IN ('TP', 'FP')), 0), 4) AS precision_before, round(count_if(verdict = 'TP' AND NOT h)::DOUBLE / nullif(count_if(verdict IN ('TP', 'FP') AND NOT h), 0), 4) AS precision_after,
 count_if(verdict = 'TP' AND h) = 0 AS safe FROM (SELECT verdict, coalesce(fp_likelihood = 'HIGH', false) AS h, coalesce(fp_likelihood = 'MEDIUM', false) AS m FROM f)""")
def fp_filter_safety(spark, sf_dir):
    return evaluate.fp_safety(findings(spark, sf_dir).select("verdict", F.col("fp_likelihood").alias("fp")))


_REL = "WITH r AS (SELECT source, quality AS rel, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents JOIN labels USING (doc_id)), h AS (SELECT *, sum(rel) OVER (PARTITION BY source ORDER BY rn) AS hits FROM r) "


def _relevance(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(_t(spark, sf_dir, "labels"), "doc_id").select("source", "doc_id", "n_chars", F.col("quality").alias("rel"))


@query(_REL + "SELECT source, sum(CASE WHEN rn <= 5 THEN rel ELSE 0 END) / 5.0e0 AS precision_at_k FROM h GROUP BY source HAVING count(*) >= 5")
def precision_at_5(spark, sf_dir):
    return evaluate.precision_at(_relevance(spark, sf_dir), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query(_REL + "SELECT source, round(sum(CASE WHEN rel = 1 THEN CAST(hits AS DOUBLE) / rn END) / nullif(sum(rel), 0), 9) AS average_precision FROM h GROUP BY source")
def average_precision(spark, sf_dir):
    out = evaluate.average_precision(_relevance(spark, sf_dir), ["source"], [F.desc("n_chars"), F.col("doc_id")])
    return out.withColumn("average_precision", F.round("average_precision", 9))


@query("""WITH r AS (SELECT source, n_chars // 1000 AS s, quality AS rel FROM documents JOIN labels USING (doc_id)), t AS (SELECT source, s, count(*) AS m, sum(rel) AS r FROM r GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(m) OVER b, 0) AS n, coalesce(sum(r) OVER b, 0) AS h FROM t WINDOW b AS (PARTITION BY source ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, unnest(range(1, m + 1)) AS j FROM w WHERE r > 0)
SELECT q.source, round(x / nullif(q.t, 0), 9) AS expected_ap FROM (SELECT source, sum(rel) AS t FROM r GROUP BY 1) q LEFT JOIN (SELECT source, sum(CAST(r AS DOUBLE) / m * (h + 1 + (j - 1) * CASE WHEN m > 1 THEN (r - 1) / CAST(m - 1 AS DOUBLE) ELSE 0 END) / (n + j)) AS x FROM e GROUP BY 1) y ON q.source = y.source""")
def tie_averaged_precision(spark, sf_dir):
    rows = _relevance(spark, sf_dir).withColumn("s", F.expr("n_chars div 1000"))
    return evaluate.expected_average_precision(rows, ["source"], "s").withColumn("expected_ap", F.round("expected_ap", 9))


# Threat data and upgrades --------------------------------------------------------------------------

_VECTOR = "concat('CVSS:3.1/AV:', CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END, '/AC:', CASE WHEN p_partkey % 3 = 0 THEN 'L' ELSE 'H' END, '/PR:', CASE p_size % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/UI:', CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'R' END, '/S:U/C:', CASE p_partkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/I:', CASE p_size % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/A:', CASE p_partkey % 7 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END)"
_W = lambda x, pairs: "CASE " + x + " " + " ".join(f"WHEN {k} THEN {v}e0" for k, v in pairs[:-1]) + f" ELSE {pairs[-1][1]}e0 END"


@query(f"""WITH v AS (SELECT p_partkey, 1 - ((1 - {_W('p_partkey % 5', [(0, '0.0'), (1, '0.22'), (2, '0.56')])}) * (1 - {_W('p_size % 5', [(0, '0.0'), (1, '0.22'), (2, '0.56')])})) * (1 - {_W('p_partkey % 7', [(0, '0.0'), (1, '0.22'), (2, '0.56')])}) AS iss,
 8.22e0 * {_W('p_partkey % 4', [(0, '0.85'), (1, '0.62'), (2, '0.55'), (3, '0.2')])} * {_W('p_partkey % 3', [(0, '0.77'), (1, '0.44')])} * {_W('p_size % 3', [(0, '0.85'), (1, '0.62'), (2, '0.27')])} * {_W('p_size % 2', [(0, '0.85'), (1, '0.62')])} AS ease FROM part),
u AS (SELECT p_partkey, iss, CAST(round(least(6.42e0 * iss + ease, 10.0e0) * 100000) AS BIGINT) AS x FROM v)
SELECT p_partkey AS part, CASE WHEN iss <= 0 THEN 0.0e0 WHEN x % 10000 = 0 THEN x / 100000.0e0 ELSE (floor(x / 10000.0e0) + 1) / 10.0e0 END AS score FROM u""")
def cvss_score(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), C.cvss3(F.expr(_VECTOR)).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS u, p_partkey // 2 AS v FROM part WHERE p_size > 10), up AS (SELECT p_partkey AS node, p_partkey AS pos FROM part UNION SELECT node, v FROM up JOIN e ON pos = u)
SELECT node, min(pos) AS component FROM up WHERE node IN (SELECT u FROM e UNION SELECT v FROM e) GROUP BY node UNION SELECT DISTINCT v, v FROM e WHERE v NOT IN (SELECT p_partkey FROM part)""")
def alias_components(spark, sf_dir):
    p = _t(spark, sf_dir, "part").where("p_size > 10")
    return connected_components(p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst")))


@query(""", e AS (SELECT fid, unnest([concat('CVE-', fid % 300), concat('CVE-', fid % 170), 'GHSA-x']) AS cve FROM f), ep AS (SELECT concat('CVE-', p_partkey) AS cve, CAST(p_size AS DOUBLE) / 50 AS epss FROM part WHERE p_size > 30),
kv AS (SELECT concat('CVE-', s_suppkey) AS cve FROM supplier WHERE s_nationkey < 3) SELECT fid, max(ep.epss) AS epss, bool_or(kv.cve IS NOT NULL) AS kev FROM e LEFT JOIN ep USING (cve) LEFT JOIN kv USING (cve) GROUP BY fid""")
def exploit_data(spark, sf_dir):
    ids = F.array(F.concat(F.lit("CVE-"), F.col("fid") % 300), F.concat(F.lit("CVE-"), F.col("fid") % 170), F.lit("GHSA-x"))
    rows = flat(spark, sf_dir).select("fid", ids.alias("ids"))
    epss = _t(spark, sf_dir, "part").where("p_size > 30").select(F.concat(F.lit("CVE-"), "p_partkey").alias("cve"), (F.col("p_size") / 50.0).alias("epss"))
    kev = _t(spark, sf_dir, "supplier").where("s_nationkey < 3").select(F.concat(F.lit("CVE-"), "s_suppkey").alias("cve"))
    return threat.with_exploit_data(rows, "fid", "ids", epss, kev).select("fid", "epss", "kev")


@query("""WITH v AS (SELECT concat('req', p_partkey % 11, '.txt') AS file, CAST(p_partkey % 60 AS INT) AS line, concat('pkg-', p_partkey % 60) AS package, concat(p_partkey % 3, '.', p_partkey % 4, '.0') AS cur, p_partkey % 3 AS ca, p_partkey % 4 AS cb, concat('V', p_partkey) AS vid,
 CASE WHEN p_partkey % 6 <> 5 THEN p_partkey % 3 + p_size % 2 END AS a, p_size % 9 AS b, p_size % 13 AS c, CAST(p_size AS DOUBLE) AS risk FROM part),
g AS (SELECT file, line, package, cur AS current, ca, cb, max((a * 1000 + b) * 1000 + c) AS t, CAST(max(risk) AS DOUBLE) AS max_risk_score, coalesce(list_sort(list(DISTINCT vid) FILTER (a IS NOT NULL)), []) AS fixes, coalesce(list_sort(list(DISTINCT vid) FILTER (a IS NULL)), []) AS unfixed FROM v GROUP BY 1, 2, 3, 4, 5, 6)
SELECT file, line, package, current, concat(t // 1000000, '.', t // 1000 % 1000, '.', t % 1000) AS target, fixes, unfixed, max_risk_score, risk, CASE WHEN risk = 'major' THEN 'needs_review' ELSE 'upgrade' END AS bucket FROM
 (SELECT *, CASE WHEN t // 1000000 <> ca THEN 'major' WHEN t // 1000 % 1000 <> cb THEN 'minor' ELSE 'patch' END AS risk FROM g WHERE t IS NOT NULL)
UNION ALL SELECT file, line, package, current, NULL, [], unfixed, max_risk_score, NULL, 'no_fix' FROM g WHERE t IS NULL""")
def upgrade_plan(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(
        F.expr("concat('req', p_partkey % 11, '.txt')").alias("file"), F.expr("CAST(p_partkey % 60 AS INT)").alias("line"), F.expr("concat('Pkg_', p_partkey % 60)").alias("package"),
        F.expr("concat(p_partkey % 3, '.', p_partkey % 4, '.0')").alias("version"), F.expr("concat('V', p_partkey)").alias("vuln_id"),
        F.expr("CASE WHEN p_partkey % 6 <> 5 THEN concat(p_partkey % 3 + p_size % 2, '.', p_size % 9, '.', p_size % 13) END").alias("fixed_version"), F.col("p_size").cast("double").alias("risk_score"))
    return remediate.plan_upgrades(rows).select("file", "line", "package", "current", "target", "fixes", "unfixed", "max_risk_score", "risk", "bucket")


@query("WITH v AS (SELECT p_partkey, concat('pkg==', p_partkey % 3, '.', p_size, '  # ', p_brand) AS t FROM part) SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 1 THEN replace(t, concat('==', p_partkey % 3, '.'), '==9.9') END AS line FROM (SELECT p_partkey, t FROM v) WHERE false UNION ALL SELECT p_partkey, CASE WHEN p_size = 7 THEN concat('pkg==9.9  # ', p_brand) END FROM part")
def edited_pins(spark, sf_dir):
    text = F.expr("concat('pkg==1.', p_size, '  # ', p_brand)")
    edit = remediate.edit_pin(text, F.lit("PKG"), F.lit("1.7"), F.lit("9.9"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), edit["line"].alias("line"))


@query(""" , a AS (SELECT DISTINCT file, line FROM f WHERE event_type IN ('signup', 'click')), b AS (SELECT DISTINCT file, line FROM f WHERE event_type IN ('click', 'error')), t AS (SELECT DISTINCT file, line FROM f WHERE event_type = 'signup')
SELECT file, line, 'resolved' AS kind FROM t WHERE (file, line) NOT IN (SELECT file, line FROM b) UNION ALL SELECT file, line, 'remaining' FROM t WHERE (file, line) IN (SELECT file, line FROM b) UNION ALL SELECT file, line, 'introduced' FROM b WHERE (file, line) NOT IN (SELECT file, line FROM a)""")
def verified_upgrades(spark, sf_dir):
    f = findings(spark, sf_dir)
    return remediate.verify_upgrades(f.where("event_type = 'signup'"), f.where("event_type IN ('signup', 'click')"), f.where("event_type IN ('click', 'error')"), ["file", "line"])


@query(""", c AS (SELECT engine, file, CAST(count_if(event_type IN ('signup', 'click')) AS BIGINT) AS before, CAST(count_if(event_type IN ('click', 'error')) AS BIGINT) AS after, CAST(count_if(event_type = 'signup') AS BIGINT) AS fixed FROM f GROUP BY 1, 2)
SELECT *, CASE WHEN after > before THEN 'introduced' WHEN fixed > 0 AND after <= before - fixed THEN 'confirmed' WHEN fixed > 0 THEN 'still_there' ELSE 'unchanged' END AS status FROM c WHERE before + after + fixed > 0""")
def counted_changes(spark, sf_dir):
    f = findings(spark, sf_dir)
    return remediate.compare_counts(f.where("event_type IN ('signup', 'click')"), f.where("event_type IN ('click', 'error')"), f.where("event_type = 'signup'"), ["engine", "file"])


# Graph ---------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT p_partkey AS u, p_partkey // 2 AS v FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 2)"


def _edges(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey")
    two = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return two.unionByName(p.where("p_partkey % 4 = 0 and p_partkey > 2").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"))).distinct()


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT u AS start, v AS node, 1 AS hops FROM e UNION SELECT start, v, hops + 1 FROM r JOIN e ON node = u) SELECT start, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1, 2")
def reachable_nodes(spark, sf_dir):
    starts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return graph.distances(_edges(spark, sf_dir), starts).withColumn("hops", F.col("hops").cast("int"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node, [p_partkey] AS path FROM part UNION ALL SELECT start, v, list_append(path, v) FROM r JOIN e ON node = u), k AS (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS rn FROM r) SELECT start, node, path FROM k WHERE rn = 1")
def shortest_paths(spark, sf_dir):
    starts = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("start"))
    return graph.shortest_paths(_edges(spark, sf_dir), starts)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT v AS target, u AS node FROM e WHERE v > 0 UNION SELECT target, u FROM r JOIN e ON node = v) SELECT p_partkey AS target, CAST(count(DISTINCT r.node) FILTER (r.node % 7 <> 0) AS BIGINT) AS blast_radius FROM part LEFT JOIN r ON target = p_partkey GROUP BY 1")
def blast_radius(spark, sf_dir):
    nodes = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.lit("FUNCTION").alias("kind"), (F.col("p_partkey") % 7 == 0).alias("is_test"))
    e = _edges(spark, sf_dir).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return graph.blast_radius(e, nodes, nodes.select(F.col("node_id").alias("target")))


@query(""" SELECT fid, CASE WHEN engine = 'dependency' THEN CASE WHEN NOT g AND kn THEN 'DEAD' WHEN NOT g THEN 'UNKNOWN' WHEN fw IS NOT NULL THEN ex WHEN ts THEN 'TEST' ELSE 'INTNL' END
 WHEN engine = 'secrets' OR coalesce(cwe IN ('CWE-259', 'CWE-798'), false) THEN CASE WHEN tr THEN 'REPO' WHEN hi THEN 'HIST' ELSE 'NONE' END
 ELSE CASE WHEN NOT g THEN 'UNKNOWN' WHEN fw IS NOT NULL THEN ex WHEN ts THEN 'TEST' WHEN cl = 0 THEN 'DEAD' ELSE 'INTNL' END END AS exposure
FROM (SELECT *, k % 5 <> 0 AS g, k % 2 = 0 AS kn, CASE k % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'cli' WHEN 2 THEN 'worker' END AS fw, CASE k % 7 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'CLI' WHEN 2 THEN 'WORKER' END AS ex, user_id % 9 = 0 AS ts, k % 3 AS cl, k % 3 = 0 AS tr, k % 3 = 1 AS hi FROM f)""")
def exposure_cases(spark, sf_dir):
    e = F.expr
    case = graph.exposure_case(F.col("engine"), F.col("cwe"), e("k % 5 <> 0"), e("CASE k % 7 WHEN 0 THEN 'web' WHEN 1 THEN 'cli' WHEN 2 THEN 'worker' END"), e("user_id % 9 = 0"), F.lit(True), e("k % 3"), F.lit(False), e("k % 3 = 0"), e("k % 3 = 1"), e("k % 2 = 0"), F.lit(None).cast("boolean"))
    return findings(spark, sf_dir).select("fid", case["exposure"].alias("exposure"))


# Sets, scopes, reports -----------------------------------------------------------------------------


@query(" SELECT fid FROM f WHERE regexp_replace(file, '^.*/', '') IN ('f1.py', 'f2.py') AND file LIKE 'src/%' AND EXISTS (SELECT 1 FROM f g WHERE g.user_id % 3 = 0 AND g.file = f.file)")
def changed_scope(spark, sf_dir):
    f = findings(spark, sf_dir)
    changed = f.where("user_id % 3 = 0 and file like 'src/%' and (file like '%/f1.py' or file like '%/f2.py')").select(F.concat(F.lit("repo/"), "file").alias("path"))
    return sets.changed_scope(f, changed).select("fid")


@query(" SELECT fid, src, ord FROM (SELECT fid, 0 AS src, CAST(ord AS BIGINT) AS ord FROM f WHERE engine IN ('bandit', 'semgrep') UNION ALL SELECT fid, 1, CAST(ord + 1099511627776 AS BIGINT) FROM f WHERE engine NOT IN ('bandit', 'semgrep'))")
def engine_union(spark, sf_dir):
    f = findings(spark, sf_dir)
    return sets.union_in_order([f.where("engine IN ('bandit', 'semgrep')"), f.where("engine NOT IN ('bandit', 'semgrep')")]).select("fid", "src", "ord")


@query("""WITH RECURSIVE g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT list(source ORDER BY source DESC) AS names, list(n ORDER BY source DESC) AS sizes, list(greatest(1, CAST(round_even(50.0e0 * n / (SELECT sum(n) FROM g), 0) AS BIGINT)) ORDER BY source DESC) AS quota FROM g
 UNION ALL SELECT names, sizes, CASE WHEN list_sum(quota) > 50 THEN list_transform(quota, lambda x, k: CASE WHEN k = list_position(quota, list_max(quota)) THEN x - 1 ELSE x END)
  ELSE list_transform(quota, lambda x, k: CASE WHEN k = list_position(list_transform(sizes, lambda z, j: z - quota[j]), list_max(list_transform(sizes, lambda z, j: z - quota[j]))) THEN x + 1 ELSE x END) END FROM t WHERE list_sum(quota) <> 50),
q AS (SELECT unnest(names) AS source, unnest(quota) AS quota FROM t WHERE list_sum(quota) = 50),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) SELECT doc_id, source FROM r JOIN q USING (source) WHERE rn <= quota""")
def stratified_sample(spark, sf_dir):
    return sets.stratified_sample(_t(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source")


@query(" SELECT substr(coalesce(fp_reason, ''), 1, 90) AS reason, count(*) AS n FROM f WHERE fp_likelihood = 'HIGH' GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 5")
def hidden_reasons(spark, sf_dir):
    return fp.hidden_reasons(fp.hide(findings(spark, sf_dir))[1])


@query(" SELECT rule_id, arg_min(title, ord) AS title, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, coalesce(nullif(cwe, ''), concat(engine, '-', trim(regexp_replace(substr(title, 1, 32), '[^A-Za-z0-9_-]', '-', 'g'), '-'))) AS rule_id FROM f) GROUP BY 1")
def report_rules(spark, sf_dir):
    return report.rules(findings(spark, sf_dir)).select("rule_id", "title", "n")


@query(" SELECT fid, CASE WHEN severity >= 7 THEN 'error' WHEN severity >= 4 THEN 'warning' ELSE 'note' END AS level, regexp_replace(file, '^(\\./|/)+', '') AS uri, suppressed FROM f")
def report_results(spark, sf_dir):
    return report.results(findings(spark, sf_dir)).select("fid", "level", "uri", "suppressed")


@query(""" SELECT fid, array_to_string(list_filter([CASE WHEN blast_radius <> 0 THEN 'blast_radius' END, CASE WHEN churn <> 0 THEN 'churn' END, CASE WHEN code_health_penalty <> 0 THEN 'code_health_penalty' END, CASE WHEN cwe IS NOT NULL THEN 'cwe' END, 'description', 'engine', 'evidence',
 CASE WHEN exploitability <> 0 THEN 'exploitability' END, CASE WHEN exposure IS NOT NULL THEN 'exposure' END, CASE WHEN kev OR suppressed THEN 'extra' END, 'file', CASE WHEN fp_likelihood IS NOT NULL THEN 'fp_likelihood' END, CASE WHEN fp_reason IS NOT NULL THEN 'fp_reason' END,
 'line', CASE WHEN reachable IS NOT NULL THEN 'reachable' END, 'severity', 'title'], lambda x: x IS NOT NULL), ',') AS members FROM f""")
def sparse_json(spark, sf_dir):
    f = findings(spark, sf_dir)
    # Only what is set, so that some rows have no extra member at all.
    bare = F.struct(*[(F.when(F.col(f"extra.{x.name}"), True) if x.name in ("kev", "suppressed") else F.lit(None).cast(x.dataType)).alias(x.name) for x in f.schema["extra"].dataType.fields])
    rows = f.withColumn("extra", bare).select(*[x.name for x in FINDING.fields])
    return report.sparse_json(rows).select("fid", F.array_join(F.array_sort(F.json_object_keys("json")), ",").alias("members"))


@query("WITH x AS (SELECT doc_id, regexp_replace(text, '(token = \"[0-9a-f]{2})[0-9a-f]{36}([0-9a-f]{2}\")', '\\1****\\2', 'g') AS masked FROM documents) SELECT doc_id, md5(masked) AS digest FROM x")
def redacted_text(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))
    masked = C.replace_all(F.col("text"), F.array_distinct(found))
    return docs.select("doc_id", F.md5(F.when(F.size(found) > 0, masked).otherwise(F.col("text"))).alias("digest"))


_MORE = "CASE event_type WHEN 'view' THEN ' on Windows' WHEN 'click' THEN ' compute_etag' WHEN 'error' THEN ' in extract_zipped_paths' WHEN 'purchase' THEN ' ASGI request' ELSE ' with Proxy-Authorization' END"


@query(""" SELECT fid, CASE WHEN kev THEN NULL ELSE coalesce(CASE WHEN why IS NOT NULL THEN 'HIGH' END, fp_likelihood) END AS fp_likelihood, CASE WHEN kev THEN NULL ELSE coalesce(why, fp_reason) END AS fp_reason FROM (SELECT *,
 CASE WHEN (file LIKE 'tests/%' OR coalesce(exposure = 'TEST', false)) AND (coalesce(cwe = 'CWE-798', false) OR engine = 'secrets') THEN 'Mock test credential in test suite'
 WHEN coalesce(cwe = 'CWE-328', false) AND event_type = 'click' THEN 'RFC 7232 AWS S3 ETag compliance (non-cryptographic checksum)'
 WHEN engine = 'dependency' AND event_type = 'view' THEN 'Vulnerability only affects Windows environments (Linux deployment detected)'
 WHEN engine = 'dependency' AND event_type = 'purchase' THEN 'Vulnerability only affects ASGI request handling (project runs on WSGI)'
 WHEN engine = 'dependency' AND event_type = 'error' THEN 'Vulnerability only applies when package runs from a zip archive (extract_zipped_paths)'
 WHEN engine = 'dependency' AND event_type = 'signup' THEN 'Vulnerability requires proxy configuration, but no proxy is configured' END AS why FROM f)""")
def classified(spark, sf_dir):
    env = spark.range(1).select(F.lit(True).alias("is_linux"), F.lit(True).alias("is_wsgi_only"), F.lit(False).alias("has_proxy"))
    rows = findings(spark, sf_dir).withColumn("description", F.concat("description", F.expr(_MORE)))
    return fp.classify(rows, env).select("fid", "fp_likelihood", "fp_reason")


_BASE_OF = "CASE substr(title, 1, 4) " + " ".join(f"WHEN '{k}' THEN {v[1]}e0" for k, v in T.RULES.items() if k < "B116") + " END"
_LEVEL = "CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
_CONF = "CASE user_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f""" SELECT fid, round(least(greatest(coalesce({_BASE_OF}, CASE {_LEVEL} WHEN 'HIGH' THEN 8.0e0 WHEN 'MEDIUM' THEN 5.0e0 ELSE 2.5e0 END) + CASE {_CONF} WHEN 'HIGH' THEN 0.5e0 WHEN 'LOW' THEN -0.5e0 ELSE 0.0e0 END, 1.0e0), 10.0e0), 1) AS severity FROM f""")
def scanner_severity(spark, sf_dir):
    # Titles start with a test id: some have a calibration, of others the stated level counts.
    return findings(spark, sf_dir).select("fid", C.scanner_severity(F.lower(F.expr(_LEVEL)), F.expr(_CONF), F.lower(F.substring("title", 1, 4))).alias("severity"))


_Q = lambda p: "'" + p.replace("'", "''") + "'"
_FORMATS = " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule, CAST(NULL AS VARCHAR) AS variable, unnest(regexp_extract_all(t, {_Q(p)})) AS v, true AS is_provider_token FROM l" for r, p in secrets.FORMATS.items())
_NO_FORMAT = " AND ".join(f"NOT regexp_matches(v, {_Q(p)})" for p in secrets.FORMATS.values())


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line FROM documents),
a AS (SELECT doc_id, line, 'assigned-secret' AS rule, regexp_extract(m, {_Q(secrets.ASSIGNED)}, 1) AS variable, concat(regexp_extract(m, {_Q(secrets.ASSIGNED)}, 2), regexp_extract(m, {_Q(secrets.ASSIGNED)}, 3)) AS v, false AS is_provider_token
 FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, {_Q(secrets.ASSIGNED)})) AS m FROM l)),
u AS (SELECT *, round(list_aggregate(string_split(v, ''), 'entropy'), 4) AS entropy FROM (SELECT * FROM a WHERE {_NO_FORMAT} AND NOT regexp_matches(v, {_Q(C.PLACEHOLDER)}) UNION ALL {_FORMATS}))
SELECT doc_id, line, rule, variable, CASE WHEN length(v) <= 8 THEN '****' ELSE concat(left(v, 2), '****', right(v, 2)) END AS masked, entropy, is_provider_token FROM u WHERE is_provider_token OR entropy >= {secrets.LEAST_ENTROPY}""")
def secret_rows(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return secrets.detect(lines).select("doc_id", "line", "rule", "variable", "masked", "entropy", "is_provider_token")


@query(""" SELECT rule_id, arg_min(title, ord) AS title, arg_min(concat(title, chr(10), chr(10), 'Engine: ', engine, chr(10), 'Severity: ', printf('%.1f', severity), ' / 10.0', chr(10), 'Risk Score: 0.00 / 100.0', chr(10), 'CWE: ', coalesce(cwe, 'N/A'), chr(10), 'Exposure: ', coalesce(exposure, 'N/A'),
 chr(10), chr(10), 'Remediation:', chr(10), 'Review the affected code and apply standard security mitigations.', chr(10), chr(10), 'Details:', chr(10), description), ord) AS text
 FROM (SELECT *, coalesce(nullif(cwe, ''), concat(engine, '-', trim(regexp_replace(substr(title, 1, 32), '[^A-Za-z0-9_-]', '-', 'g'), '-'))) AS rule_id FROM f) GROUP BY 1""")
def rule_help(spark, sf_dir):
    return texts.rule_help(findings(spark, sf_dir)).select("rule_id", F.substring_index("text", "\n", 1).alias("title"), "text")


@query(""" SELECT fid, coalesce(exposure, CASE WHEN reachable THEN 'YES' WHEN NOT reachable THEN 'NO' ELSE '?' END) AS reach, CASE WHEN length(concat(file, ':', line)) > 28 THEN concat('...', right(concat(file, ':', line), 25)) ELSE concat(file, ':', line) END AS location,
 concat(CASE WHEN fp_likelihood = 'HIGH' THEN '[FP?] ' ELSE '' END, title) AS title FROM f""")
def console_rows(spark, sf_dir):
    return texts.table_rows(findings(spark, sf_dir)).select("fid", "reach", "location", "title")


@query(""", k AS (SELECT concat(engine, ':', title) AS key, min(file) AS file FROM f GROUP BY 1), v AS (SELECT concat(engine, ':', title) AS key, coalesce(max(verdict), '') AS verdict FROM f WHERE title LIKE 'B10%' GROUP BY 1 UNION ALL SELECT 'gone', 'FP')
 SELECT key, CAST(CASE WHEN k.key IS NULL THEN 3 WHEN coalesce(verdict, '') <> '' THEN 2 ELSE 1 END AS INT) AS part, coalesce(verdict, '') AS verdict FROM k FULL JOIN v USING (key)""")
def label_entries(spark, sf_dir):
    f = findings(spark, sf_dir).withColumn("key", F.concat("engine", F.lit(":"), "title"))
    labels = f.where("title LIKE 'B10%'").groupBy("key").agg(F.coalesce(F.max("verdict"), F.lit("")).alias("verdict")).withColumn("note", F.lit(""))
    labels = labels.unionByName(spark.range(1).select(F.lit("gone").alias("key"), F.lit("FP").alias("verdict"), F.lit("").alias("note")))
    return texts.label_template(f, labels).where("part > 0").select("key", "part", F.regexp_extract("text", '\\{verdict: "([A-Z]*)"', 1).alias("verdict"))
