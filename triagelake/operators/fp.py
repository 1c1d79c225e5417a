"""False-positive rules as one ordered case; protected findings are cleared last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import is_test_path, matches_glob, posix, strings

#: Words by which random numbers are told apart, and checksum and schema words.
SECURITY_WORDS = r"(?i)(?:\b|_)(token|secret|session|csrf|auth|nonce|salt|jwt|api_key|apikey|otp|pin|password|passwd|reset|verify|code|key)(?:\b|_)"
REFERENCE_WORDS = r"(?i)(?:\b|_)(id|ref|ref_id|payment_id|invoice_id|order_id|tx_id|display_id|tracking|suffix|filename)(?:\b|_)"
ETAG_WORDS = r"(?i)\b(etag|compute_etag|calculate_etag)\b"
SENSITIVE_WORDS = "password passwd pwd passphrase passcode pass secret token credential credentials otp session auth authorization ssn pin".split()
SENSITIVE_COMPOUNDS = r"apikey|privatekey|secretkey|accesskey|authkey|signingkey|encryptionkey|sessionid"
SQL_KEYWORDS = "select insert update delete alter create drop pragma from where table into values set join".split()


def sensitive_identifier(name: Column) -> Column:
    """Whether the words of a camelCase or snake_case name are those of a secret."""
    words = F.split(F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^a-z0-9]+")
    return F.arrays_overlap(words, strings(SENSITIVE_WORDS)) | F.array_join(words, "").rlike(SENSITIVE_COMPOUNDS)


def has_sql_keyword(text: Column) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), strings(SQL_KEYWORDS))


def provider_secret(title: Column, text: Column, extra: Column) -> Column:
    prefix = F.exists(strings(T.PROVIDER_PREFIXES), lambda p: F.contains(text, p))
    words = F.exists(strings(T.PROVIDER_TITLES), lambda p: F.contains(F.lower(title), p) | F.contains(F.lower(F.coalesce(extra["check_id"], F.lit(""))), p))
    return prefix | words | F.coalesce(extra["is_provider_token"], F.lit(False)) | F.coalesce(extra["provider_prefix"] != "", F.lit(False))


def environment(files: DataFrame) -> DataFrame:
    """One row of booleans from (path, text): is_linux, is_wsgi_only, has_proxy.

    The first two come from files at the root, the third from settings in any folder.
    """
    path = F.regexp_replace(posix(F.col("path")), r"^(\./)+", "")
    text = F.lower(F.coalesce("text", F.lit("")))
    holds = lambda words: F.exists(strings(words), lambda w: F.contains(text, w))
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    serves = holds(["gunicorn"]) & holds(["wsgi"]) & ~holds(["uvicorn"])
    return files.agg(
        any_of(((path == "Dockerfile") & holds(T.LINUX_IMAGES)) | ((path == "Procfile") & holds(["gunicorn", "uwsgi"])) | (path == "docker-compose.yml"), "is_linux"),
        any_of(path.isin("Dockerfile", "Procfile") & serves, "is_wsgi_only"),
        any_of(F.element_at(F.split(path, "/"), -1).isin(*T.SETTINGS_FILES) & holds(T.PROXY_SETTINGS), "has_proxy"),
    )


def classify(findings: DataFrame, env: DataFrame, training_paths: tuple[str, ...] = (), sql_safe: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """Fill fp_likelihood, fp_reason and their extra members by the first rule that holds.

    ``env``: the one row of :func:`environment`.  ``sql_safe``: fid of findings
    whose interpolated parts are all constants, ``hashes``: (fid, hash_sensitive),
    both from the source analysis; without the latter the evidence's names decide.
    """
    e, file = F.col("extra"), F.regexp_replace(posix(F.coalesce("file", F.lit(""))), r"^(\./)+", "")
    text = F.concat_ws(" ", "title", "description", "evidence")
    low = F.lower(text)
    training = F.lit(False)
    for p in training_paths:
        training = training | matches_glob(file, p)
    credential = F.coalesce(F.col("cwe").isin("CWE-259", "CWE-798"), F.lit(False)) | (F.col("engine") == "secrets")
    tested = (is_test_path(file) | F.coalesce(F.col("exposure") == "TEST", F.lit(False))) & credential & ~provider_secret(F.col("title"), F.coalesce("evidence", F.lit("")), e)
    weak_hash = F.coalesce(F.col("cwe").isin("CWE-327", "CWE-328"), F.lit(False)) | F.contains("title", F.lit("B324"))
    etag = weak_hash & text.rlike(ETAG_WORDS)
    sensitive = F.exists(F.regexp_extract_all(F.coalesce("evidence", F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), sensitive_identifier)
    sensitive = F.coalesce("_sensitive", sensitive)
    sql = F.coalesce(F.col("cwe") == "CWE-89", F.lit(False)) | F.contains("title", F.lit("B608")) | F.contains(F.lower(F.coalesce(e["check_id"], F.lit(""))), F.lit("sql"))
    ddl = F.coalesce("evidence", F.lit("")).rlike(r"(?i)\b(ALTER|CREATE|DROP)\s+TABLE\b|\bPRAGMA\b")
    dependency = F.col("engine") == "dependency"
    some = lambda words: F.exists(strings(words), lambda w: F.contains(low, w))
    rows = findings.crossJoin(F.broadcast(env.limit(1)))  # one row
    rows = rows.join(sql_safe.select("fid").distinct().withColumn("_safe", F.lit(True)), "fid", "left") if sql_safe is not None else rows.withColumn("_safe", F.lit(False))
    rows = rows.join(hashes.select("fid", F.col("hash_sensitive").alias("_sensitive")), "fid", "left") if hashes is not None else rows.withColumn("_sensitive", F.lit(None).cast("boolean"))
    case = lambda level, reason: F.struct(F.lit(level).alias("level"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    prng = F.coalesce(F.col("cwe") == "CWE-330", F.lit(False)) | F.contains("title", F.lit("B311"))
    is_ref = prng & ~text.rlike(SECURITY_WORDS) & (text.rlike(REFERENCE_WORDS) | text.rlike(r"['\"][A-Z]+-['\"]"))
    asgi = F.contains(low, F.lit("sgi requests with a missing or understated")) | (F.contains(low, F.lit("asgi")) & F.contains(low, F.lit("request")))
    found = (
        F.when(training, case("HIGH", "Intent classified as training/example code (declared with --training-path)"))
        .when(tested, case("HIGH", "Mock test credential in test suite"))
        .when(etag & ~sensitive, case("HIGH", "RFC 7232 AWS S3 ETag compliance (non-cryptographic checksum)"))
        .when(sql & F.coalesce("_safe", F.lit(False)), case("HIGH", F.when(ddl, "DDL schema migration with static column definitions").otherwise("Dynamic identifier whitelisted from internal constant/enum")))
        .when(dependency & F.col("is_linux") & some(T.WINDOWS_ONLY), case("HIGH", "Vulnerability only affects Windows environments (Linux deployment detected)"))
        .when(dependency & F.col("is_wsgi_only") & asgi, case("HIGH", "Vulnerability only affects ASGI request handling (project runs on WSGI)"))
        .when(dependency & F.contains(low, F.lit("extract_zipped_paths")), case("HIGH", "Vulnerability only applies when package runs from a zip archive (extract_zipped_paths)"))
        .when(dependency & ~F.col("has_proxy") & some(T.PROXY_ONLY), case("HIGH", "Vulnerability requires proxy configuration, but no proxy is configured"))
    )
    protected = F.coalesce(e["kev"], F.lit(False)) | ((F.col("engine") == "secrets") & F.coalesce(e["is_provider_token"], F.lit(False)))
    level = F.when(~protected, F.coalesce(found["level"], F.col("fp_likelihood")))
    reason = F.when(~protected, F.coalesce(found["reason"], F.col("fp_reason")))
    extra = e.withField("fp_likelihood", level).withField("fp_reason", reason).withField("is_ref_id", F.when(prng, is_ref).otherwise(e["is_ref_id"]))
    extra = extra.withField("damping_multiplier", F.when(training & ~protected, 0.1).otherwise(e["damping_multiplier"]))
    title = F.when(is_ref & ~F.startswith("title", F.lit("[REF-ID]")), F.concat(F.lit("[REF-ID] "), F.col("title"))).otherwise(F.col("title"))
    done = rows.withColumns({"_level": level, "_reason": reason, "_extra": extra, "_title": title})
    keep = [F.col({"fp_likelihood": "_level", "fp_reason": "_reason", "extra": "_extra", "title": "_title"}.get(c, c)).alias(c) for c in findings.columns]
    return done.select(*keep)


def hide(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to show, and rows judged HIGH."""
    high = F.coalesce(F.col("fp_likelihood"), F.col("extra.fp_likelihood")) == "HIGH"
    return findings.where(~F.coalesce(high, F.lit(False))), findings.where(F.coalesce(high, F.lit(False)))


def hidden_reasons(hidden: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent reasons, by their first 90 characters; ties in order of first sight."""
    reason = F.substring(F.coalesce("fp_reason", "extra.fp_reason", F.lit("")), 1, 90)
    return hidden.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(k).drop("first")
