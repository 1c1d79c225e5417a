"""Scalar functions on findings, as column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from . import tables as T


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a small constant map, null for other keys."""
    return F.element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items())), key)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Null where ``whole`` is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


# Weaknesses ------------------------------------------------------------------------------------


def cwe(raw: Column, test_id: Column | None = None) -> Column:
    """Canonical CWE-<n>: by the scanner's test id, else from the text, else from plain digits."""
    text = F.trim(raw)
    number = F.regexp_extract(text, r"(?i)CWE-([0-9]+)", 1)
    out = F.when(number != "", F.concat(F.lit("CWE-"), number)).when(text.rlike(r"^[0-9]+$"), F.concat(F.lit("CWE-"), text))
    return out if test_id is None else F.coalesce(lookup({k: v[0] for k, v in T.RULES.items()}, F.upper(test_id)), out)


def cwe_families(code: Column) -> Column:
    """The numbers of the families that a canonical CWE is in."""
    return lookup_array({c: k for k, family in enumerate(T.CWE_FAMILIES) for c in family}, code)


def lookup_array(values: Mapping[str, int], key: Column) -> Column:
    return F.array_compact(F.array(lookup(values, key)))


def cwe_compatible(a: Column, b: Column) -> Column:
    """Equal after normalising, or in one family; never where either is unknown."""
    x, y = cwe(a), cwe(b)
    return F.coalesce((x == y) | F.arrays_overlap(cwe_families(x), cwe_families(y)), F.lit(False))


def keywords(text: Column) -> Column:
    """The class keywords that a text holds as whole words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(T.CLASS_KEYWORDS) + r")\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


# Paths -----------------------------------------------------------------------------------------


def posix(path: Column) -> Column:
    return F.trim(F.translate(path, "\\", "/"))


def dedup_path(path: Column) -> Column:
    """Without any leading ./ and /."""
    return F.regexp_replace(posix(path), r"^(\./|/)+", "")


def label_path(path: Column) -> Column:
    return F.regexp_replace(posix(path), r"^(\./)+", "")


def report_uri(path: Column, repo: str | None = None) -> Column:
    """Relative to the repository, without ./ and drive letters; '.' where nothing is left."""
    p = posix(F.coalesce(path, F.lit("")))
    if repo:
        start = repo.replace("\\", "/").rstrip("/") + "/"
        p = F.when(F.startswith(p, F.lit(start)), F.substring(p, len(start) + 1, 2**31 - 1)).otherwise(p)
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./|/)+", ""), r"^[a-zA-Z]:/", "")
    return F.when(p == "", F.lit(".")).otherwise(p)


def _parts(path: Column) -> tuple[Column, Column]:
    p = F.split(F.lower(posix(path)), "/")
    return F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.element_at(p, -1)


def is_test_path(path: Column) -> Column:
    parts, base = F.split(F.lower(posix(path)), "/"), _parts(path)[1]
    return F.arrays_overlap(parts, strings(["tests", "test", "testing"])) | F.startswith(base, F.lit("test_")) | F.endswith(base, F.lit("_test.py"))


def file_role(path: Column) -> Column:
    """test, docs, sample or production, in that order."""
    dirs, base = _parts(path)
    test = F.arrays_overlap(dirs, strings(T.TEST_DIRS)) | base.rlike(r"^(test_|mock_)|(_test\.py|_test|_mock\.py)$|^conftest\.py$")
    sample = F.arrays_overlap(dirs, strings(T.SAMPLE_DIRS)) | base.rlike(r"^(example_|sample_|demo_)")
    return F.when(test, "test").when(F.arrays_overlap(dirs, strings(T.DOC_DIRS)), "docs").when(sample, "sample").otherwise("production")


def is_dev_manifest(path: Column) -> Column:
    p = F.lower(posix(F.coalesce(path, F.lit(""))))
    base = F.element_at(F.split(p, "/"), -1)
    return base.rlike(r"-dev|_dev|\.dev|dev-|dev_|test|demo|doc") | p.rlike(r"tests/|test/|dockerized_labs/|docs/|examples/")


def same_path(a: Column, b: Column) -> Column:
    """Equal, or one ends in the other at a folder's boundary."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def matches_glob(path: Column, pattern: str) -> Column:
    """Equal to the pattern, below it, or matching it (or pattern/*) as a shell glob."""
    import fnmatch

    p = pattern.rstrip("/")
    regex = [fnmatch.translate(x).replace(r"(?s:", "(?s)").removesuffix(")\\z").removesuffix(r")\Z") + "$" for x in (p, p + "/*")]
    return (path == p) | F.startswith(path, F.lit(p + "/")) | path.rlike("^" + regex[0].removeprefix("^")) | path.rlike("^" + regex[1].removeprefix("^"))


# Names, identifiers, text ------------------------------------------------------------------------


def package_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def rule_id_valid(token: Column) -> Column:
    """Whether a word has the shape of a rule or advisory id, not of a file or a version."""
    low = F.lower(token)
    file = low.rlike(r"\.(py|js|ts|jsx|tsx|json|yaml|yml|go|rb|md|txt|sh)$")
    version = low.rlike(r"^v?[0-9]+(\.[0-9]+)+$")
    known = low.rlike(r"^(cwe-[0-9]+|b[0-9]{3}|cve-[0-9]{4}-[0-9]+|ghsa-[a-z0-9-]+)$") | low.rlike(r"^(scip|bandit|semgrep|rules)\.")
    return F.when(file | version, F.lit(False)).otherwise(known | token.rlike(r"^[a-zA-Z0-9_-]+(\.[a-zA-Z0-9_-]+){2,}$"))


def band(severity: Column) -> Column:
    return F.when(severity >= 9, "critical").when(severity >= 7, "high").when(severity >= 4, "medium").otherwise("low")


def report_level(severity: Column) -> Column:
    return F.when(severity >= 7, "error").when(severity >= 4, "warning").otherwise("note")


def verdict(raw: Column) -> Column:
    """TP, FP or UNSURE; blank is null; anything else is an error."""
    v = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(v == "", F.lit(None).cast("string")).when(v.isin("TP", "FP", "UNSURE"), v).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), v)).cast("string"))


def advisory_id(vuln_id: Column, title: Column) -> Column:
    found = F.regexp_extract(title, r"(?i)\b(CVE-[0-9]{4}-[0-9]+|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}|PYSEC-[0-9]{4}-[0-9]+)\b", 1)
    return F.coalesce(F.upper(F.nullif(vuln_id, F.lit(""))), F.upper(F.nullif(found, F.lit(""))))


def finding_key(file: Column, line: Column, code: Column, advisory: Column) -> Column:
    """file:line:CWE, with #advisory where there is one."""
    key = F.concat_ws(":", label_path(file), F.coalesce(line.cast("string"), F.lit("0")), F.coalesce(cwe(code), F.lit("none")))
    return F.concat(key, F.coalesce(F.concat(F.lit("#"), advisory), F.lit("")))


def env_name(variable: Column, default: str = "APP_SECRET") -> Column:
    name = F.upper(F.regexp_replace(F.regexp_replace(variable, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


# Scanner severities ----------------------------------------------------------------------------


def scanner_severity(level: Column, confidence: Column, test_id: Column) -> Column:
    base = F.coalesce(lookup({k: v[1] for k, v in T.RULES.items()}, F.upper(test_id)), lookup(T.LEVEL_SEVERITY, F.upper(level)), F.lit(5.0))
    return F.round(clamp(base + F.coalesce(lookup(T.CONFIDENCE_STEP, F.upper(confidence)), F.lit(0.0)), 1.0, 10.0), 1)


def scanner_exploitability(level: Column, confidence: Column, test_id: Column) -> Column:
    base = F.coalesce(lookup({k: v[2] for k, v in T.RULES.items()}, F.upper(test_id)), lookup(T.LEVEL_EXPLOIT, F.upper(level)), F.lit(0.3))
    return F.round(clamp(base * F.coalesce(lookup(T.CONFIDENCE_FACTOR, F.upper(confidence)), F.lit(0.7)), 0.05, 1.0), 2)


def cvss3(vector: Column) -> Column:
    """The base score of a CVSS v3 vector; null for other versions and incomplete vectors."""
    get = lambda m, k: F.element_at(m, F.lit(k))

    def terms(m: Column) -> Column:
        changed = get(m, "S") == "C"
        iss = 1 - (1 - lookup(T.CVSS_CIA, get(m, "C"))) * (1 - lookup(T.CVSS_CIA, get(m, "I"))) * (1 - lookup(T.CVSS_CIA, get(m, "A")))
        pr = F.when(changed, lookup(T.CVSS_PR_CHANGED, get(m, "PR"))).otherwise(lookup(T.CVSS_PR, get(m, "PR")))
        ease = 8.22 * lookup(T.CVSS_AV, get(m, "AV")) * lookup(T.CVSS_AC, get(m, "AC")) * pr * lookup(T.CVSS_UI, get(m, "UI"))
        return F.struct(changed.alias("changed"), iss.alias("iss"), ease.alias("ease"))

    def score(t: Column) -> Column:
        iss, changed = t["iss"], t["changed"]
        impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
        total = lambda i: F.when(i <= 0, F.lit(0.0)).otherwise(up(F.round(F.least((i + t["ease"]) * F.when(changed, 1.08).otherwise(1.0), F.lit(10.0)) * 100000).cast("bigint")))
        up = lambda x: let(x, lambda u: F.when(u % 10000 == 0, u / 100000.0).otherwise((F.floor(u / 10000.0) + 1) / 10.0))
        return F.when(iss.isNotNull() & t["ease"].isNotNull() & changed.isNotNull(), let(impact, total))

    scored = let(F.str_to_map(F.trim(vector), F.lit("/"), F.lit(":")), lambda m: let(terms(m), score))
    return F.when(F.startswith(F.trim(vector), F.lit("CVSS:3")), scored)


# Versions --------------------------------------------------------------------------------------


def version_key(version: Column) -> Column:
    """A struct that orders versions: epoch, release numbers, then pre < final < post and dev below; null if it is none.

    Releases are compared number by number, however many they have; zeros at the end don't count.

    Covers the public version scheme but for local parts, which are ignored.
    """
    v = F.regexp_replace(F.lower(F.trim(version)), r"^v", "")
    shape = r"^(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(a|b|c|rc|alpha|beta|pre|preview)[-_.]?([0-9]*))?(?:(?:-([0-9]+))|(?:[-_.]?(post|rev|r)[-_.]?([0-9]*)))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+.*)?$"
    g = lambda k: F.regexp_extract(v, shape, k)
    num = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    release = F.transform(F.split(g(2), r"\."), lambda p: num(p))
    # The last place of a number that isn't 0.
    used = F.aggregate(F.sequence(F.lit(1), F.size(release)), F.lit(0), lambda n, k: F.when(F.get(release, k - 1) != 0, k).otherwise(n))
    pre, has_post, dev = g(3), (g(5) != "") | (g(6) != ""), g(8) != ""
    rank = F.when(pre.isin("a", "alpha"), 1).when(pre.isin("b", "beta"), 2).when(pre != "", 3).when(dev & ~has_post, 0).otherwise(4).cast("bigint")
    post = F.when(has_post, num(F.concat(g(5), g(7))) + 1).otherwise(F.lit(0)).cast("bigint")
    before = F.when(dev, num(g(9))).otherwise(F.lit(2**40)).cast("bigint")
    key = F.struct(num(g(1)).alias("epoch"), F.slice(release, F.lit(1), used).alias("release"), rank.alias("rank"), num(g(4)).alias("pre"), post.alias("post"), before.alias("dev"))
    return F.when(v.rlike(shape), key)


def jump(current: Column, target: Column) -> Column:
    """major, minor or patch; calendar versions have no major jumps; what can't be compared is major."""
    c, t = version_key(current), version_key(target)
    at = lambda k, i: F.coalesce(F.get(k["release"], i - 1), F.lit(0))
    calendar = (at(c, 1) >= 1000) | (at(t, 1) >= 1000)
    moved = (at(c, 1) != at(t, 1)) | (at(c, 2) != at(t, 2))
    return (
        F.when(c.isNull() | t.isNull(), "major")
        .when(calendar, F.when(moved, "minor").otherwise("patch"))
        .when(at(c, 1) != at(t, 1), "major")
        .when(at(c, 2) != at(t, 2), "minor")
        .otherwise("patch")
    )


def nearest_fixed(fixed: Column, current: Column) -> Column:
    """The least of the fixed versions above the current one, by (key, text)."""
    now = version_key(current)
    keyed = F.transform(fixed, lambda f: F.struct(version_key(f).alias("k"), f.alias("v")))
    return F.array_min(F.filter(keyed, lambda s: s["k"].isNotNull() & (s["k"] > now)))["v"]


# Evidence and fingerprints -------------------------------------------------------------------


def clean_evidence(engine: Column, evidence: Column, line_range: Column, line: Column) -> Column:
    """The flagged lines without numbers and white space, 200 characters at most."""
    text = F.coalesce(evidence, F.lit(""))
    lines = F.split(text, r"\r\n|\r|\n")
    numbered = r"^\s*([0-9]+)\s+(.*)$"
    flagged = F.when(F.size(F.coalesce(line_range, F.array().cast("array<int>"))) > 0, line_range).when(line.isNotNull() & (line != 0), F.array(line)).otherwise(F.array().cast("array<int>"))
    stays = F.filter(lines, lambda x: ~x.rlike(numbered) | (F.size(flagged) == 0) | F.array_contains(flagged, F.regexp_extract(x, numbered, 1).try_cast("int")))
    bare = lambda a: F.array_join(F.transform(a, lambda x: F.regexp_replace(x, r"^\s*[0-9]+\s+", "")), "")
    some = F.exists(lines, lambda x: x.rlike(numbered)) & (F.size(F.filter(stays, lambda x: x != "")) > 0)
    out = F.when(engine == "bandit", F.when(some, bare(stays)).otherwise(bare(lines))).otherwise(text)
    return F.substring(F.regexp_replace(out, r"\s+", ""), 1, 200)


def rule_key(engine: Column, title: Column, code: Column, extra: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    dependency = F.coalesce(full(extra["vuln_id"]), title)
    plain = F.coalesce(full(extra["test_id"]), full(extra["check_id"]), full(code), title)
    return F.lower(F.trim(F.when((engine == "dependency") | full(extra["vuln_id"]).isNotNull(), dependency).when((engine == "secrets") & full(extra["fingerprint"]).isNotNull(), extra["fingerprint"]).otherwise(plain)))


def fingerprint(file: Column, rule: Column, evidence: Column, occurrence: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lower(posix(file)), rule, evidence, occurrence.cast("string")), 256), 1, 16)


# Redaction -------------------------------------------------------------------------------------


def mask(secret: Column) -> Column:
    """Our own masking: the ends of long values, stars for short ones."""
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.substring(secret, 1, 2), F.lit("****"), F.right(secret, F.lit(2))))


def replace_all(text: Column, values: Column, with_quotes: bool = True) -> Column:
    """Each of ``values`` masked, the longest first; with their quotes, or wherever they stand."""
    longest = F.array_sort(values, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def one(t: Column, v: Column) -> Column:
        if not with_quotes:
            return F.replace(t, v, mask(v))
        for q in ("'", '"'):
            t = F.replace(t, F.concat(F.lit(q), v, F.lit(q)), F.concat(F.lit(q), mask(v), F.lit(q)))
        return t

    return F.aggregate(longest, text, one)


CREDENTIAL = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|credential|private[_-]?key)\w*['\"\]]*\s*[:=]\s*[bBrRuUfF]?(['\"])((?:\\.|(?!\1)[^\\\n]){1,200}?)\1"
PLACEHOLDER = r"(?i)^(x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|changeme|change_me|example|placeholder|your[_-].*|none|null|todo)$"


def credential_literals(text: Column) -> Column:
    """Values assigned to credential-like names, without placeholders."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CREDENTIAL), F.lit(2)), lambda v: ~v.rlike(PLACEHOLDER)))
