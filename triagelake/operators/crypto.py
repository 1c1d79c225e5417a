"""Weak cryptography from the facts of source files: every rule is a condition on a call's or an attribute's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import lookup, strings

DETAIL = "struct<t:array<string>,i:array<string>,a:struct<y:string,v:string>,k:map<string,struct<y:string,v:string>>,s:string,n:boolean>"


def _ends(name: Column, tails: Sequence[str]) -> Column:
    return F.exists(strings(tails), lambda t: (name == t) | F.endswith(name, t))


def _starts(name: Column, heads: Sequence[str]) -> Column:
    return F.exists(strings(heads), lambda h: F.startswith(name, h))


def _is_a(name: Column, full: Sequence[str]) -> Column:
    """The name itself, or it as the end of a longer one."""
    return F.exists(strings(full), lambda f: (name == f) | F.endswith(name, F.concat(F.lit("."), f)))


def sensitive_name(name: Column) -> Column:
    """Whether a variable's name is that of something secret."""
    low = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return F.exists(strings(T.SECRET_NAMES), lambda w: F.contains(low, w))


def hash_context(names: Column) -> Column:
    """password, checksum or general, from the names beside a hash."""
    holds = lambda words: F.exists(names, lambda n: F.exists(strings(words), lambda w: F.contains(F.replace(F.lower(n), F.lit("-"), F.lit("_")), w)))
    return F.when(holds(T.PASSWORD_NAMES), "password").when(holds(T.CHECKSUM_NAMES), "checksum").otherwise("general")


def weaknesses(rows: DataFrame) -> DataFrame:
    """(file, line, rule, cwe, severity, exploitability, evidence, context) of the ``call`` and ``attribute`` facts."""
    d = F.from_json("detail", DETAIL)
    facts = rows.where("kind in ('call', 'attribute') and detail <> ''").select("file", "line", "kind", "name", d.alias("d"))
    name, k, first = F.col("name"), F.col("d.k"), F.col("d.a")
    word = lambda key: F.lower(k[key]["v"])
    is_call = F.col("kind") == "call"
    digest = F.lower(F.coalesce(k["name"]["v"], first["v"]))
    is_new = _is_a(name, ["hashlib.new"])
    md5 = name.isin("hashlib.md5", "md5") | _ends(name, T.MD5_CALLS) | (is_new & (digest == "md5"))
    sha1 = name.isin("hashlib.sha1", "sha1") | _ends(name, T.SHA1_CALLS) | (is_new & digest.isin("sha1", "sha-1"))
    safe = F.coalesce(word("usedforsecurity") == "false", F.lit(False))
    none = F.array().cast("array<string>")
    context = hash_context(F.concat(F.coalesce(F.col("d.t"), none), F.coalesce(F.col("d.i"), none)))
    mode = _ends(name, T.CIPHER_MODES)
    iv = F.coalesce(F.when(mode, first), k["iv"], k["nonce"], k["initial_value"])
    bits = F.when(_ends(name, ["RSA.generate", "DSA.generate"]), F.coalesce(k["bits"], k["key_size"], first)).when(_ends(name, ["rsa.generate_private_key"]), k["key_size"])
    url = first["v"]
    client = _starts(name, T.HTTP_CLIENTS) | _ends(name, T.HTTP_VERBS)

    def found(rule: str | Column, holds: Column, kind: str | Column, row: str | None = None) -> Column:
        """A struct of the rule where it holds; ``kind`` names its row of the table of weaknesses."""
        key = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(F.coalesce(holds, F.lit(False)), F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), key.alias("key"), (context if row == "hash" else F.lit(None).cast("string")).alias("context")))

    hashes = F.when(md5, "weak-hash-md5").when(sha1, "weak-hash-sha1")
    every = F.array_compact(F.array(
        found("insecure-prng", is_call & F.col("d.n") & _starts(name, T.PLAIN_RANDOM) & F.exists(F.coalesce(F.col("d.t"), none), sensitive_name), "insecure-prng"),
        found("insecure-tls-version", ~is_call & _starts(name, T.OLD_PROTOCOLS), "insecure-tls-version"),
        found("insecure-mode-ecb", (~is_call & F.endswith(name, F.lit("MODE_ECB"))) | (is_call & F.endswith(name, F.lit("modes.ECB"))), "insecure-mode-ecb"),
        found(hashes, is_call & (md5 | sha1) & ~safe, F.when(context == "general", hashes).otherwise(context), "hash"),
        found("insecure-cipher-des", is_call & _ends(name, T.DES_CALLS), "insecure-cipher"),
        found("insecure-cipher-rc4", is_call & _ends(name, T.RC4_CALLS) & ~_ends(name, T.DES_CALLS), "insecure-cipher"),
        found("static-iv", is_call & (mode | _ends(name, T.CIPHER_CALLS)) & iv["y"].isin("bytes", "str", "int"), "static-iv"),
        found("weak-key-size", is_call & (bits["y"] == "int") & (bits["v"].try_cast("int") < 2048), "weak-key-size"),
        found("tls-verify-disabled", is_call & _is_a(name, ["ssl._create_unverified_context", "_create_unverified_context"]), "unverified-context"),
        found("tls-verify-disabled", is_call & client & (k["verify"]["y"] == "bool") & (word("verify") == "false"), "unverified-call"),
        found("tls-verify-disabled", is_call & client & k["cert_reqs"]["v"].isin("CERT_NONE", "0", "none"), "unverified-call"),
        found("cleartext-http", is_call & _starts(name, T.NETWORK_CALLS) & (first["y"] == "str") & F.startswith(url, F.lit("http://")) & ~F.exists(strings(T.LOCAL_HOSTS), lambda h: F.contains(url, h)), "cleartext-http"),
    ))
    hit = facts.withColumn("w", F.explode(every))
    at = lambda i: lookup({n: v[i] for n, v in T.CRYPTO_WEAKNESSES.items()}, F.col("w.key"))
    return hit.select("file", "line", F.col("w.rule").alias("rule"), at(0).alias("cwe"), at(1).alias("severity"), at(2).alias("exploitability"), F.col("d.s").alias("evidence"), F.col("w.context").alias("context")).distinct()
