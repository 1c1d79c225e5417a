"""Personal data: base patterns and bootstrapped contextual extraction, by DataFrame operations only.

Base entities (email, ip, card, phone) are found by fixed patterns.  They are
the seeds of the second part, with keys of well-known formats as seeds of a
fifth kind, secret.  An instance is a whole base entity, or elsewhere a run of
words that each hold a digit or an at sign, without the signs around it.  Its
lexical patterns come from its line: the last word before it with the signs that
follow that word (``token = "``), the last two words, and the last word together
with what comes after the instance.  Patterns and instances form a graph.
Starting from the seeds, with confidence 1 for their kind, scores go back and
forth a few times: a pattern is as good as the share of its instances that is
believed, damped by its support; an instance is believed as far as its patterns
are (noisy or).  Patterns that end above ``accept`` with enough distinct seeds
are trusted; what they introduce is reported with their kind although it fits no
base pattern, and is a seed for further patterns, until nothing is added.  A
secret is reported only where a trusted pattern introduces it.

Work is linear in a text's length, however many matches it has: places are
sums over what lies between matches, and a pattern looks at no more than
``BEFORE`` and ``AFTER`` characters beside an instance.

Cases: a null text is empty and has no spans; a text of any length is searched
whole; repeated rows have the same spans; ties in score go to the kind listed
first; without seeds nothing is added; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import let
from ..operators.scratch import keep

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive loops and the conditions before
#: a match keep the search linear and change no match: a run that fails from its
#: start fails from every later place in it.  The card pattern takes whole runs
#: of digits with single separators and only those of 12 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words in a row that hold a digit or an at sign.
RUN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[\x20\t]++[^\s0-9@]*+[0-9@]\S*+)*+"
#: Formats of keys, the seeds of the fifth kind.
SECRET = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36})$"
ALL_KINDS = (*KINDS, "secret")
BEFORE, AFTER = 40, 24
#: Matches whose places are added up at a time.
BLOCK = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"
NO_CONTEXTS = "array<struct<start:int,end:int,instance:string,kind:int,words:array<string>>>"


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _upto(sizes: Column, start: Column) -> Column:
    """``start`` and the sums of the first ``sizes``, one for each."""
    state = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, state, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]


def _starts(sizes: Column) -> Column:
    """The sum of all sizes before each, block by block, as growing one array costs its length each time."""

    def placed(all_sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_sizes) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(all_sizes, i + 1, F.lit(BLOCK)))
        return let(blocks, lambda bs: let(
            _upto(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda x, n: x + n)), F.lit(0)),
            lambda offs: F.flatten(F.transform(F.arrays_zip(bs.alias("b"), offs.alias("o")), lambda z: _upto(z["b"], z["o"]))),
        ))

    return let(sizes, placed)


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, found, before, after>> of all matches, in code points: what lies between them gives their places."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def walked(b: Column) -> Column:
        sizes = F.transform(b["m"], lambda m, i: F.length(F.get(b["g"], i)) + F.length(m))
        at = let(sizes, lambda n: F.struct(n.alias("n"), _starts(n).alias("s")))
        return let(at, lambda t: F.transform(b["m"], lambda m, i: F.struct(
            (F.get(t["s"], i) + F.get(t["n"], i) - F.length(m)).alias("start"), m.alias("found"),
            F.right(F.concat(F.coalesce(F.right(F.get(b["m"], i - 1), F.lit(BEFORE)), F.lit("")), F.get(b["g"], i)), F.lit(BEFORE)).alias("before"),
            F.left(F.concat(F.get(b["g"], i + 1), F.coalesce(F.left(F.get(b["m"], i + 1), F.lit(AFTER)), F.lit(""))), F.lit(AFTER)).alias("after"),
        )))

    return let(both, walked)


def _base(text: Column, shape: Callable[[int, Column], Column], none: str) -> Column:
    """``shape`` of (the number of the kind, the place) of every base entity."""

    def of(k: int, kind: str) -> Column:
        found = F.transform(F.filter(_places(text, PATTERNS[kind]), lambda p: _valid(kind, p["found"])), lambda p: shape(k, p))
        possible = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9]")
        return F.when(possible, F.when(text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(none))).otherwise(F.array().cast(none))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its number), end>> by start, then kind."""
    return F.array_sort(_base(text, lambda k, p: F.struct(p["start"].alias("start"), F.lit(k).alias("kind"), (p["start"] + F.length(p["found"])).alias("end")), SPANS))


def patterns_of(before: Column, after: Column) -> Column:
    """array<string>: the lexical patterns of what stands between ``before`` and ``after``."""
    line = F.regexp_extract(F.lower(F.right(before, F.lit(BEFORE))), r"([^\n\r]*)$", 1)
    line = F.rtrim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0"), r"\s+", " "))

    def made(x: Column) -> Column:
        one, two = F.regexp_extract(x, r"(\p{L}+[^\p{L}]*)$", 1), F.regexp_extract(x, r"(\p{L}+[^\p{L}]+\p{L}+[^\p{L}]*)$", 1)
        right = F.regexp_extract(F.lower(after), r"^[\x20\t]*([^\p{L}\p{N}\s]+|\p{L}+)", 1)
        each = F.array(
            F.when(one != "", F.concat(F.lit("1 "), one)), F.when(two != "", F.concat(F.lit("2 "), two)),
            F.when((one != "") & (right != ""), F.concat(F.lit("3 "), one, F.lit(" _ "), right)),
        )
        return F.array_compact(each)

    return let(line, made)


def _context(start: Column, instance: Column, kind: Column, before: Column, after: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(instance)).alias("end"), instance.alias("instance"), kind.cast("int").alias("kind"), patterns_of(before, after).alias("words"))


def contexts(text: Column) -> Column:
    """array<struct<start, end, instance, kind, words>>: each instance with its place and its patterns.

    A base span is an instance as a whole, with its kind.  Of a run what stands
    before its first base span is one, with the kind of a secret if its format
    is one's, else with none.
    """
    seeds = _base(text, lambda k, p: _context(p["start"], p["found"], F.lit(k), p["before"], p["after"]), NO_CONTEXTS)

    def rest(p: Column) -> Column:
        run = p["found"]
        bare = F.regexp_extract(run, r"^[^\p{L}\p{N}+]*+(.*[\p{L}\p{N}])", 1)
        first = F.when(bare.rlike(SECRET), F.length(run)).otherwise(F.coalesce(F.array_min(F.transform(base_spans(run), lambda b: b["start"])), F.length(run)))

        def cut(stop: Column) -> Column:
            # Words that a base span starts in are part of it.
            left = F.when(stop < F.length(run), F.regexp_replace(F.left(run, stop), r"\S+$", "")).otherwise(run)
            skip = F.length(F.regexp_extract(left, r"^[^\p{L}\p{N}+]*", 0))
            instance = F.regexp_extract(left, r"^[^\p{L}\p{N}+]*+(.*[\p{L}\p{N}])", 1)
            return let(F.struct(skip.alias("k"), instance.alias("i")), lambda c: _context(
                p["start"] + c["k"], c["i"], F.when(c["i"].rlike(SECRET), F.lit(len(KINDS))),
                F.concat(p["before"], F.left(run, c["k"])), F.concat(F.substring(run, c["k"] + F.length(c["i"]) + 1, F.lit(AFTER)), p["after"]),
            ))

        return let(first, cut)

    some = F.filter(F.transform(_places(text, RUN), rest), lambda c: c["instance"].rlike("[0-9@]"))
    every = F.concat(seeds, F.when(text.rlike("[0-9@]"), some).otherwise(F.array().cast(NO_CONTEXTS)))
    return F.filter(every, lambda c: F.size(c["words"]) > 0)


def score_patterns(edges: DataFrame, rounds: int = 3, accept: float = 0.8, min_seeds: int = 5, damping: float = 2.0) -> DataFrame:
    """(word, kind, score) of the trusted patterns, from edges (word, instance, kind or null, n).

    What a trusted pattern introduces is a seed for others: the scores are taken
    anew from the grown seeds until no instance is added.
    """
    edges = keep(edges.groupBy("word", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    sizes = keep(edges.groupBy("word").agg(F.count("*").alias("size")), "pii-sizes")
    pairs = edges.select("word", "instance")
    seeds = keep(edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("kind")), "pii-seeds")
    while True:
        # Only what is believed in part has a row; all else counts 0.
        belief = seeds.select("instance", "kind", F.lit(1.0).alias("b"))
        for step in range(rounds):
            score = pairs.join(belief, "instance").groupBy("word", "kind").agg(F.sum("b").alias("sum")).join(sizes, "word")
            scores = keep(score.select("word", "kind", (F.col("sum") / (F.col("size") + damping)).alias("s")), "pii-scores")
            if step + 1 < rounds:
                told = pairs.join(scores, "word").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - 0.5 * F.col("s")))))).alias("b"))
                belief = seeds.select("instance", "kind", F.lit(1.0).alias("b")).unionByName(told.join(seeds.select("instance"), "instance", "left_anti"))
        held = pairs.join(seeds, "instance").groupBy("word", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_seeds)
        sure = scores.where(F.col("s") >= accept).join(held.select("word", "kind"), ["word", "kind"], "left_semi")
        best = sure.groupBy("word").agg(F.min(F.struct(-F.col("s"), "kind")).alias("m"))
        trusted = keep(best.select("word", F.col("m.kind").alias("kind"), (-F.col("m.col1")).alias("score")), "pii-accepted")
        more = pairs.join(trusted, "word").join(seeds.select("instance"), "instance", "left_anti").groupBy("instance").agg(F.min(F.struct(-F.col("score"), "kind")).alias("m"))
        more = keep(more.select("instance", F.col("m.kind").alias("kind")), "pii-believed")
        if more.isEmpty():
            return trusted
        seeds = keep(seeds.unionByName(more), "pii-seeds")


def find(docs: DataFrame, **scoring: float) -> DataFrame:
    """One row per document: doc_id, base and spans (both array<struct<start, kind, end>>)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), base_spans(text).alias("base"), contexts(text).alias("near"))
    # The texts are read once; spans and contexts are slim.
    seen = keep(seen, "pii-seen")
    each = seen.select("rid", F.explode("near").alias("c")).select("rid", "c.start", "c.end", "c.instance", "c.kind", F.explode("c.words").alias("word"))
    trusted = keep(score_patterns(each.groupBy("word", "instance", "kind").agg(F.count("*").alias("n")), **scoring), "pii-trusted")
    told = each.where(F.col("kind").isNull() | (F.col("kind") >= len(KINDS))).drop("kind").join(trusted, "word").groupBy("rid", "start", "end").agg(F.min(F.struct(-F.col("score"), "kind")).alias("m"))
    told = told.select("rid", "start", F.col("m.kind").alias("kind"), "end", F.lit(False).alias("is_base"))
    # What meets a base span that reaches over several runs is a part of it.
    fixed = seen.join(told.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode("base").alias("b")).select("rid", "b.*", F.lit(True).alias("is_base"))
    order = Window.partitionBy("rid").orderBy("start", F.desc("is_base"), "end", "kind")
    ahead = F.max(F.when(F.col("is_base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("is_base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = told.unionByName(fixed).withColumn("ahead", ahead).withColumn("behind", behind).where(~F.col("is_base") & (F.coalesce("ahead", F.lit(0)) <= F.col("start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("end"))))
    added = free.groupBy("rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    both = seen.select("doc_id", "rid", "base").join(added, "rid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    return both.select("doc_id", "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ALL_KINDS.index(kind))).cast("bigint")
