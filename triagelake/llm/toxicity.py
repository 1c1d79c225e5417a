"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from a bounded sample of labelled rows: the words, and the
stems of inflected words, that together explain the documents labelled toxic.
Each word of a text that is no term is turned into a Levenshtein automaton that
runs against the trie of the lexicon, so that a misspelled term is found with
its distance.  A window around each hit decides
between abuse and quotation (quote marks around it, words of reporting) and
whether it is aimed at someone.  A logistic regression on the sums turns them
into a score.

Cases: null and empty texts have no hits and get the score of a text without
any; words of any length are handled; repeated rows get the same score; without
labelled rows the lexicon is empty and every score is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scratch import drop, keep
from .fitting import Logistic, fold, labelled_sample

TOKEN = re.compile(r"[^\W_]+(?:[0-9@$!*]+[^\W_]+)*|[\"“”„«»]")
QUOTES = frozenset('"“”„«»')
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says say wrote writes quote quoted quoting called calls term word words meaning insult insults slur reported alleged dit disait écrit mot dijo escribió palabra sagte schrieb wort".split())
ADDRESS = frozenset("you your youre u he she they are du dich bist ihr tu toi vous es eres usted".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!*", "oieastasi*")
FEATURES = 8
WINDOW = 6
#: A term that ends in this mark is a stem: it stands for every word that starts with it.
STEM = "*"


class Trie:
    """The lexicon as nested nodes; ``term`` is set where one ends and ``stem`` where a stem does."""

    __slots__ = ("kids", "stem", "term")

    def __init__(self, terms: list[str] = ()) -> None:
        self.kids: dict[str, Trie] = {}
        self.term: str | None = None
        self.stem: str | None = None
        for t in terms:
            node = self
            for ch in t.removesuffix(STEM):
                node = node.kids.setdefault(ch, Trie())
            if t.endswith(STEM):
                node.stem = t
            else:
                node.term = t


class Automaton:
    """Accepts what is within ``limit`` edits of a word.  A state maps positions to the fewest edits made.

    With ``swaps`` two neighbours that change places are one edit; position -1 - i
    is half way through the swap at i.
    """

    def __init__(self, word: str, limit: int, swaps: bool = False) -> None:
        self.word, self.limit, self.swaps = word, limit, swaps

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.limit, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], ch: str) -> tuple[tuple[int, int], ...]:
        word, limit, n = self.word, self.limit, len(self.word)
        out: dict[int, int] = {}
        for at, edits in state:
            if at < 0:
                if word[-1 - at] == ch and edits < out.get(1 - at, limit + 1):
                    out[1 - at] = edits
                continue
            if self.swaps and edits < limit and at + 1 < n and word[at + 1] == ch:
                out[-1 - at] = min(edits + 1, out.get(-1 - at, limit + 1))
            if at < n and word[at] == ch:
                if edits < out.get(at + 1, limit + 1):
                    out[at + 1] = edits
            elif edits < limit:
                if at < n and edits + 1 < out.get(at + 1, limit + 1):
                    out[at + 1] = edits + 1
            if edits < limit and edits + 1 < out.get(at, limit + 1):
                out[at] = edits + 1
        for at in sorted(a for a in out if a >= 0):  # the word's letters that the term lacks
            edits, i = out[at], at
            while edits < limit and i < n:
                edits, i = edits + 1, i + 1
                if edits < out.get(i, limit + 1):
                    out[i] = edits
        return tuple(sorted(out.items()))

    def distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        n = len(self.word)
        best = min((edits + n - at for at, edits in state if at >= 0), default=self.limit + 1)
        return best if best <= self.limit else None

    def prefix_distance(self, state: tuple[tuple[int, int], ...]) -> int | None:
        """The fewest edits to some start of the word."""
        return min((edits for at, edits in state if at >= 0), default=None)


def intersect(trie: Trie, word: str, limit: int, swaps: bool = False) -> tuple[str, int] | None:
    """The nearest term within ``limit`` edits and its distance; ties go to the first in order."""
    auto = Automaton(word, limit, swaps)
    best: tuple[int, str] | None = None
    todo = [(trie, auto.start())]
    while todo:
        node, state = todo.pop()
        if node.term is not None:
            d = auto.distance(state)
            if d is not None and (best is None or (d, node.term) < best):
                best = (d, node.term)
        if node.stem is not None:
            d = auto.prefix_distance(state)
            if d is not None and (best is None or (d, node.stem) < best):
                best = (d, node.stem)
        for ch, kid in node.kids.items():
            if after := auto.step(state, ch):
                todo.append((kid, after))
    return best and (best[1], best[0])


def edits_allowed(term: str) -> int:
    """One edit for terms of four and five letters, two for longer ones, none for shorter ones."""
    n = len(term.removesuffix(STEM))
    return 0 if n < 4 else 1 if n < 6 else 2


def letters(word: str) -> int:
    """The set of its letters, as bits; letters may share one."""
    bits = 0
    for ch in word:
        bits |= 1 << (ord(ch) & 63)
    return bits


def shortened(word: str, limit: int) -> set[str]:
    """The word, and what is left of it without up to ``limit`` letters."""
    out = last = {word}
    for _ in range(limit):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


@dataclass
class Model:
    #: Terms and stems with their weights from 0 to 1: how much likelier they make label 1.
    terms: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    weights: Logistic | None = None


class Matcher:
    """Looks words up in the lexicon, remembering what it has seen."""

    def __init__(self, model: Model, memo: int = 200_000) -> None:
        self.model, self.memo, self.size = model, {}, memo
        whole = [t for t in model.terms if not t.endswith(STEM)]
        self.exact = frozenset(whole)
        self.stems = {t[:-1]: t for t in model.terms if t.endswith(STEM)}
        self.stem_sizes = sorted({len(t) for t in self.stems}, reverse=True)
        #: For one edit and for two: the trie of the terms, and what is left of whole terms and stems without so many letters.
        self.tries = []
        for limit in (1, 2):
            terms = [t for t in model.terms if edits_allowed(t) == limit]
            ends, stems = [t for t in terms if not t.endswith(STEM)], [t[:-1] for t in terms if t.endswith(STEM)]
            left = [frozenset().union(*(shortened(t, limit) for t in kind)) for kind in (ends, stems)]
            sizes = [range(min(map(len, kind)) - limit, max(map(len, kind)) + limit + 1) if kind else range(0) for kind in (ends, stems)]
            if terms:
                ends_of = {n: [letters(t) for t in ends if abs(len(t) - n) <= limit] for n in sizes[0]}
                stems_of = [(len(t) + limit, letters(t)) for t in stems]
                self.tries.append((limit, Trie(terms), *left, ends_of, sizes[1], stems_of))

    def __call__(self, word: str) -> tuple[str, int] | None:
        """The term that ``word`` is or resembles, and the edits between them."""
        if term := self._same(word):
            return term, 0
        if len(word) < 3 or word in self.model.innocent:
            return None
        if word not in self.memo:
            if len(self.memo) >= self.size:
                self.memo.clear()
            self.memo[word] = self._near(word)
        return self.memo[word]

    def _same(self, word: str) -> str | None:
        if word in self.exact:
            return word
        return next((self.stems[word[:n]] for n in self.stem_sizes if word[:n] in self.stems), None)

    def _near(self, word: str) -> tuple[str, int] | None:
        """The nearest term; signs read as letters are an edit at least."""
        plain = word if word.isalpha() else word.translate(SIGNS)
        if plain != word and (term := self._same(plain)):
            return term, 1
        held = letters(plain)
        for limit, trie, ends, stems, ends_of, stem_sizes, stems_of in self.tries:
            # An edit takes or brings one letter at most; what is within so many edits is the same without so many letters.
            alike = any((t & ~held).bit_count() <= limit and (held & ~t).bit_count() <= limit for t in ends_of.get(len(plain), ()))
            possible = alike and not ends.isdisjoint(shortened(plain, limit))
            if not possible and any((t & ~held).bit_count() <= limit and (t & ~letters(plain[:n])).bit_count() <= limit for n, t in stems_of):
                possible = any(n <= len(plain) and not stems.isdisjoint(shortened(plain[:n], limit)) for n in stem_sizes)
            if possible and (found := intersect(trie, plain, limit, True)):
                return found[0], max(found[1], 1)
        return None

    def hits(self, text: str) -> tuple[list[str], dict[str, tuple[str, int]]]:
        """The tokens of a text, and its distinct words that hit with term and distance."""
        words = TOKEN.findall(text.lower())
        return words, {w: m for w in set(words) if (m := self(w))}

    def features(self, text: str) -> list[float]:
        words, hit = self.hits(text)
        if not hit:
            return [0.0] * FEATURES
        total = top = fuzzy = quoted = aimed = count = 0.0
        kinds = set()
        quotes = np.cumsum([w in QUOTES for w in words])
        for i, w in enumerate(words):
            if w not in hit:
                continue
            term, distance = hit[w]
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + WINDOW + 1]
            # Inside a pair of marks: one before it and one after it, both near, an odd number of them so far.
            marks = any(x in QUOTES for x in before) and any(x in QUOTES for x in after) and quotes[i] % 2
            as_quote = min(1.0, 0.7 * bool(marks) + 0.4 * any(x in REPORTING for x in (*before, *after)))
            weight = self.model.terms[term] * (1 - as_quote)
            quoted += as_quote
            aimed += weight * any(x in ADDRESS for x in (*before, *after))
            if distance:
                fuzzy += weight
            else:
                kinds.add(w)
                count += 1 - as_quote
                total, top = total + weight, max(top, weight)
        rate = 100 * (count + 0.5 * fuzzy) / len(words)
        return [top, min(total, 6.0), float(np.log1p(count)), min(len(kinds), 6) / 6, float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(rate)), float(np.log1p(aimed))]


def _stems(words: Column, n: int) -> Column:
    """The stems of ``n`` letters of the longer words."""
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit(STEM)))


def learn_lexicon(sample: DataFrame, min_docs: int = 4, min_share: float = 0.35, evidence: float = 30.0) -> dict[str, float]:
    """Words and stems that toxic documents hold far more often than others, taken greedily while they explain new ones.

    Copies of a text count once.  A term needs ``min_docs`` toxic documents, a
    hundredth of all of them at least, ``min_share`` of its documents, and so
    many more than chance would give it that their log-likelihood ratio reaches
    ``evidence``: among a million words none gets there by luck.  What reaches
    the driver is bounded by the sample's rows.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & (F.length(w) <= 30)))
    once = sample.select("doc_id", "y", words.alias("w"), F.xxhash64("text").alias("h")).dropDuplicates(["h"])
    stems = [_stems(F.col("w"), n) for n in (4, 5, 6, 7)]
    each = once.select("doc_id", "y", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
    n_bad, n_all = once.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    if not 0 < n_bad < n_all:
        return {}
    least = max(min_docs, 0.01 * n_bad)
    stats = each.groupBy("term").agg(F.sum("y").cast("bigint").alias("bad"), F.count("*").alias("n")).where((F.col("bad") >= least) & (F.col("bad") >= min_share * F.col("n")))
    surprise = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(F.lit(0.0))
    ratio = 2 * (surprise(F.col("bad"), n_bad / n_all) + surprise(F.col("n") - F.col("bad"), 1 - n_bad / n_all))
    stats = keep(stats.where((ratio >= evidence) & (F.col("bad") * n_all > F.col("n") * n_bad)), "toxic-terms")
    rows = each.where("y = 1").join(stats, "term").groupBy("term", "bad", "n").agg(F.collect_set("doc_id").alias("ids")).collect()
    left = {r["term"]: set(r["ids"]) for r in rows}
    share = {r["term"]: r["bad"] / (r["n"] + 0.5) for r in rows}
    odds = {r["term"]: np.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5) * (n_all - n_bad + 0.5) / (n_bad + 0.5)) for r in rows}
    # A stem is worth having only where no one longer form stands in nearly all of its documents.
    for t in [t for t in left if t.endswith(STEM)]:
        if any(o != t and o.startswith(t[:-1]) and len(left[o]) >= 0.9 * len(left[t]) for o in left):
            del left[t]
    terms: dict[str, float] = {}

    def take(term: str) -> None:
        terms[term] = float(np.clip(odds[term] / 6, 0.1, 1))
        start = term[:-1] if term.endswith(STEM) else None
        for t in [t for t in left if t == term or start and t.startswith(start)]:
            explained.update(left.pop(t))

    # First what hardly any other document holds.
    explained: set = set()
    for t in sorted(left, key=lambda t: (-len(left[t]), -len(t), t)):
        if t in left and share[t] >= 0.9 and len(left[t]) >= max(least, 0.02 * n_bad):
            take(t)
    # Then what explains the rest, though others hold it too; how often and in how many forms decides later.
    while left:
        best = max(left, key=lambda t: (len(left[t] - explained) * share[t] ** 0.5, len(t), t))
        if len(left[best] - explained) < least:
            break
        take(best)
    drop(stats)
    return terms


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, rows: int = 9_000, max_bytes: int = 32_768) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, rows, max_bytes)
    sample = keep(sample.select("doc_id", "text", F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")).repartition(8, "doc_id"), "toxic-sample")
    model = Model(learn_lexicon(sample))
    finder = Matcher(model)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, h, y) for t, h, y in zip(*(batch[n].to_pylist() for n in ("text", "half", "y")), strict=True) for w, m in finder.hits(t)[1].items() if m[1]]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], ["w", "half", "y"])

    # Ordinary words that are near a term: a larger share of the clean documents of the sample than of the
    # toxic ones holds them.  The weights are fitted on one half with what the other half shows, as later
    # texts bring words not yet seen.
    near = sample.select("text", "half", "y").mapInArrow(variants, "w string, half int, y int").groupBy("w", "half", "y").count().collect() if model.terms else []
    held = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}

    def innocent(halves: tuple[int, ...]) -> frozenset[str]:
        share: dict[str, list[float]] = {}
        for r in near:
            if r["half"] in halves:
                share.setdefault(r["w"], [0.0, 0.0])[r["y"]] += r["count"] / sum(held.get((h, r["y"]), 0) for h in halves)
        return frozenset(w for w, (clean, toxic) in share.items() if clean > toxic)

    model.innocent = innocent((0,))
    x, y = [], []
    for r in _features(sample.where("half = 1"), model, ["y int"]).collect():
        x.append(r["features"])
        y.append(r["y"])
    model.innocent = innocent((0, 1))
    prior = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).agg(F.avg("toxic")).first()[0]
    model.weights = Logistic(np.array(x, dtype=float).reshape(-1, FEATURES), np.array(y, dtype=float), l2=0.3, prior=min(max(prior or 0.5, 0.02), 0.98))
    drop(sample)
    return model


def _features(docs: DataFrame, model: Model, others: list[str]) -> DataFrame:
    names = [o.split()[0] for o in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            f = [matcher.features(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(f, pa.list_(pa.float64()))], [*names, "features"])

    return docs.select("text", *names).mapInArrow(run, ", ".join([*others, "features array<double>"]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, at: hash of the row, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            x = np.array([matcher.features(t or "") for t in batch["text"].to_pylist()], dtype=float).reshape(-1, FEATURES)
            s = model.weights.score(x)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["at"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "at", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("at"), "text")
    return rows.mapInArrow(run, "doc_id bigint, at bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            x = np.array([matcher.features(t or "") for t in batch["text"].to_pylist()], dtype=float).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.weights.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
