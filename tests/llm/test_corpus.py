"""The corpus operators against plain versions, and their edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triagelake.llm import ann, decontam, fitting, huffman, linededup, minhash, packing, pii, quality, sharding, tokens, toxicity

DOCS = "doc_id long, text string, size string, at string"
EDGE = [(1, "One two three four five six seven eight nine ten eleven.", "x", "y"), (2, None, None, None), (3, "", "x", "y"), (None, "no id here at all", "x", "y"), (4, "same text", "x", "y"), (4, "same text", "x", "y"), (5, "word " * 30_000, "x", "y"), (6, "...\n\t\n", "x", "y"), (-7, "Ünïcode ☃ 日本語\nsecond", "x", "y")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# 1 -------------------------------------------------------------------------------------------------


def test_shards_have_near_equal_bytes_and_gapless_slots(spark, edge, empty):
    rng = random.Random(1)
    docs = [(k, "x" * rng.randint(1, 400) + str(k)) for k in range(3000)] + [(k, "hot " * 20) for k in range(3000, 4500)] + [(k, f"pair{k // 2}") for k in range(5000, 5600)]
    out = sharding.shard_by_bytes(spark.createDataFrame(docs, "doc_id long, text string"), shards=8).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(d for d, _ in docs)
    text = dict(docs)
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    total = Counter()
    for r in out:
        total[r["shard"]] += r["size"]
    mean = sum(total.values()) / 8
    assert max(abs(v - mean) for v in total.values()) < 0.05 * mean + 400
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    shard = {r["doc_id"]: r["shard"] for r in out}
    assert all(shard[k] == shard[k + 1] for k in range(5000, 5600, 2))
    assert len({shard[k] for k in range(3000, 4500)}) > 1
    got = sharding.shard_by_bytes(edge, 4).collect()
    assert len(got) == len(EDGE) and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert sharding.shard_by_bytes(empty).count() == 0


# 2 -------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0


def brute_spans(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if fine(kind, m[0]))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in found)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y+z@d-e.f.g", "@", ".", "..", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "4111  1111", "+1 (234) 555-6789", "+12", "++123456789", "é☃", " ", "\n", "-", "0001.02.3.4", "12", "a@b", "a@b.cd_x@d.e", "+", "1" * 25, "日本"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "9" * 20_000, "a" * 50_000 + "@", "a.b@c" + ".d" * 20_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find(df).select("doc_id", pii.as_text("base").alias("s")).collect()}
    assert [(texts[k], v) for k, v in got.items() if v != brute_spans(texts[k] or "")][:3] == []


def test_contexts_discover_unseen_identifiers(spark, empty, edge):
    docs = [(k, f"some words contact: user{k}@mail.org and more") for k in range(30)] + [(100, "please contact: jane_doe77(at)mail today"), (101, "the jane_doe77(at)mail of it")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", pii.as_text("spans").alias("spans")).collect()}
    assert got[100] == "email:16:34" and got[101] == "" and got[3] == "email:20:34"
    assert pii.find(empty).count() == 0 and pii.find(edge).count() == len(EDGE)


def spans_of(spark, docs):
    return {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", pii.as_text("spans").alias("spans")).collect()}


def test_spaced_identifiers_are_whole_seeds_and_instances(spark):
    docs = [(k, f"you may ring +1 ({200 + k}) 555-{1000 + k} today") for k in range(20)]
    docs += [(k + 50, f"paid by visa 4{k:03d} 0000 0000 000{d} then") for k in range(20) for d in range(10) if luhn(f"4{k:03d}00000000000{d}")]
    long = "x9" * 60
    docs += [(100, "please ring 0692 555 7565 now"), (101, "with visa 1234-5678 9012 only"), (102, f"do ring {long} now"), (103, "ring 77 now")]
    got = spans_of(spark, docs)
    assert got[100] == "phone:12:25" and got[101] == "card:10:24" and got[102] == "phone:8:128" and got[103] == "phone:5:7"
    assert got[3] == "phone:13:30" and got[50].startswith("card:13:")


def test_discovered_identifiers_discover_further_patterns(spark):
    # first introduces base entities and unseen ones, second only unseen ones, some of them first's; third only second's.
    docs = [(k, f"first user{k}@mail.org here") for k in range(80)]
    docs += [(100 + k, f"first ident-a{k}x here") for k in range(12)] + [(200 + k, f"second ident-a{k}x here") for k in range(12)]
    docs += [(300, "second ident-b0x here"), (301, "second ident-b1x here"), (400, "third ident-b0x here")]
    got = spans_of(spark, docs)
    assert got[100] == "email:6:15" and got[200] == "email:7:16" and got[300] == "email:7:16" and got[400] == ""


def test_keys_are_found_where_a_pattern_introduces_them(spark):
    rng = random.Random(8)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(k, f'some w{"abcdefgh"[k % 8]} token = "{key()}" and more') for k in range(40)]
    docs += [(100, f'X TOKEN = "{key().upper()}"!! Y'), (101, f"the commit {key()} is lone"), (102, 'the token = "short1" too')]
    got = spans_of(spark, docs)
    assert got[0] == "secret:17:57" and got[100] == "secret:11:51" and got[101] == "" and got[102] == "secret:13:19"


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{k}@mail.org" for k in range(20_000))
    out = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.as_text("base").alias("s")).first()["s"]
    assert out == brute_spans(text)


def brute_scores(edges, rounds=3, accept=0.8, min_seeds=5, damping=2.0):
    at, kind = {}, {}
    for w, i, k in edges:
        at.setdefault(w, set()).add(i)
        if k is not None:
            kind[i] = max(kind.get(i, k), k)
    while True:
        belief = {(i, k): 1.0 for i, k in kind.items()}
        for step in range(rounds):
            s = Counter()
            for w, inst in at.items():
                for (i, k), b in belief.items():
                    if i in inst:
                        s[w, k] += b / (len(inst) + damping)
            if step + 1 < rounds:
                not_told = {}
                for (w, k), v in s.items():
                    for i in at[w] - set(kind):
                        not_told[i, k] = not_told.get((i, k), 1.0) * max(1e-6, 1 - 0.5 * v)
                belief = {(i, k): 1.0 for i, k in kind.items()} | {x: 1 - v for x, v in not_told.items()}
        sure = {}
        for (w, k), v in sorted(s.items(), key=lambda x: (-x[1], x[0][1])):
            if v >= accept and sum(kind.get(i) == k for i in at[w]) >= min_seeds:
                sure.setdefault(w, (k, v))
        more = {}
        for w, (k, v) in sure.items():
            for i in at[w] - set(kind):
                more[i] = min(more.get(i, (-v, k)), (-v, k))
        if not more:
            return {w: (k, round(v, 9)) for w, (k, v) in sure.items()}
        kind |= {i: k for i, (_, k) in more.items()}


def test_pattern_scores_equal_a_plain_version(spark):
    rng = random.Random(12)
    edges = [(w, f"i{rng.randrange(40 * w, 40 * w + 70)}", None) for w in range(8) for _ in range(40)]
    seeds = {f"i{k}": rng.choice([0, 0, 1]) for k in range(400) if rng.random() < 0.85}
    edges = [(f"w{w}", i, seeds.get(i)) for w, i, _ in edges]
    got = pii.score_patterns(spark.createDataFrame([(*e, 1) for e in edges], "word string, instance string, kind int, n long"), accept=0.55).collect()
    want = brute_scores(edges, accept=0.55)
    assert want and {r["word"]: (r["kind"], round(r["score"], 9)) for r in got} == want


def luhn(digits):
    total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(int(x) for x in reversed(digits)))
    return total % 10 == 0


# 3 -------------------------------------------------------------------------------------------------


def brute_lines(docs, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(minhash.ASCII_LOWER)
    split = [(d, (t or "").split("\n")) for d, t in docs]
    n = Counter(k for _, ls in split for k in {key(x) for x in ls})
    return sorted((d if d is not None else -1, len(ls), "\n".join(x for x in ls if not key(x) or n[key(x)] < least)) for d, ls in split)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_equals_brute_force(spark, batches):
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(["Footer ", " footer", "É line", "é line", "", "  ", f"own {k}", f"half {rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 9)))) for k in range(120)] + [(200, None), (None, "footer\nx"), (3, "dup"), (3, "dup")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = linededup.dedup_lines(df, min_docs=10, batches=batches, fanout=2)
    got = sorted((r["doc"]["doc_id"] if r["doc"]["doc_id"] is not None else -1, r["n_lines"], r["kept"]) for r in out.collect())
    assert got == brute_lines(docs, 10)


def test_line_dedup_keeps_other_columns(spark, edge, empty):
    out = linededup.dedup_lines(edge, min_docs=2).collect()
    assert len(out) == len(EDGE) and {tuple(r["doc"]) for r in out} == set(EDGE)
    assert {r["kept"] for r in out if r["doc"]["doc_id"] == 4} == {""} and linededup.dedup_lines(empty).count() == 0


# 4 -------------------------------------------------------------------------------------------------


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    u = np.unique(rng.integers(1, 2**62, 300).astype(np.uint64))
    a, b = (u, rng.integers(1, 12, len(u))), (u[30:], rng.integers(1, 12, len(u) - 30))
    s = minhash.signatures([a, b], m=4000)
    assert abs((s[0] == s[1]).mean() - minhash.similarity(a, b)) < 0.04
    assert np.array_equal(minhash.signatures([a], m=64), minhash.signatures([a, b], m=64)[:1])


def brute_classes(docs, t):
    bags = []
    for _, text in docs:
        w = minhash.words_of(text)
        n = min(5, len(w))
        bags.append(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else None)
    parent = list(range(len(docs)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = bags[i], bags[j]
        same = docs[i][1] == docs[j][1] if a is None or b is None else sum((a & b).values()) >= t * sum((a | b).values())
        if same or (docs[i][1] or "") == (docs[j][1] or ""):
            parent[find(i)] = find(j)
    return Counter(tuple(sorted(docs[k][0] for k in range(len(docs)) if find(k) == r)) for r in {find(k) for k in range(len(docs))})


def test_near_duplicates_equal_brute_force(spark, empty):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(60, 150))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    docs += [(900, None), (901, ""), (902, "..."), (903, "..."), (904, "a b"), (905, "A  b!"), (906, "rep rep " * 200), (907, "rep rep " * 150)]
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = Counter(tuple(sorted(r["id"] for r in out if r["class_id"] == c)) for c in {r["class_id"] for r in out})
    assert got == brute_classes(docs, 0.8)
    assert all(sum(r["kept"] for r in out if r["class_id"] == c) == 1 for c in {r["class_id"] for r in out})
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_edges(edge):
    out = minhash.near_duplicates(edge).collect()
    assert len(out) == len(EDGE) and sorted(r["kept"] for r in out if r["id"] == 4) == [False, True]
    assert {r["class_size"] for r in out if r["id"] in (2, 3)} == {2}


def test_classes_of_null_or_shared_ids_stay_apart(spark):
    docs = [(None, "one text of its own here"), (None, "another text that nobody shares"), (7, "a third text of words"), (7, "the fourth text, different"), (None, "one text of its own here")]
    out = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(r["class_id"] for r in out).most_common(1)[0][1] == 2 and len({r["class_id"] for r in out}) == 4 and sum(r["kept"] for r in out) == 4


# 5, 6 ----------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=6, unique=True), st.integers(0, 2))
def test_automaton_meets_trie_like_edit_distance(word, terms, limit):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    best = min(((distance(word, t), t) for t in terms), default=None)
    assert toxicity.intersect(toxicity.Trie(terms), word, limit) == ((best[1], best[0]) if best[0] <= limit else None)


def test_quotation_counts_less_than_abuse():
    m = toxicity.Matcher(toxicity.Model({"idiot": 1.0}))
    abuse, quote, typo = (m.features(t) for t in ("you are an idiot and that is all", 'he said the word "idiot" means a fool', "you are an idoit or 1diot"))
    assert abuse[0] == 1.0 and quote[0] < 0.4 and quote[5] > 0 and typo[4] > 0 and typo[0] == 0


def test_misspelled_stems_short_terms_swaps_and_long_terms():
    m = toxicity.Matcher(toxicity.Model({"idiot": 1.0, "scum": 1.0, "grumbl*": 1.0, "stupid": 1.0}))
    want = {"idoit": "idiot", "1diot": "idiot", "5cum": "scum", "scmu": "scum", "grubmlers": "grumbl*", "grum8lers": "grumbl*", "grumling": "grumbl*", "stoopid": "stupid"}
    assert {w: m(w) and m(w)[0] for w in want} == want and all(m(w)[1] >= 1 for w in want)
    assert m("grumblers") == ("grumbl*", 0) and m("ordinary") is None and m("scam") == ("scum", 1)


def test_variants_are_innocent_by_their_share(spark):
    docs, labels = toy(spark, "grumbler grumblar", "toxic")
    docs = docs.unionByName(spark.createDataFrame([(1000, "plain1 plain2 grumblar")], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(1000, 0)], labels.schema))
    lexicon, toxicity.learn_lexicon = toxicity.learn_lexicon, lambda sample: {"grumbler": 1.0}
    try:
        assert "grumblar" not in toxicity.fit(docs, labels).innocent
    finally:
        toxicity.learn_lexicon = lexicon


def toy(spark, word, label, n=400):
    rng = random.Random(2)
    vocab = [f"plain{k}" for k in range(50)]
    docs, labels = [], []
    for k in range(n):
        y = k % 2
        w = [rng.choice(vocab) for _ in range(40)]
        if y:
            w[5] = w[20] = word
        docs.append((k, " ".join(w)))
        labels.append((k, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {label} int")


def test_toxicity_learns_and_holds_out(spark, edge, empty):
    docs, labels = toy(spark, "grumbler", "toxic")
    model = toxicity.fit(docs, labels)
    assert "grumbler" in model.terms
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(out[k]["predicted"] == k % 2 for k in held)
    assert toxicity.score(edge, model).count() == len(EDGE) and toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(edge, model).count() == len(EDGE) and toxicity.keep_clean(edge, model).columns == edge.columns
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(r["score"], 6) for r in toxicity.score(edge, none).collect()} and none.terms == {}


def test_quality_learns_and_holds_out(spark, edge, empty):
    docs, labels = toy(spark, "%%% &&& $$$ ### %%% &&& $$$ *** @@@ %%%", "quality")
    model = quality.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    held = [k for k in out if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and sum(out[k]["predicted"] == k % 2 for k in held) >= 0.9 * len(held)
    scores = [r["score"] for r in quality.score(edge, model).collect()]
    assert len(scores) == len(EDGE) and all(0 <= s <= 1 for s in scores) and quality.score(empty, model).count() == 0
    assert len({r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()}) == 1


def test_samples_are_bounded_and_leave_the_held_out_fold(spark):
    docs, labels = toy(spark, "x", "toxic")
    got = fitting.labelled_sample(docs, labels, "toxic", 3, 1, 50, 10_000).collect()
    assert len(got) == 50 and Counter(r["y"] for r in got) == {0: 25, 1: 25} and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)


# 7, 9 ----------------------------------------------------------------------------------------------

TEXTS = ["", "  ", "It's you're we'll '' 'store 'sx don't", "Äpfel ÖÜ ß ÿ Ø", "áb é ﬁ İ ☃ 日本語 x", "x" * 3000, "12345 a1b2 #$%^ '''s", "<|endoftext|> hi", " nb \x85 \x0b a", "“q” ‘s — …’s", None]


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_path(), chunk=200, longest=12)
    for t in TEXTS + [" ".join(f"w{k}," for k in range(300))]:
        assert e.encode([t])[0].tolist() == [*e.library.encode(t or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_encoder_equals_the_library_on_any_text(t):
    e = tokens.encoder(tokens.default_path())
    assert e.encode([t])[0].tolist() == [*e.library.encode(t, add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=300), min_size=1, max_size=6), st.integers(6, 9))
def test_huffman_files_round_trip(docs, longest):
    counts = np.bincount(np.concatenate([np.array(d) for d in docs]), minlength=50) ** 3
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest and (np.count_nonzero(counts) < 2 or sum(2.0 ** -lengths[lengths > 0].astype(float)) == 1)
    codes = huffman.canonical_codes(lengths)
    file = huffman.build_file([(k or None, len(d), *huffman.encode_block(np.array(d), codes, lengths, 7)) for k, d in enumerate(docs)], lengths, 7)
    assert [(k, ids.tolist()) for k, ids in huffman.read_file(file)] == [(k or None, d) for k, d in enumerate(docs)]


def test_token_files_hold_every_document_in_order(spark, edge, empty):
    e = tokens.encoder(tokens.default_path())
    got = huffman.read_files(huffman.write_files(edge, tokens_per_file=100)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in EDGE), key=lambda x: (x is not None, x or 0))
    want = Counter((d[0], e.encode([d[1]])[0].tobytes()) for d in EDGE)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    assert huffman.read_files(huffman.write_files(empty)).count() == 0


def test_token_files_are_left_as_files(spark, edge, tmp_path):
    made = huffman.write_files(edge, tokens_per_file=100)
    names = {r["name"]: r["bytes"] for r in huffman.save_files(made, f"file://{tmp_path}/out").collect()}
    assert names == {f.name: f.stat().st_size for f in (tmp_path / "out").iterdir() if f.suffix == ".tlh"} and len(names) == made.count()
    back = huffman.load_files(spark, f"{tmp_path}/out")
    assert rows(back.select("part", "seq", "n_tokens").orderBy("part", "seq"), "part", "seq", "n_tokens") == rows(made.orderBy("part", "seq"), "part", "seq", "n_tokens")
    assert sorted(huffman.read_files(back).collect(), key=str) == sorted(huffman.read_files(made).collect(), key=str)


def test_checkpoints_count_beyond_32_bits():
    lengths = huffman.code_lengths(np.array([3, 2, 1]), 16)
    points, _ = huffman.encode_block(np.array([0, 1, 2, 1]), huffman.canonical_codes(lengths), lengths, 2)
    assert len(points) == 16 and np.frombuffer(points, "<u8").tolist() == [0, int(lengths[0]) + int(lengths[1])]


def test_pieces_are_powers_of_two_and_cover_each_document(spark, edge, empty):
    e = tokens.encoder(tokens.default_path())
    out = packing.pack(edge).collect()
    for doc_id, text in {(d[0], d[1]) for d in EDGE if d[0] != 4}:
        ids, mine = e.encode([text])[0], sorted((r for r in out if r["doc_id"] == doc_id), key=lambda r: r["start"])
        assert [(r["start"], r["length"]) for r in mine] == [(s, n) for s, n in zip([0, *itertools.accumulate(packing.lengths_of(len(ids), 2048))], packing.lengths_of(len(ids), 2048))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) and r["doc_tokens"] == len(ids) and r["offset"] == 0 for r in mine)
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out))) and all(r["length"] & (r["length"] - 1) == 0 for r in out)
    assert packing.pack(empty).count() == 0


# 8 -------------------------------------------------------------------------------------------------


def brute_overlap(docs, items, width=10):
    word = lambda t: minhash.words_of(t)
    out = []
    for d, t in docs:
        w, hit, ids = word(t), set(), set()
        for i, it in items:
            iw = word(it)
            n = min(width, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if iw else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_decontamination_equals_brute_force(spark, bound, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", bound)
    rng = random.Random(11)
    vocab = ["a", "b", "C", "é", "9", "Ωx"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([12, 10, 4, 1, 2, 0, 30, 11])] + [(50, None), (51, "zz-top, YES"), (52, "zz top yes")]
    docs = [(k, ", ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(900, items[0][1]), (901, "x " + items[6][1] + ". y"), (902, None), (903, ""), (904, "Zz Top. yes zz"), (905, items[7][1] * 2), (906, "dup zz top yes"), (906, "dup zz top yes")]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(rows(out, "doc_id", "n_words", "n_hit", "item_ids"), key=str) == brute_overlap(docs, items)


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    assert sorted(r["n_hit"] for r in decontam.decontaminate(edge, items).collect()) == [0] * (len(EDGE) - 1) + [10]
    assert decontam.decontaminate(edge, items.where("false")).where("n_hit > 0").count() == 0 and decontam.decontaminate(empty, items).count() == 0


# 10 ------------------------------------------------------------------------------------------------


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, (1500, 1))
    table = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [None] * 32), (5004, [1.0] * 3), (None, [1.0] * 32), (7, [float(v) for v in x[7]])]
    index = ann.Index(spark.createDataFrame(table, "vec_id long, embedding array<double>"), block_rows=400)
    got = index.search(index.table.where("vec_id % 20 = 0").select("vec_id", "v"), k=20, batch_rows=40).collect()
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (75 * 20) >= 0.9


def test_ann_recall_at_the_real_share(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>"))
    asked = index.table.where("vec_id % 100 = 0").select("vec_id", "v")
    got: dict = {}
    for r in index.search(asked.unionByName(asked.where("vec_id < 500")), k=20).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert all(len(v) == len(set(v)) == 20 for v in got.values())
    hit = sum(len(set(v) & set(np.argsort(-np.where(np.arange(9000) == q, -9, x @ x[q]))[:20].tolist())) for q, v in got.items())
    assert len(got) == 90 and hit / (90 * 20) >= 0.9


def test_ann_memory_of_a_batch(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(3).normal(size=(10_000, 8))
    few = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x[:1100])], "vec_id long, embedding array<double>")
    posts, real = [], type(few).mapInArrow
    monkeypatch.setattr(type(few), "mapInArrow", lambda self, f, *a, **b: posts.append(f) or real(self, f, *a, **b))
    index = ann.Index(few, pivots=1024)
    batch = pa.RecordBatch.from_pydict({"vec_id": list(range(10_000)), "block": pa.array([0] * 10_000, pa.int32()), "v": x.tolist()})
    tracemalloc.start()
    (out,) = posts[0](iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = ann.nearest(ann.lift(x, index.largest) @ index.pivots.T, 64)
    assert out["perm"].to_pylist() == [p.tobytes() for p in want] and most < 30e6  # all products at once are 82 MB


def test_ann_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<double>")
    index = ann.Index(few)
    got = index.search(index.table.where("vec_id = 0").select("vec_id", "v"), k=20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.0)]
    none = ann.Index(few.where("false"))
    assert none.search(none.table.select("vec_id", "v")).count() == 0


# Pipeline ------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    vocab = [f"plain{k}" for k in range(300)]
    prose = lambda: " ".join(rng.choice(vocab) for _ in range(60))
    item = prose()
    docs = [(k, prose() + ("\nfooter line" if k < 30 else "") + (" grumbler you grumbler" if k % 10 == 0 else "")) for k in range(200)]
    docs += [(300, docs[1][1]), (301, docs[1][1] + " end"), (302, prose() + " " + item), (303, None), (304, docs[2][1]), (304, docs[2][1])]
    full = [(d, t, "en", "src", len(t or ""), "kept") for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = df.columns, []
    for k, (_name, stage) in enumerate(P.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        df = spark.read.parquet(f"{tmp_path}/out{k}")
        assert k == 4 or df.columns == columns
        seen.append(sorted(r["doc_id"] for r in df.collect()))
    assert [d for d in range(200) if d % 10 == 0 and d in seen[0]] == [] and len(seen[0]) == len(docs) - 20
    assert not any("footer line" in r["text"].split("\n") for r in spark.read.parquet(f"{tmp_path}/out1").collect())
    assert seen[1] == seen[0] and len(seen[2]) == len(set(seen[2])) and set(seen[1]) - set(seen[2]) == {300, 301, 304}
    assert 302 not in seen[3] and set(seen[2]) - set(seen[3]) == {302} and {1, 2, 303} <= set(seen[3])
    e = tokens.encoder(tokens.default_path())
    kept = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/out3").collect()}
    assert sum(r["length"] for r in df.collect()) == sum(len(e.encode([t])[0]) for t in kept.values())
    got = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in P.run(spark, str(tmp_path)).collect()}
    assert got == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect()}

