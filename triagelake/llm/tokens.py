"""Encoding with a public tokenizer file, many words at a time.

The tokenizer file cuts a text into words before it looks at anything else, so
a text's ids are its words' ids one after the other.  Texts of plain characters
are cut here; each distinct stretch without white space of a batch is encoded
once, and the merges of all its words are made together, by array operations.
Every other text goes to the library whole, as do words of unusual length.
Tests hold all ways against the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The id that ends each document.
END = 1
#: The characters whose handling (lower case, composition, white
#: space) is the same here and in the library, and the words cut from them.
PLAIN = "[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff–—‘’“”…]"
NOT_PLAIN = PLAIN.replace("[", "[^", 1)
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xe0-\xf6\xf8-\xff\xdf]+|[0-9]|[^\\sa-z\xe0-\xf6\xf8-\xff\xdf0-9]+")
RULES = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", ["NFC", "Replace", "Lowercase"], "</w>")
NONE = np.int32(1 << 30)


class Merges:
    """The ranks of pairs of symbols, in a table with open addressing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, vocab: int) -> None:
        """``pairs``: two symbols for each rank; ``merged``: what they become."""
        # A pair is one number; of a small vocabulary 32 bits hold it and the mark of a free slot.
        self.kind, self.golden = (np.uint32, np.uint32(0x9E3779B1)) if vocab < 65536 else (np.uint64, np.uint64(0x9E3779B97F4A7C15))
        self.vocab, self.free, self.merged = self.kind(vocab), self.kind(np.iinfo(self.kind).max), merged.astype(np.int32)
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, self.free, dtype=self.kind)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        key, rank = pairs[:, 0].astype(self.kind) * self.vocab + pairs[:, 1].astype(self.kind), np.arange(len(pairs), dtype=np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == self.free
            # Of several keys for one free slot the last written has it.
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.ranks[slot[placed]] = rank[placed]
            key, rank, slot = key[~placed], rank[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * self.golden) >> self.kind(8 * key.itemsize - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, :data:`NONE` where it has none."""
        key = a.astype(self.kind) * self.vocab + b.astype(self.kind)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], NONE)
        on = np.flatnonzero((held != key) & (held != self.free))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[on]]
            found = held == key[on]
            out[on[found]] = self.ranks[slot[on[found]]]
            on = on[~found & (held != self.free)]
        return out

    def apply(self, sym: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merges of many words, whose symbols stand one after the other; ``last`` marks each word's last one.

        Returns the symbols that remain, and how many each word has.  A round
        makes the best merge of every word, wherever the word has it.
        """
        n_words = int(last.sum())
        count = np.zeros(n_words, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.arange(n_words)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(word):
            ends = np.flatnonzero(last)
            size = np.diff(ends, prepend=-1)
            best = np.minimum.reduceat(rank, ends - size + 1)
            on = best < NONE
            if not on.all():
                here = np.repeat(on, size)
                count[word[~on]] = size[~on]
                done.append((word[~on], sym[~here]))
                sym, last, rank, word, size, best = sym[here], last[here], rank[here], word[on], size[on], best[on]
                if not len(word):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # A pair of equal symbols can overlap itself: from the left, every second one counts.
            first = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, hit, 0))
            hit = hit[(hit - first) & 1 == 0]
            sym[hit] = self.merged[rank[hit]]
            last[hit] = last[hit + 1]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            sym, last, rank = sym[stay], last[stay], rank[stay]
            hit = hit - np.arange(len(hit))
            rank[hit] = NONE
            near = np.concatenate([hit, hit[hit > 0] - 1])
            near = near[~last[near]]
            rank[near] = self.rank(sym[near], sym[near + 1])
        starts = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), dtype=np.int32)
        for words, symbols in done:
            n = count[words]
            out[np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, count


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """``encode`` gives each text's ids with :data:`END` appended, as uint32 arrays; ``encode_flat`` all in one.

    Strings of special tokens in a text are ordinary text.  ``chunk`` bounds the
    characters and ``longest`` the bytes of a word that are handled at a time.
    """

    def __init__(self, path: str, chunk: int = 16_000_000, longest: int = 64) -> None:
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.vocab_size = self.library.get_vocab_size()
        self.chunk, self.longest = chunk, longest
        # The library's byte alphabet: bytes that print stand for themselves, the others follow from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: b if b in shown else 256 + hidden.index(b) for b in range(256)}
        self.by_word = self._known(rules)
        if self.by_word:
            vocab = rules["model"]["vocab"]
            pairs = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
            ranked = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], dtype=np.int64).reshape(-1, 3)
            self.merges = Merges(ranked[:, :2], ranked[:, 2], max(vocab.values()) + 1)
            self.inner = np.array([vocab[chr(self.alphabet[b])] for b in range(256)], dtype=np.int32)
            self.final = np.array([vocab[chr(self.alphabet[b]) + RULES[2]] for b in range(256)], dtype=np.int32)
        # What a byte of lower-cased plain text belongs to: 1 letters, 2 digits, 0 signs.
        self.kind = np.zeros(256, dtype=np.int8)
        self.kind[[*range(97, 123), 0xC3]] = 1
        self.kind[48:58] = 2

    def _known(self, rules: dict) -> bool:
        """Whether the file cuts texts by the rules that :data:`WORDS` states, and merges bytes by rank alone."""
        try:
            cut, model = rules["pre_tokenizer"]["pretokenizers"], rules["model"]
            same = (cut[0]["pattern"]["Regex"], [n["type"] for n in rules["normalizer"]["normalizers"]], model["end_of_word_suffix"]) == RULES and len(cut) == 2 and cut[0]["invert"]
            plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
            return same and plain and all(chr(c) + end in model["vocab"] for c in self.alphabet.values() for end in ("", RULES[2]))
        except (KeyError, TypeError, IndexError):
            return False

    def _starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where words start in stretches that lie one after the other: ``raw`` their bytes, ``off`` their bounds."""
        kind = self.kind[raw]
        inside = (raw & 0xC0) == 0x80
        if inside.any():
            kind = kind[np.maximum.accumulate(np.where(inside, 0, np.arange(len(raw))))]
        begins = np.empty(len(raw), dtype=bool)
        begins[:1] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins[off[:-1][np.diff(off) > 0]] = True
        # Apostrophes start some words of their own.
        marked = np.unique(np.searchsorted(off, np.flatnonzero(raw == 39), side="right") - 1)
        for a, b in zip(off[marked].tolist(), off[marked + 1].tolist(), strict=True):
            text = raw[a:b].tobytes().decode()
            begins[a:b] = False
            begins[[a + len(text[: m.start()].encode()) for m in WORDS.finditer(text)]] = True
        return np.flatnonzero(begins)

    def _stretches(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``stretches`` one after the other, and how many each has."""
        off = np.frombuffer(stretches.buffers()[1], dtype=np.int32, count=len(stretches) + 1, offset=4 * stretches.offset).astype(np.int64)
        count = np.zeros(len(stretches), dtype=np.int64)
        if off[-1] == off[0]:
            return np.zeros(0, dtype=np.int32), count
        raw = np.frombuffer(stretches.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        starts = self._starts(raw, off)
        size = np.diff(starts, append=len(raw))
        last = np.zeros(len(raw), dtype=bool)
        last[starts[1:] - 1] = last[-1] = True
        sym = np.where(last, self.final[raw], self.inner[raw])
        long = np.flatnonzero(size > self.longest)
        if len(long):
            here = np.repeat(size <= self.longest, size)
            some, n = self.merges.apply(sym[here], last[here])
            each = np.split(some, np.cumsum(n)[:-1]) if len(n) else []
            for k in long:
                word = raw[starts[k] : starts[k] + size[k]].tobytes().decode("latin-1").translate(self.alphabet)
                each.insert(k, np.array([t.id for t in self.model.tokenize(word)], dtype=np.int32))
            ids, per_word = np.concatenate(each), np.array([len(e) for e in each])
        else:
            ids, per_word = self.merges.apply(sym, last)
        np.add.at(count, np.searchsorted(off, starts, side="right") - 1, per_word)
        return ids, count

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain texts, each with the end id, and how many each has."""
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        ids, n = self._stretches(coded.dictionary)
        which = coded.indices.to_numpy()
        per = n[which]
        upto = np.concatenate([[0], np.cumsum(per)])
        # Where each id of the texts stands among the distinct stretches' ids.
        narrow = np.int32 if upto[-1] + len(ids) < 1 << 31 else np.int64
        place = np.repeat(((np.cumsum(n) - n)[which] - upto[:-1]).astype(narrow), per)
        place += np.arange(upto[-1], dtype=narrow)
        ends = upto[bounds - bounds[0]]
        return np.insert(ids[place].astype(np.uint32), ends[1:], END), np.diff(ends) + 1

    def _chunks(self, texts: pa.Array) -> Iterator[pa.Array]:
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + self.chunk, side="right")))
            yield texts.slice(a, b - a)
            a = b

    def _one(self, text: str) -> np.ndarray:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, END], dtype=np.uint32)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` one after the other (uint32), and how many each has; a null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        flat, count = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        for part in self._chunks(texts):
            other = pc.match_substring_regex(part, NOT_PLAIN).to_numpy(zero_copy_only=False).astype(bool) if self.by_word else np.ones(len(part), dtype=bool)
            if other.any():
                ids, n = self._plain(part.filter(pa.array(~other))) if not other.all() else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
                plain = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
                each = [self._one(part[k].as_py()) if other[k] else next(plain) for k in range(len(part))]
                flat.extend(each)
                count.append(np.array([len(e) for e in each], dtype=np.int64))
            else:
                ids, n = self._plain(part)
                flat.append(ids)
                count.append(n)
        return np.concatenate(flat), np.concatenate(count)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        flat, count = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(count)[:-1]) if len(count) else []


def binaries(flat: np.ndarray, count: np.ndarray, kind: str) -> pa.Array:
    """A binary array of the stretches of ``flat`` that ``count`` gives, as numbers of ``kind``."""
    data = np.ascontiguousarray(flat.astype(kind, copy=False))
    ends = np.concatenate([[0], np.cumsum(count)]) * data.itemsize
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of ids in one batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This process's encoder for a file."""
    return Encoder(path)
