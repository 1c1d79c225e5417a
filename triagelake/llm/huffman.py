"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

Format of a file (little endian)::

    magic  8 bytes  b"TLHUFF2\\0"
    header 7 x u64  documents, tokens, vocabulary, longest code, tokens between checkpoints, bytes of checkpoints, bytes of payload
    lengths  one byte per id of the vocabulary, zlib-compressed, after its u64 size: the canonical code follows from the lengths
    ids      i64 per document; then one byte per document, 1 where the id is null
    counts   u32 per document: its tokens
    offsets  u64 per document: where its block starts in the payload, in bytes
    points   u64 per checkpoint: bit offsets in the block, one for every ``every`` tokens of a block
    payload  the blocks; a document is a block, starts at a byte and is decoded without any other

Decoding reads ``longest`` bits at a time and takes id and length from one
table; all stretches between checkpoints of a file advance together.

Cases: a null text is the empty text, whose block holds the end id alone; null
ids come first; equal ids are ordered by content; no documents, no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.arrays import long_array
from ..operators.scratch import drop, keep
from .tokens import binaries, default_path, encoder

MAGIC = b"TLHUFF2\0"


def code_lengths(counts: np.ndarray, longest: int = 16) -> np.ndarray:
    """Optimal lengths of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for leaf in reversed(is_leaf):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    per = np.bincount(lengths[order], minlength=1)
    at = 0
    for length, n in enumerate(per):
        code <<= length - last
        last = length
        if length and n:
            codes[order[at : at + n]] = code + np.arange(n, dtype=np.uint64)
            code += int(n)
        at += int(n) if length else 0
    return codes


def encode_blocks(flat: np.ndarray, count: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> list[tuple[bytes, bytes]]:
    """Checkpoints and payload of each document; ``flat`` holds their ids one after the other, ``count`` how many each has."""
    n = lengths[flat].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    first = np.cumsum(count) - count
    bits = upto[first + count] - upto[first]
    size = bits + 7 >> 3
    begin = np.cumsum(size) - size
    # Each document starts at a byte of its own.
    inside = upto[:-1] - np.repeat(upto[first], count)
    at = inside + np.repeat(8 * begin, count)
    word, off = at >> 5, (at & 31).astype(np.uint64)
    value = codes[flat] << (np.uint64(64) - off - n.astype(np.uint64))
    words = int(size.sum() + 3 >> 2) + 1
    # The codes' bits do not overlap, so that their sum is their union; 32 bits are exact in a double.
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    packed = (high[:words] + low[:words]).astype(">u4").tobytes()
    points = inside.astype("<u8")
    return [(points[f : f + c : every].tobytes(), packed[b : b + s]) for f, c, b, s in zip(first.tolist(), count.tolist(), begin.tolist(), size.tolist(), strict=True)]


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, bytes]:
    """A document's checkpoints and payload."""
    return encode_blocks(ids, np.array([len(ids)]), codes, lengths, every)[0]


def build_file(docs: list[tuple[int | None, int, bytes, bytes]], lengths: np.ndarray, every: int) -> bytes:
    """One file from (doc_id, tokens, checkpoints, payload) in order."""
    table = zlib.compress(lengths.tobytes())
    sizes = np.array([len(d[3]) for d in docs], dtype=np.uint64)
    points, payload = b"".join(d[2] for d in docs), b"".join(d[3] for d in docs)
    return b"".join([
        MAGIC,
        struct.pack("<7Q", len(docs), sum(d[1] for d in docs), len(lengths), int(lengths.max(initial=0)), every, len(points), len(payload)),
        struct.pack("<Q", len(table)), table,
        np.array([d[0] or 0 for d in docs], dtype="<i8").tobytes(),
        np.array([d[0] is None for d in docs], dtype="u1").tobytes(),
        np.array([d[1] for d in docs], dtype="<u4").tobytes(),
        (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
        points, payload,
    ])


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the longest code's bits: the id whose code starts them, and its length."""
    longest = int(lengths.max(initial=1)) or 1
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (np.uint64(longest) - lengths[used].astype(np.uint64)), kind="stable")]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << longest, dtype=np.uint32), np.ones(1 << longest, dtype=np.uint8)
    ids[: spans.sum()] = np.repeat(order.astype(np.uint32), spans)
    size[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, size


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file: id and token ids (uint32)."""
    doc_ids, counts, flat = read_flat(data)
    yield from zip(doc_ids.to_pylist(), np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True)


def read_flat(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The documents' ids, how many tokens each has, and all token ids (uint32) one after the other."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, tokens, vocab, longest, every, n_points, n_payload = struct.unpack_from("<7Q", data, 8)
    (size,) = struct.unpack_from("<Q", data, 64)
    lengths = np.frombuffer(zlib.decompress(data[72 : 72 + size]), dtype=np.uint8, count=vocab)
    at = 72 + size

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    doc_ids, null, counts, offsets = part("<i8", n), part("u1", n), part("<u4", n).astype(np.int64), part("<u8", n)
    points = part("<u8", n_points // 8).astype(np.int64)
    payload = np.frombuffer(data[at : at + n_payload] + b"\0" * 8, dtype=np.uint8)
    ids_of, size_of = decode_table(lengths)
    # A stretch for every checkpoint: its first bit, its tokens and its place in the output.
    per_doc = -(-counts // every)
    doc = np.repeat(np.arange(n), per_doc)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = np.cumsum(counts) - counts
    left = np.minimum(counts[doc] - nth * every, every)
    bit, to = offsets.astype(np.int64)[doc] * 8 + points, first[doc] + nth * every
    order = np.argsort(-left, kind="stable")
    left, bit, to = left[order], bit[order], to[order]
    out = np.zeros(tokens, dtype=np.uint32)
    wide = payload[:-3].astype(np.uint32) << np.uint32(24)
    wide |= payload[1:-2].astype(np.uint32) << np.uint32(16)
    wide |= payload[2:-1].astype(np.uint32) << np.uint32(8)
    wide |= payload[3:]
    shift, mask = np.int64(32 - longest), np.uint32((1 << longest) - 1)
    active = len(left)
    for step in range(int(left[0]) if len(left) else 0):
        while active and left[active - 1] <= step:
            active = int(np.searchsorted(-left, -step, side="left"))
        b = bit[:active]
        bits = (wide[b >> 3] >> (shift - (b & 7)).astype(np.uint32)) & mask
        out[to[:active] + step] = ids_of[bits]
        bit[:active] = b + size_of[bits]
    return pa.array(doc_ids, mask=null.astype(bool)), counts, out


def _kind(vocab: int) -> str:
    return "<u2" if vocab <= 65536 else "<u4"


def encode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids binary: uint16 or uint32, counts) of every document, each with the end id.

    A row more for each task holds nothing but ``counts``: how often it met each id, as int64.
    """
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        met = np.zeros(enc.vocab_size, dtype=np.int64)
        for batch in batches:
            flat, count = enc.encode_flat(batch["text"])
            met += np.bincount(flat, minlength=len(met))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(count, pa.int64()), binaries(flat, count, _kind(len(met))), pa.nulls(len(count), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([met.tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, counts binary")


def token_counts(encoded: DataFrame, vocab: int) -> np.ndarray:
    """How often each id stands in the corpus.  One row per id and task is shuffled, one per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for met in batch["counts"]:
                n += np.frombuffer(met.as_buffer(), dtype=np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["id", "n"])

    out = np.zeros(vocab, dtype=np.int64)
    for r in encoded.where("counts is not null").select("counts").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_files(docs: DataFrame, path: str | None = None, tokens_per_file: int = 1 << 20, every: int = 128, longest: int = 16) -> DataFrame:
    """Encode ``docs`` and make the files; returns them as (part, seq, n_tokens, data binary).

    Part and seq give the files' order, which is that of doc_id.  Files are kept
    as blobs of a table in the shared folder, so that a lost task leaves none
    half written and any store will do; :func:`save_files` leaves them as files.
    """
    path = path or default_path()
    vocab = encoder(path).vocab_size
    # Rows of one id and content are spread by the row's number.
    rows = encode_ids(docs, path).withColumn("tie", F.xxhash64("ids")).withColumn("nth", F.monotonically_increasing_id())
    encoded = keep(rows, "ids")
    lengths = code_lengths(token_counts(encoded, vocab), longest)
    packed = lengths.tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sizes, part, seq = np.frombuffer(packed, dtype=np.uint8), TaskContext.get().partitionId(), 0
        codes = canonical_codes(sizes)
        held: list = []
        n = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([build_file(held, sizes, every)], pa.binary())], ["part", "seq", "n_tokens", "data"])

        for batch in batches:
            for some in _slices(batch, tokens_per_file):
                count = some["n_tokens"].to_numpy()
                flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_kind(vocab)) for x in some["ids"]])
                for doc_id, size, block in zip(some["doc_id"].to_pylist(), count.tolist(), encode_blocks(flat, count, codes, sizes, every), strict=True):
                    if held and n + size > tokens_per_file:
                        yield flush()
                        held, n, seq = [], 0, seq + 1
                    held.append((doc_id, size, *block))
                    n += size
        if held:
            yield flush()

    ordered = encoded.where("counts is null").select("doc_id", "tie", "nth", "n_tokens", "ids").repartitionByRange("doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth")
    out = keep(ordered.select("doc_id", "n_tokens", "ids").mapInArrow(files, "part int, seq int, n_tokens bigint, data binary"), "token-files", codec="none")
    drop(encoded)
    return out


def _slices(batch: pa.RecordBatch, tokens: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many tokens, a row at least."""
    upto = np.cumsum(batch["n_tokens"].to_numpy())
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + tokens, side="right")))
        yield batch.slice(a, b - a)
        a = b


def save_files(files: DataFrame, to: str) -> DataFrame:
    """Write the blobs of :func:`write_files` as files ``<part>-<seq>.tlh`` of the folder ``to``; (name, bytes) of each.

    ``to`` is a path or a URI of any file system pyarrow knows.  A file is
    written under another name first, so that a lost task leaves no half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(to) if "://" in to or to.startswith("file:") else (fs.LocalFileSystem(), to)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for part, seq, data in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["data"], strict=True):
                name, draft = f"{part:06d}-{seq:06d}.tlh", f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(data.as_buffer())
                store.move(draft, f"{root}/{name}")
                names.append(name)
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return keep(files.select("part", "seq", "data").mapInArrow(run, "name string, bytes bigint"), "saved-files")


def load_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder that :func:`save_files` wrote, as (part, seq, n_tokens, data)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tlh").load(folder)
    number = lambda k: F.regexp_extract("path", r"([0-9]+)-([0-9]+)\.tlh$", k).cast("int")
    # The header's second number, eight bytes from the 17th on with the least first, counts the tokens.
    hexes = F.hex(F.substring("content", 17, 8))
    tokens = F.conv(F.concat(*[F.substring(hexes, 15 - 2 * k, 2) for k in range(8)]), 16, 10).cast("bigint")
    return found.select(number(1).alias("part"), number(2).alias("seq"), tokens.alias("n_tokens"), F.col("content").alias("data"))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary uint32) of every document, decoded from the files."""
    per_part = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(per_part, default=-1) + 1):
        before.append(total)
        total += per_part.get(k, 0)
    # The files' own starts come from a table without their contents.
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("part", "seq", "n_tokens").select("part", "seq", (F.coalesce(within, F.lit(0)) + F.coalesce(F.get(long_array(before), F.col("part")), F.lit(0))).alias("start"))
    placed = files.select("part", "seq", "data").join(starts, ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch["start"].to_pylist(), batch["data"], strict=True):
                doc_ids, count, flat = read_flat(data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + np.cumsum(count) - count), pa.array(count), binaries(flat, count, "<u4")], ["doc_id", "start", "n_tokens", "ids"])

    return placed.select("start", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
