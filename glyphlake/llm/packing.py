"""Packing along a space-filling curve.

Every document's token counts are hashed into a vector, projected to a few
dimensions and given a place on a Hilbert curve. The documents are range-sorted by
that place and their tokens fill sequences one after another, so a sequence holds
neighbours of the curve and is full to the last token.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import written

LENGTH = 1024
BUCKETS, DIMENSIONS, BITS = 256, 3, 16
#: Longest stretch without a blank that the fast encoder gets.
LONG_WORD = 2_000


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), by Skilling's transposition."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def place(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed count vectors (rows)."""
    v = vectors - vectors.mean(axis=1, keepdims=True)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ np.random.default_rng(9).standard_normal((BUCKETS, DIMENSIONS))
    return hilbert_key(np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * z))).astype(np.int64))


def encoder(path: str):
    """text -> ids of the byte-level tokenizer in ``path``, special tokens not added.

    Texts of Latin letters without very long words go to a faster library with
    the same vocabulary, which gives the same ids; all others to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        odd = not text.isascii() and max(text) > "ɏ"
        odd = odd or any(s in text for s in special)
        odd = odd or len(text) > LONG_WORD and max(map(len, text.split(" "))) > LONG_WORD
        return slow.encode(text, add_special_tokens=False).ids if odd else fast.encode_ordinary(text)

    return encode


def tokenise(docs: DataFrame, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, curve, ids): token ids with ``end_id`` behind, 16 bits each, and the place on the curve."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                vectors, packed = np.zeros((part.num_rows, BUCKETS)), []
                for i, text in enumerate(part.column("text")):
                    ids = np.array([*encode(text.as_py()), end_id], dtype=np.uint16)
                    vectors[i] = np.bincount(ids % BUCKETS, minlength=BUCKETS)
                    packed.append(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(place(vectors)), pa.array(packed, pa.binary())],
                    ["doc_id", "curve", "ids"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, curve bigint, ids binary")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row per piece of a document.

    ``ids`` are 16-bit little-endian. Each partition of the curve fills its own
    sequences to exactly ``length``; what is left at its end is cut into
    sequences whose lengths are powers of two, so nothing is padded. Null and
    empty texts have the end id alone. Repeated rows are packed each; equal
    texts are neighbours. Other columns are not carried. The vocabulary must
    have at most 65,536 ids.
    """
    table = written(tokenise(docs, tokenizer, end_id, doc_id, text), "tokens")
    ranged = table.repartitionByRange("curve", "doc_id", F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        open_pieces: list = []  # of the sequence that is being filled: at most ``length`` ids
        filled, schema = 0, None

        def rows(pieces, sequence):
            offset = 0
            for doc, start, ids, total in pieces:
                yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, ids.tobytes()
                offset += len(ids)

        def batch_of(out):
            types = [schema.field("doc_id").type, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays(
                list(map(pa.array, zip(*out), types)),
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            schema, out = batch.schema, []
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids, at = np.frombuffer(packed.as_py(), dtype="<u2"), 0
                while at < len(ids):
                    part = ids[at:at + length - filled]
                    open_pieces.append((doc, at, part, len(ids)))
                    at, filled = at + len(part), filled + len(part)
                    if filled == length:
                        out += rows(open_pieces, number)
                        open_pieces, filled, number = [], 0, number + 1
            if out:
                yield batch_of(out)
        out, rest = [], open_pieces[::-1]
        for size in _powers(filled):
            pieces = []
            while size:
                doc, start, ids, total = rest.pop()
                pieces.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    rest.append((doc, start + size, ids[size:], total))
                size -= len(pieces[-1][2])
            out += rows(pieces, number)
            number += 1
        if out:
            yield batch_of(out)

    kind = table.select("doc_id").schema[0].dataType.simpleString()
    return ranged.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                                  "sequence_id bigint, offset bigint, ids binary")
