"""Token-id output: sequences in training order as fixed-stride binary records.

Documents are encoded once (byte-level BPE, two bytes an id) and written with the number
of their sequences; a table with one row per task gives each document the global index of
its first sequence.  A keyed Feistel permutation of [0, N), closed by cycle-walking, maps
index to slot: the training order is a function of key and N alone and can be resumed
anywhere.  Slots are dealt to shards by range, sorted, and each shard is one file of
records of equal stride, so a reader seeks to slot * stride and reads on.

A record is doc_id (8 bytes), sequence number (4), tokens used (4), then seq_len ids of two
bytes, padded with the end id; all little-endian.

Defined cases: null and empty texts give one sequence that holds the end id only; a null
doc_id is written as -1; long runs of blanks are cut off before they reach the tokenizer's
regular expression, which would recurse; repeated rows are sequences of their own; an empty table gives no
record; further columns don't matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, quoted, small_batches, text_bytes

SEQ_LEN, PER_SHARD, HEADER = 512, 8192, 16


def feistel(index, n: int, key: int, rounds: int = 6):
    """The slots of an array of indices: a permutation of [0, n) that depends on key and n alone."""
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)) for r in range(rounds)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return left << shift | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= n).any():  # walk the cycle until it is back inside
        out[far] = once(out[far])
    return out.astype(np.int64)


def tokenizer(ranks: bytes, pattern: str):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: Unicode white space, in runs; the tokenizer's pattern recurses once for each character of a run
BLANK_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def encode(enc, text: str) -> list[int]:
    """The ids of a text, whatever its runs of blanks.

    A run is one token of the pattern, without its last blank where other characters follow: texts are cut
    there, and the run goes to the merges as it is.  Patterns that look back or join a blank to what stands before it don't allow this.
    """
    out, at = [], 0
    for m in BLANK_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def tokenized(docs: DataFrame, ranks: bytes, pattern: str, seq_len: int = SEQ_LEN, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table: part, first (index of the document's first sequence in its part), n_seq, doc_id, ids (two bytes each)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, tokenizer(ranks, pattern)
        for batch in small_batches(batches, limit=2 << 20):
            first, n_seq, ids = [], [], []
            for text in text_bytes(batch.column(1)):
                t = encode(enc, text.decode("utf-8", "replace"))
                t.append(end_id)
                n = -(-len(t) // seq_len)
                first.append(at)
                n_seq.append(n)
                ids.append(np.array(t, "<u2").tobytes())
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(first, pa.int64()), pa.array(n_seq, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], names=["part", "first", "n_seq", "doc_id", "ids"])

    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col))
    return materialize(own.mapInArrow(run, "part int, first long, n_seq int, doc_id long, ids binary"), "tokens")


def sequences(tokens: DataFrame, key: int, seq_len: int = SEQ_LEN, end_id: int = 50256, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, doc_id, seq_no, n_tokens, record: range-partitioned by slot and sorted."""
    parts = tokens.groupBy("part").agg(F.sum("n_seq").alias("n"))  # one row per task
    total = parts.agg(F.sum("n")).first()[0] or 0
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = tokens.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("before")).alias("index"), "doc_id", "ids")

    def run(batches: Iterator) -> Iterator:
        import struct

        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches, column=2, limit=2 << 20):
            index, head, ids, n, records = [], [], [], [], []
            for at, doc_id, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.frombuffer(blob, "<u2")
                for k, a in enumerate(range(0, len(t), seq_len)):
                    piece = t[a : a + seq_len]
                    pad = np.full(seq_len, end_id, "<u2")
                    pad[: len(piece)] = piece
                    index.append(at + k)
                    head.append(k)
                    ids.append(doc_id)
                    n.append(len(piece))
                    records.append(struct.pack("<qii", -1 if doc_id is None else doc_id, k, len(piece)) + pad.tobytes())
            slot = feistel(np.array(index), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard, pa.int32()), pa.array(ids, pa.int64()), pa.array(head, pa.int32()), pa.array(n, pa.int32()), pa.array(records, pa.binary())], names=["slot", "shard", "doc_id", "seq_no", "n_tokens", "record"])

    out = placed.mapInArrow(run, "slot long, shard int, doc_id long, seq_no int, n_tokens int, record binary")
    return out.repartitionById(max(1, -(-total // per_shard)), "shard").sortWithinPartitions("slot")


def _store(folder: str):
    """File system and path of a folder: local, or any store that Arrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes shard-NNNNNN.bin into folder, which all executors share; gives shard, first_slot, n_records, bytes, sha256.

    A file appears by one rename when it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import uuid

        import pyarrow as pa

        out, sha, n, size, first, shard = None, hashlib.sha256(), 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                first, shard = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/shard-{shard:06d}.bin"
                temp = f"{name}.{uuid.uuid4().hex}"
                out = store.open_output_stream(temp)
            for record in batch.column(5).to_pylist():
                out.write(record)
                sha.update(record)
                n, size = n + 1, size + len(record)
        if out is not None:
            out.close()
            store.move(temp, name)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": first, "n_records": n, "bytes": size, "sha256": sha.hexdigest()}], pa.schema([("shard", pa.int32()), ("first_slot", pa.int64()), ("n_records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return ordered.mapInArrow(run, "shard int, first_slot long, n_records long, bytes long, sha256 string")


def read_records(folder: str, slot: int, count: int, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> Iterator[tuple[int, int, int, list[int]]]:
    """(doc_id, sequence number, tokens used, ids) of `count` records from `slot` on: seeks once per shard, then reads on."""
    import struct

    stride = HEADER + 2 * seq_len
    store, root = _store(folder)
    while count > 0:
        shard, inside = divmod(slot, per_shard)
        try:
            f = store.open_input_file(f"{root}/shard-{shard:06d}.bin")
        except FileNotFoundError:
            return
        with f:
            f.seek(inside * stride)
            while count > 0 and len(raw := f.read(stride)) == stride:
                doc_id, k, n = struct.unpack_from("<qii", raw)
                yield doc_id, k, n, [*struct.unpack_from(f"<{n}H", raw, HEADER)]
                slot, count = slot + 1, count - 1
        if slot // per_shard == shard:  # the last shard, which is not full
            return


def record_digests(docs: DataFrame, ranks: bytes, pattern: str, key: int, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> DataFrame:
    """slot, shard, offset (bytes into the shard), doc_id, seq_no, n_tokens, record_sha256: every record of the materialised order."""
    rows = sequences(tokenized(docs, ranks, pattern, seq_len), key, seq_len, per_shard=per_shard)
    offset = (F.col("slot") % per_shard) * (HEADER + 2 * seq_len)
    return rows.select("slot", "shard", offset.alias("offset"), "doc_id", "seq_no", "n_tokens", F.sha2("record", 256).alias("record_sha256"))
