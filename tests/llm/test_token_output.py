import math
import random
import struct
from collections import defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from latticework.llm import queries, token_output

from .conftest import got, ordered

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = token_output.feistel(np.arange(n), n, 99)
    assert sorted(out.tolist()) == list(range(n))
    if n > 60:
        assert (out != np.arange(n)).mean() > 0.9 and (out != token_output.feistel(np.arange(n), n, 100)).mean() > 0.9
        assert out[5:9].tolist() == token_output.feistel(np.arange(5, 9), n, 99).tolist()


def test_shards_round_trip(spark, docs, rows, tmp_path):
    """Every document's ids come back from the files; slots are gapless; reading may start anywhere."""
    enc = token_output.tokenizer(RANKS, public_tokenizers.PATTERN)
    tokens = token_output.tokenized(docs, RANKS, public_tokenizers.PATTERN, seq_len=32)
    ordered = token_output.sequences(tokens, key=5, seq_len=32, per_shard=100)
    folder = f"file://{tmp_path}/shards"
    shards = token_output.write_shards(ordered, folder).collect()
    total = sum(s.n_records for s in shards)
    want = [(-1 if r[0] is None else r[0], [*enc.encode_ordinary(r[1] or ""), 50256]) for r in rows]
    assert total == sum(math.ceil(len(x) / 32) for _, x in want) and len(shards) == math.ceil(total / 100)
    assert sorted(s.first_slot for s in shards) == list(range(0, total, 100))
    for s in shards:
        raw = (tmp_path / "shards" / f"shard-{s.shard:06d}.bin").read_bytes()
        assert len(raw) == s.bytes == s.n_records * (16 + 64) and sha256(raw).hexdigest() == s.sha256
    assert not [p for p in (tmp_path / "shards").iterdir() if not p.name.endswith(".bin")]
    records = list(token_output.read_records(folder, 0, 10**9, seq_len=32, per_shard=100))
    assert len(records) == total
    assert records[137:140] == list(token_output.read_records(folder, 137, 3, seq_len=32, per_shard=100))
    back = defaultdict(list)
    for doc, k, _, ids in records:
        back[doc, k].append(tuple(ids))
    expect = defaultdict(list)
    for doc, ids in want:
        for k in range(0, len(ids), 32):
            expect[doc, k // 32].append(tuple(ids[k : k + 32]))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in expect.items()}


def test_query(spark, sf, real):
    out = queries.op5_token_output(spark, sf)
    found = got(out, "slot", "shard", "offset", "doc_id", "seq_no", "n_tokens")
    assert [r[0] for r in found] == list(range(len(found)))
    assert all(r[1] == r[0] // 8192 and r[2] == r[0] % 8192 * 1040 for r in found)
    assert brute([*zip(real.doc_id.tolist(), real.text, strict=True)], 512) == got(out, "doc_id", "seq_no", "n_tokens", "record_sha256")
    in_order(out.collect())


def brute(pairs, seq_len):
    """(doc_id, seq_no, n_tokens, record_sha256) of every record, made one by one."""
    enc = token_output.tokenizer(RANKS, public_tokenizers.PATTERN)
    out = []
    for doc, text in pairs:
        ids = [*enc.encode_ordinary(text or ""), 50256]
        for k in range(0, len(ids), seq_len):
            some = ids[k : k + seq_len]
            raw = struct.pack(f"<qii{seq_len}H", -1 if doc is None else doc, k // seq_len, len(some), *some, *[50256] * (seq_len - len(some)))
            out.append((doc, k // seq_len, len(some), sha256(raw).hexdigest()))
    return ordered(out)


def in_order(rows):
    """Back through the permutation, the sequences of a document follow one another."""
    at = {s: i for i, s in enumerate(token_output.feistel(np.arange(len(rows)), len(rows), queries.KEY).tolist())}
    before = (None, 0)
    for r in sorted(rows, key=lambda r: at[r.slot]):
        assert r.seq_no == 0 or (r.doc_id, r.seq_no - 1) == before
        before = (r.doc_id, r.seq_no)


def test_blank_runs(spark):
    """Runs that the tokenizer itself takes give its ids; a million blanks don't end the job."""
    enc = token_output.tokenizer(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["a b", "x", "'s", " ", "\n", "1", "#", " " * 1500, "\n" * 999, "\t \n" * 600, "\u2003" * 1200, "\x1c" * 1200, "é", ". "]) for _ in range(rng.randint(1, 12)))
        assert token_output.encode(enc, text) == enc.encode_ordinary(text)
    made = spark.createDataFrame([(1, " " * 1_000_000), (2, " " * 999_999 + "x"), (3, "a" + " \n\t" * 400_000 + "b")], "doc_id long, text string")
    out = token_output.record_digests(made, RANKS, public_tokenizers.PATTERN, queries.KEY)
    n = {r[0]: r[1] for r in out.groupBy("doc_id").sum("n_tokens").collect()}
    assert n[1] == 1_000_001 and n[2] == 1_000_000 and n[3] > 1


def test_empty(empty):
    assert token_output.record_digests(empty, RANKS, public_tokenizers.PATTERN, 1).collect() == []
