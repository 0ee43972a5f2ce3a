import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from latticework.llm import queries, suffix_dedup

from .conftest import got, ordered

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]



def passages(pairs, words):
    """Whether a window of so many words stands in a row of another id or text too."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in pairs]
    holders = defaultdict(set)
    for pair, w in zip(pairs, split, strict=True):
        for i in range(len(w) - words + 1):
            holders[tuple(w[i : i + words])].add(pair)
    return ordered([(doc, len((t or "").encode()), any(len(holders[tuple(w[i : i + words])]) > 1 for i in range(len(w) - words + 1))) for (doc, t), w in zip(pairs, split, strict=True)])


def brute(pairs, length):
    texts = [(t or "").encode() for _, t in pairs]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(pairs, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), sum(gone), spans, sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return ordered(out)


def hits(df):
    return ordered([(r.doc_id, r.n_bytes, r.passage_hits > 0) for r in df.collect()])


@pytest.mark.parametrize("length", [400, 64])
def test_fixture(docs, rows, length):
    want = brute([(r[0], r[1]) for r in rows], length)
    assert got(suffix_dedup.repeat_digests(docs, length=length), *COLUMNS) == want
    assert sum(r[3] > 0 for r in want) > 20


@pytest.mark.parametrize(("crowd", "heavy"), [(2, 8192), (256, 8192), (2, 10), (256, 1)])
def test_many_contents(spark, crowd, heavy):
    """One passage in many surroundings, cut at every length; periodic texts; near copies."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = word(150)
    pairs = [(i, word(rng.randint(0, 90)) + passage[rng.randint(0, 60) : 150 - rng.randint(0, 60)] + word(rng.randint(0, 90))) for i in range(60)]
    pairs += [(100, "ab" * 100), (101, "ab" * 40), (102, "x" * 300), (103, "x" * 63), (104, "x" * 64), (105, passage), (106, passage)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert got(suffix_dedup.repeat_digests(df, length=64, crowd=crowd, heavy=heavy, batch_bytes=500), *COLUMNS) == brute(pairs, 64)


def test_query(spark, sf, real):
    pairs = [*zip(real.doc_id.tolist(), real.text, strict=True)]
    out = queries.op3_suffix_dedup(spark, sf).cache()
    assert got(out, *COLUMNS) == brute(pairs, 400) and hits(out) == passages(pairs, 50)


@pytest.mark.parametrize("words", [16, 50])
def test_passages(spark, docs, rows, words):
    """Passages shorter than `length` bytes, in other surroundings and between other blanks; near copies; a text that repeats only itself."""
    pairs = [(r[0], r[1]) for r in rows]
    assert hits(suffix_dedup.repeat_digests(docs, words=words)) == passages(pairs, words)
    rng = random.Random(11)
    some = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n)]
    shared = [some(words + rng.randint(-2, 25)) for _ in range(12)]
    pairs = [(i, rng.choice([" ", "\n", " \t", "\r\n "]).join([*some(rng.randint(0, 90)), *rng.choice(shared), *some(rng.randint(0, 90))])) for i in range(60)]
    pairs += [(70, " ".join(shared[0][:words] * 4)), (71, " ".join(["k"] * 200)), (72, " ".join(["k"] * 20)), (73, "k " * words), (74, "z" * 3000 + " " + " ".join(shared[1])), (75, "z" * 3000)]
    want = passages(pairs, words)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    assert hits(suffix_dedup.repeat_digests(df, words=words)) == want and 20 < sum(r[2] for r in want) < 66


def test_kept_bytes(docs, rows):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "kept_bytes"] and out.count() == len(rows)
    assert {sha256(r.kept_bytes or b"").hexdigest() for r in out.select("kept_bytes").collect()} == {r[4] for r in brute([(r[0], r[1]) for r in rows], 400)}


def test_empty(empty):
    assert suffix_dedup.repeat_digests(empty).collect() == [] and suffix_dedup.remove_repeats(empty).collect() == []
