import random
import re

import numpy as np
import xxhash

from latticework.llm import queries, simhash

from .conftest import got, ordered

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def one(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(grams))


def brute(pairs):
    fp = [one(t) for _, t in pairs]
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(pairs):
        least.setdefault(find(i), []).append(doc)
    brute.groups = len(least)
    return [(doc, f"{fp[i]:016x}", min((d for d in least[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(pairs)]


COLUMNS = ["doc_id", "fingerprint", "component_id"]


def test_fixture(docs, rows):
    want = ordered(brute([(r[0], r[1]) for r in rows]))
    assert got(simhash.near_duplicates(docs), *COLUMNS) == want
    assert got(simhash.near_duplicates(docs, block=2), *COLUMNS) == want


def test_query(spark, sf, real):
    assert got(queries.op6_simhash(spark, sf), *COLUMNS) == ordered(brute([*zip(real.doc_id.tolist(), real.text, strict=True)]))


def test_planted_fingerprints(spark):
    """Random fingerprints with neighbours at 0 to 5 bits, and chains: components are those of all pairs."""
    rng = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for block in (2048, 3):
        found = {r.v % 2**64: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        same = {}
        for x in fps:
            same.setdefault(find(x), set()).add(found.get(x, signed(x)))
        assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_one_of_each(docs, rows):
    brute([(r[0], r[1]) for r in rows])
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [one(r.text) for r in out.select("text").collect()]
    assert len(kept) == brute.groups == len(set(kept))


def test_empty(empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def kept_similar(triples):
    """doc_ids that stay when texts of 5-word Jaccard >= 0.8 are linked, over all pairs."""

    def grams(t):
        w = (t or "").encode().translate(LOWER).split()
        return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = [grams(t) for _, t in triples]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) * 10 >= 8 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(triples):
        least.setdefault(find(i), []).append(doc)
    return [min(((d is None, d) for d in v), key=lambda x: (x[0], x[1] or 0))[1] for v in least.values()]


def test_one_of_similar(docs, rows):
    want = ordered([(d,) for d in kept_similar([(r[0], r[1]) for r in rows])])
    for block in (256, 2):
        out = simhash.one_of_similar(docs, block=block)
        assert out.columns == docs.columns
        assert got(out, "doc_id") == want


def test_similar_stage_takes_copies_of_many_bits(spark, sf):
    """Copies with edited words (5-word similarity 0.8 to 0.95) go, templates under 0.8 stay; most differ in more than three bits."""
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    made, wide = [], 0
    for i in range(40):
        text = [word() for _ in range(240)]
        made.append((2 * i, " ".join(text)))
        for k in rng.sample(range(3, 237), 1 + i % 8):
            text[k] = word()
        made.append((2 * i + 1, " ".join(text)))
        wide += (one(made[-1][1]) ^ one(made[-2][1])).bit_count() > 3
    base = [word() for _ in range(100)]
    made += [(1000 + i, " ".join(base[:80] + [word() for _ in range(20 if i % 3 else 60)])) for i in range(30)]
    want = sorted(kept_similar(made))
    assert wide > 15 and 40 < len(want) < len(made) - 20
    out = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(made, "doc_id long, text string"), sf)
    assert sorted(r.doc_id for r in out.collect()) == want


def one_of_set(text):
    """The stage's fingerprint: of the distinct 5-word shingles."""
    w = text.encode().translate(LOWER).split()
    grams = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_stage_takes_the_grid(spark, sf, monkeypatch):
    """Where bands find next to nothing, the copies within three bits still go: the grid join of the stage's fingerprints has them as candidates."""
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BANDS", 1)
    monkeypatch.setattr(simhash, "BAND_ROWS", 2000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    made = []
    for i in range(60):
        text = [word() for _ in range(300)]
        made.append((2 * i, " ".join(text)))
        for k in rng.sample(range(5, 295), 1 + i % 3):
            text[k] = word()
        made.append((2 * i + 1, " ".join(text)))
    near = [i for i in range(60) if (one_of_set(made[2 * i][1]) ^ one_of_set(made[2 * i + 1][1])).bit_count() <= 3]
    assert 15 < len(near) < 55
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = [r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, sf).collect()]
    assert sorted(found) == sorted({d for d, _ in made} - {2 * i + 1 for i in near})


def test_groups_of_prints(spark):
    """Texts share a bucket of the grid exactly where their fingerprints are linked by three bits, chains included."""
    rng = random.Random(8)
    fps = [0, 0, 2**64 - 1]
    for _ in range(40):
        fps.append(rng.getrandbits(64))
        for _ in range(4):
            x = fps[-1]
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            label[i] = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(fps)], "tag long, fp long")
    bucket = {r.tag: r.bucket for r in simhash.print_groups(df).collect()}
    assert len(bucket) == len(fps) and len(set(label)) == len(set(bucket.values())) == len({(label[i], b) for i, b in bucket.items()})


def test_similar_empty(empty):
    assert simhash.one_of_similar(empty).collect() == []
