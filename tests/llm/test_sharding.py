import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from latticework.llm import queries, sharding

from .conftest import got, ordered


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve(spark, n, bits):
    """A bijection whose neighbours on the curve differ by one step in one coordinate."""
    cells = [*product(range(1 << bits), repeat=n)]
    df = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(n)))
    out = df.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in out] == list(range(len(cells)))
    for a, b in zip(out, out[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a[:n], b[:n], strict=True)) == 1


def checked(found, pairs, n_shards=8):
    """The `rows` law, gapless slots, sizes and checksums."""
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in pairs]
    assert ordered([r[:3] for r in found]) == ordered(want)
    counts = Counter(r[3] for r in found)
    n = [counts[k] for k in range(n_shards)]
    assert set(counts) <= set(range(n_shards)) and max(n) - min(n) <= 1
    slots = defaultdict(list)
    for r in found:
        slots[r[3]].append(r[4])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_fixture(docs, rows):
    for n in (1, 8, 200):
        checked(got(sharding.hilbert_shards(docs, n), "doc_id", "size", "text_crc32", "shard", "slot"), [(r[0], r[1]) for r in rows], n)


def test_query(spark, sf, real):
    out = queries.op10_hilbert_sharding(spark, sf)
    checked(got(out, "doc_id", "size", "text_crc32", "shard", "slot"), [*zip(real.doc_id.tolist(), real.text, strict=True)])
    assert got(out.select("law", "grown_shard").distinct(), "law", "grown_shard") == [("rows", None)]


def test_curve_order(docs):
    """Shards and slots follow the curve; shards narrow the dimensions."""
    found = got(sharding.hilbert_shards(docs, 8), "shard", "slot", "hilbert")
    assert [r[2] for r in found] == sorted(r[2] for r in found)


def test_levels_of_alike_strings(spark):
    """Long common beginnings, a hot value, ties and nulls: levels follow the whole string, and each holds its share."""
    hosts = [f"https://www.a-common-beginning.example/host{k:02d}/" for k in range(50)]
    made = [(0, h) for h in hosts for _ in range(4)] + [(0, hosts[7])] * 100 + [(0, None)] * 9 + [(1, "only")] * 30
    cuts = sharding.string_cuts(spark.createDataFrame(made, "dim int, value string"), 32)
    assert cuts.get(1, []) == [] and cuts[0] == sorted(set(cuts[0])) and 18 <= len(cuts[0]) <= 31 and set(cuts[0]) <= set(hosts)
    depth = Counter(sum(c <= v for c in cuts[0]) for d, v in made if d == 0 and v)
    assert max(n for level, n in depth.items() if level != max(depth, key=depth.get)) <= 2 * 300 / 32
    docs = spark.createDataFrame([(i, "t", "en", h) for i, (d, h) in enumerate(made) if d == 0], "doc_id long, text string, lang string, source string")
    found = sharding.hilbert_shards(docs, 8).join(docs.select("doc_id", "source"), "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert sum(r.n for r in found) < 4 * 51  # not every host in every shard
    checked(got(sharding.hilbert_shards(docs, 8), "doc_id", "size", "text_crc32", "shard", "slot"), [(i, "t") for i, (d, _) in enumerate(made) if d == 0])


def test_native_and_empty(docs, empty):
    plan = sharding.hilbert_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.hilbert_shards(empty).collect() == []
