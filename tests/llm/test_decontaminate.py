import random

import pandas as pd

from latticework.llm import decontaminate, queries

from .conftest import got, ordered


def infix_distance(p, t):
    """Least edit distance of p to any infix of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(docs, items):
    out = []
    for item, text in items:
        p = decontaminate.words_of(text)
        for doc, t in docs:
            w = decontaminate.words_of(t)
            if p and set(p) & set(w) and (d := infix_distance(p, w)) <= decontaminate.budget(len(p)):
                out.append((doc, item, d))
    return ordered(out)


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 9, 10, 14, 15, 25, 40, 70])]
    items += [(50, None), (51, ""), (52, " .,! "), (7, items[7][1]), (None, items[8][1])]
    docs = [(1, None), (2, ""), (3, "...")]
    for k in range(120):
        _, item = items[rng.randrange(10)]
        w = item.split()
        for _ in range(rng.randint(0, max(1, len(w) // 5))):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        docs.append((100 + k, " ".join([*(word() for _ in range(30)), *(x.upper() + "," for x in w), *(word() for _ in range(30))])))
    return docs, items


def test_planted(spark):
    docs, items = planted()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 60
    for size in (8 << 20, 200):
        assert got(decontaminate.contaminated(d, b, block_bytes=size), "doc_id", "item_id", "distance") == want
    kept = decontaminate.clean(d, b)
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {x[0] for x in want}


def test_both_ways_agree(spark, docs):
    """Items that travel and items that stay a table give the same rows: repeated documents, null ids, long texts, clashing columns."""
    texts = [r.text for r in docs.select("text").distinct().orderBy("text").collect() if r.text]
    rng = random.Random(4)
    items = []
    for i, t in enumerate(texts):
        w = t.split()
        at = rng.randrange(max(1, len(w) - 40))
        items.append((i % 50, " ".join(w[at : at + rng.randint(1, 40)])))
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    every = "doc_id", "tag", "item_id", "distance", "first_word", "last_word"
    broad = got(decontaminate.contaminated(docs, b), *every)
    assert len(broad) > 200 and {x[0] for x in broad} >= {None}
    for size in (1, 3000):
        assert got(decontaminate.contaminated(docs, b, block_bytes=size), *every) == broad
    assert decontaminate.contaminated(docs.limit(0), b, block_bytes=1).collect() == []


def test_query(spark, sf, real):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    found = got(queries.op2_decontamination(spark, sf), "doc_id", "item_id", "distance")
    docs = [*zip(real.doc_id.tolist(), real.text, strict=True)]
    held = {x[0] for x in found}
    some = [d for d in docs if d[0] in held or len(d[1]) < 1500]
    pairs = [*zip(items.item_id.tolist(), items.text, strict=True)]
    assert [x for x in found if x[0] in {d for d, _ in some}] == brute(some, pairs) == found


def test_passage_place(spark):
    d = spark.createDataFrame([(1, "zero One, two THREE four five six seven")], "doc_id long, text string")
    b = spark.createDataFrame([(5, "one two three four five")], "item_id long, text string")
    assert got(decontaminate.contaminated(d, b), "first_word", "last_word", "distance") == [(1, 6, 0)]


def test_columns_and_empty(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == len(rows) and decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.clean(empty, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).collect() == []
    assert decontaminate.clean(docs, none).columns == docs.columns


def test_myers():
    rng = random.Random(2)
    for _ in range(300):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 80))], [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert decontaminate.myers(p, t)[0] == infix_distance(p, t)
