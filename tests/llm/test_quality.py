import re
from collections import Counter, defaultdict

from latticework.llm import quality, queries

from .conftest import got, ordered

BLANKS = "[\x20\x09-\x0d]+"
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words", "base_failed", "kept"]


def brute(triples, limit=10, percent=30):
    """The rules in plain Python; equal (doc_id, text) are one document."""
    norm = lambda x: re.sub(BLANKS, " ", x).strip(" ").lower()
    holders = defaultdict(set)
    for t in set(triples):
        for x in filter(None, map(norm, (t[1] or "").split("\n"))):
            holders[t[2], x].add(t[:2])
    gone = {k for k, h in holders.items() if len(h) > limit}
    out = []
    for doc, text, host in triples:
        text = text or ""
        w = [x for x in re.split(BLANKS, text) if x]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.sub(BLANKS, "", x)]
        removed = [x for x in map(norm, lines) if (host, x) in gone]
        less = sum(len(x.split(" ")) for x in removed)
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(removed), less, failed, not failed and 100 * (len(w) - less) >= percent * len(w)))
    return ordered(out)


def test_fixture(docs, rows):
    want = brute([(r[0], r[1], r[3]) for r in rows], limit=3)
    assert got(quality.judge(docs, line_limit=3), *COLUMNS) == want
    assert any(r[6] for r in want) and any(r[5] for r in want)


def test_query(spark, sf, real):
    want = brute([*zip(real.doc_id.tolist(), real.text, real.source, strict=True)])
    assert got(queries.op4_quality_rules(spark, sf), *COLUMNS) == want


def test_apply(docs, rows):
    want = {(r[0], r[1]) for r in brute([(r[0], r[1], r[3]) for r in rows], limit=3) if r[-1]}
    out = quality.apply_rules(docs, line_limit=3)
    assert out.columns == docs.columns
    assert out.count() == sum(r[-1] for r in brute([(r[0], r[1], r[3]) for r in rows], limit=3)) >= len(want)


def test_depleted(spark):
    """A document that is mostly boilerplate is rejected, its hosts' others keep their own lines."""
    made = [(i, f"the same navigation bar for all pages of the site here\nown line number {i} with words a{i} b{i} c{i} d{i} e{i} f{i}", "h") for i in range(12)]
    made.append((99, "the same navigation bar for all pages of the site here\nlittle", "h"))
    out = quality.apply_rules(spark.createDataFrame(made, "doc_id long, text string, source string"))
    texts = dict(got(out, "doc_id", "text"))
    assert 99 not in texts and texts[3].startswith("own line number 3") and len(texts) == 12


def test_shared_lines(spark):
    """Menu, licence and footer of distinct documents go; so do documents that hold nothing else, copies or not; at the limit nothing goes."""
    licence = " ".join(f"term{k}" for k in range(80))
    own = lambda i: "\n".join(" ".join(f"{c}{i}x{k}" for k in range(90)) for c in "ab")
    made = [(i, f"Home  News About\n{own(i)}\n{licence}\nAll rights reserved by us", "h") for i in range(40)]
    made += [(100 + i, "buy this fine thing at our shop now or never dear friend", "h") for i in range(30)] + [(200 + i, f"home news about\n{licence}", "h") for i in range(20)]
    made += [(300 + i, "ten documents hold this one line so that it has to stay", "h2") for i in range(10)]
    out = dict(got(quality.apply_rules(spark.createDataFrame(made, "doc_id long, text string, source string")), "doc_id", "text"))
    assert out == {i: own(i) for i in range(40)} | {r[0]: r[1] for r in made[-10:]}


def test_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert quality.judge(empty).collect() == [] and quality.apply_rules(empty).collect() == []
