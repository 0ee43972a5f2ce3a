import pandas as pd
import pytest
import sentencepiece

import corpus_pipeline
from latticework.llm import queries

from . import test_decontaminate, test_line_dedup, test_quality, test_simhash
from .conftest import got

BLANK = test_line_dedup.BLANK


def quality(pairs):
    """Rejected documents go, and the shared lines of the others."""
    verdict = {}
    judged = test_quality.brute(pairs)
    for r in judged:
        verdict[r[0]] = r[-1]
    import re
    from collections import defaultdict

    norm = lambda x: re.sub(test_quality.BLANKS, " ", x).strip(" ").lower()
    holders = defaultdict(set)
    for d, t, s in pairs:
        for x in filter(None, map(norm, t.split("\n"))):
            holders[s, x].add(d)
    gone = {k for k, h in holders.items() if len(h) > 10}
    return [(d, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in gone), s) for d, t, s in pairs if verdict[d]]


def lines(pairs):
    from collections import defaultdict

    key = lambda line: line.strip(BLANK).translate(test_line_dedup.LOWER)
    held = defaultdict(set)
    for d, t, _ in pairs:
        for x in t.split("\n"):
            held[key(x)].add(d)
    return [(d, "\n".join(x for x in t.split("\n") if not key(x) or len(held[key(x)]) < 10), s) for d, t, s in pairs]


def copies(pairs):
    """One of each group of texts that a 5-word similarity of 0.8 links, as the stage's own rule has it."""
    kept = set(test_simhash.kept_similar([(d, t) for d, t, _ in pairs]))
    return [p for p in pairs if p[0] in kept]


@pytest.fixture(scope="module")
def want(real, sf):
    pairs = [*zip(real.doc_id.tolist(), real.text, real.source, strict=True)]
    out = [pairs]
    out.append(quality(out[-1]))
    out.append(lines(out[-1]))
    out.append(copies(out[-1]))
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    held = {x[0] for x in test_decontaminate.brute([(d, t) for d, t, _ in out[-1]], [*zip(items.item_id.tolist(), items.text, strict=True)])}
    out.append([p for p in out[-1] if p[0] not in held])
    return out


def test_run(spark, sf, want):
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    expect = {d: (library.encode(t), library.decode(library.encode(t))) for d, t, _ in want[-1]}
    assert found == expect and len(found) < len(want[0])


def test_stages(spark, sf, want):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in want[k]], docs.schema), sf)
        assert out.columns == docs.columns
        assert got(out, "doc_id", "text") == sorted((d, t) for d, t, _ in want[k + 1])
        assert all(r.n_chars in (0, len(r.text)) for r in out.collect())


def test_registered():
    assert "pipeline" in queries.QUERIES and corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, sf, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/x/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/x").collect() == []
