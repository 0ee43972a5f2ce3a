import random

import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, keep int, spans string, words int, half int"


def texts():
    """Texts with every hard case: null, empty, blanks only, long, ties, copies, near copies, shared lines and passages, personal data."""
    rng = random.Random(7)
    vocabulary = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    lines = lambda n: "\n".join(some(rng.randint(3, 14)) for _ in range(n))
    out = [None, None, "", "", " \t\n\x0b\x0c\r ", "\n", "a", "A\n a \nA\n\n", "one two", "İstanbul ŞIK Straße ÀÉ x y", "𝄞𝄞 日本語 中文 é́", "x" * 30_000, "y z " * 9_000]
    out += [lines(rng.randint(2, 12)) for _ in range(60)]
    out += ["Footer  Line of the Host\n" + lines(4) + f"\n  SHARED {'footer'} \t" for _ in range(25)]
    copy = lines(12)
    out += [copy] * 20 + [copy.replace("w", "W", 1), copy + " extra", copy[:-5], "z" + copy]
    passage = some(110)
    out += [some(20) + " " + passage + " " + some(20) for _ in range(6)] + [passage[:450] + some(30), passage[7:] + "!"]
    out += [some(9), some(10), some(11), some(6) + " " + " ".join([some(7)] * 4)]
    out += [
        "mail a.b@c.de, x@y, a@b.co_d@e.f.g a@b.co.@x.y @@ +a%b-c@d-e.f-g.h1. ip 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255 1.2.3 9.9.9.9",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111 0000 0000 0000 1 5500-0000 0000-0004x 12 34 56",
        "call +49 (0)30 1234-5678. or +1.2 ... +1 +123456789012345678 +44 20 7946 0958; tel 555-123-4567 ++123 456 7890",
        "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 my ssn: 123-45-6789 000-12-3456 bank DE00370400440532013000 a@1.1.1.1",
        "😀 +49 30 12345678 é 10.0.0.1",
    ]
    return out


@pytest.fixture(scope="session")
def rows():
    """Documents with a hot source, null ids and sources, ids used twice, and rows repeated whole."""
    out = []
    for i, text in enumerate(texts()):
        doc_id = None if i in (1, 30) else 20 if i in (21, 22) else 1000 - i
        out.append((doc_id, text, "en" if i % 4 else None, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"host{i % 5}", len(text or ""), "clash", i, "clash", 1, 2))
    return [*out, out[15], out[15], out[40]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def got(df, *columns):
    """Rows as a sorted list of tuples, nulls first."""
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])


def ordered(found):
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])
