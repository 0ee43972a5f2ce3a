"""Personal data: regular expressions propose, validators confirm, context adjusts.

DataFrame functions only.  A kind's matches and the pieces between them come from two
built-in scans of the text; running lengths of both turn them into code point positions.

Base kinds, leftmost and not overlapping within a kind: email, ip (parts at most 255),
card (12 to 19 digits, Luhn), phone (international, 9 to 15 digits).  Further kinds are
scored: a validator's verdict (IBAN: mod 97; national number: no impossible group; access
keys: letters and digits mixed) gives a
base score, words of context shortly before the span raise it, and spans that reach
`threshold` and touch no base span are added.

The expressions are those of the definition with starts and repetitions tightened so that
no text makes them backtrack: a run of name characters is tried once, from its beginning.

Defined cases: null and empty texts have no span; repeated rows and null ids stay as they
are; ties (several spans at one start) are ordered by kind; an empty table gives an empty
result; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, quoted

KINDS = ["email", "ip", "card", "phone", "iban", "national_id", "local_phone", "secret"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole chains of digits that have 12 to 19 of them; a chain of another length is no match and can't be entered midway
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,256}+(?![A-Za-z0-9_-])",
}
#: cheap conditions without which a kind has no match
GUARDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"),
    "national_id": lambda t: t.rlike(r"[0-9]-[0-9]"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "secret": lambda t: t.rlike(f"(?i){CONTEXT['secret']}"),
}
CONTEXT = {
    "email": r"mail|contact|correo|courriel|write",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|debit|tarjeta|carte|karte",
    "phone": r"tel|phone|call|fax|mobil",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "national_id": r"ssn|social|security|taxpayer|national id|insurance",
    "local_phone": r"tel|phone|call|fax|mobil|cell|whatsapp",
    "secret": r"token|secret|passw|credential|auth|api.?key|access.?key|private.?key",
}
BASE_SCORE = {"email": 80, "ip": 70, "card": 90, "phone": 70, "iban": 90, "national_id": 50, "local_phone": 40, "secret": 40}
BOOST, REACH, THRESHOLD, BLOCK = 20, 40, 60, 1024


def _running(lengths: Column) -> Column:
    """Running sums.  In blocks, so that long arrays cost no quadratic copying."""
    step = lambda acc, v: F.struct(F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"), (acc["at"] + v).alias("at"))
    start = lambda at: F.struct(F.array().cast("array<int>").alias("out"), at.alias("at"))
    scan = lambda x, at: F.aggregate(x, start(at), step, lambda a: a["out"])
    block = lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    blocks = F.sequence(F.lit(0), ((F.size(lengths) - 1) / BLOCK).cast("int"))
    bases = scan(F.transform(blocks, lambda b: total(block(b))), F.lit(0))
    return let(bases, lambda ends: F.flatten(F.transform(blocks, lambda b: scan(block(b), F.coalesce(F.get(ends, b - 1), F.lit(0))))))


def matches(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>>: code point spans of the kind's matches, and what matched."""
    pattern, none = PATTERNS[kind], F.array().cast("array<struct<s:int,e:int,m:string>>")

    def of(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(pieces, i)))
            return let(let(steps, _running), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"))))

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), placed))

    return F.when(GUARDS[kind](text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def doubled(d: Column) -> Column:
        return F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int"))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))
    )
    return total % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(c == "", acc).when(v < 58, (acc * 10 + v - 48) % 97).otherwise((acc * 100 + v - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    """The kind's validator."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        compact = F.replace(m, F.lit(" "), F.lit(""))
        return F.length(compact).between(15, 34) & mod97(compact)
    if kind == "national_id":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":  # letters and digits mixed, as no word has them
        return (F.regexp_count(m, F.lit("[0-9]")) >= 4) & (F.regexp_count(m, F.lit("[A-Za-z]")) >= 4)
    return F.lit(True)


def score(text: Column, kind: str, s: Column) -> Column:
    """The kind's score, raised by a word of its context in the REACH characters before the span."""
    before = F.lower(F.substring(text, F.greatest(s - REACH, F.lit(0)) + 1, F.least(s, F.lit(REACH))))
    return F.lit(BASE_SCORE[kind]) + F.when(before.rlike(CONTEXT[kind]), BOOST).otherwise(0)


def spans(text: Column, threshold: int = THRESHOLD) -> Column:
    """array<struct<s, k, e, score>>: all spans by start, then kind (an index into KINDS)."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: str) -> Column:
        k = KINDS.index(kind)
        good = F.filter(matches(text, kind), lambda x: valid(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), score(text, kind, x["s"]).alias("score")))

    def added(base: Column) -> Column:
        more = F.concat(*map(of, KINDS[4:]))
        more = F.filter(more, lambda x: (x["score"] >= threshold) & ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
        return F.sort_array(F.concat(base, more))

    return let(F.concat(*map(of, KINDS[:4])), added)


def find(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (s, k, e, score) for every row."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), spans(quoted(text_col), threshold).alias("found"))


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def report(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (all spans) for every row."""
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.filter("found", lambda x: x["k"] < 4)
    return find(docs, threshold, id_col, text_col).select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(F.encode(_written(base), "UTF-8"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_found"))


def redact(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; of overlapping spans the first counts."""
    text = quoted(text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"])).alias("out"), x["e"].alias("at"))
        return F.when(x["s"] < acc["at"], acc).otherwise(new)

    def applied(found: Column) -> Column:
        done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
        return let(done, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    clean = F.when(text.isNull(), text).otherwise(let(spans(text, threshold), applied))
    return docs.select(*[clean.alias(c) if c == text_col else quoted(c) for c in docs.columns])
