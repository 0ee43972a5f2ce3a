from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from latticework.llm import queries, sentencepiece_codec

from .conftest import got, ordered

PATH = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(library, pairs):
    sha = lambda s: sha256(s.encode()).hexdigest()
    return ordered([(d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for d, t in pairs for ids in [library.encode(t or "")]])


def test_fixture(library, docs, rows):
    assert got(sentencepiece_codec.token_digests(docs, sentencepiece_codec.load_model(PATH)), *COLUMNS) == brute(library, [(r[0], r[1]) for r in rows])


def test_query(spark, sf, real, library):
    assert got(queries.op9_sentencepiece(spark, sf), *COLUMNS) == brute(library, zip(real.doc_id.tolist(), real.text, strict=True))


def by_pieces(library, raw):
    """Spans from the library's pieces alone: a mark stands before the text, and for each of its spaces."""
    norm = b"\xe2\x96\x81" + raw.replace(b" ", b"\xe2\x96\x81")
    origin = [0, 0, 0]
    for k, c in enumerate(raw):
        origin += [k] * (3 if c == 32 else 1)
    origin.append(len(raw))
    out, at = [], 0
    for i in library.encode(raw.decode()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            a, b = at, at + 1
            while norm[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(norm) and norm[b] & 0xC0 == 0x80:
                b += 1
            at += 1
        else:
            a, b = at, at + len(piece.encode())
            at = b
        out.append((i, origin[a], origin[b]))
    return out


def test_spans(library, rows):
    """Spans are those of a walk over the library's pieces, follow each other, and cover the text."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_model(PATH))
    for text in {r[1] or "" for r in rows}:
        raw = text.encode()
        walked = codec.spans(raw)
        assert walked == by_pieces(library, raw) and [x[0] for x in walked] == library.encode(text)
        at = 0
        for i, a, b in walked:
            assert a <= at <= b and (a == at or codec.sizes[i] == 0)
            piece = library.id_to_piece(i)
            if not piece.startswith("<0x"):
                assert piece.replace("▁", " ").encode().lstrip(b" ") == raw[a:b].lstrip(b" ")
            at = b
        assert at == len(raw)


def mapped_model():
    """The model with a character map of the usual kind: its own trie with four rules, and squeezed blanks."""
    import struct

    rules = {b"A": b"a", "é".encode(): b"e", b"\t": b" ", "ﬁ".encode(): b"fi"}
    strings, offsets = b"", {}
    for k, v in rules.items():
        offsets[k] = len(strings)
        strings += v + b"\0"
    # a double array by hand: each node's children lie at base ^ byte
    units, used = {0: 0}, {0}
    children = lambda p: sorted({k[len(p)] for k in rules if k.startswith(p) and len(k) > len(p)})

    def place(prefix, at, base_from):
        kids, leaf = children(prefix), prefix in rules
        base = next(b for b in range(base_from, 1 << 20) if all((b ^ c) not in used for c in [*kids, *[0] * leaf]) and not (b & 0x1FF00000))
        used.update(b for b in [*(base ^ c for c in kids), *([base] if leaf else [])])
        units[at] = (units.get(at, 0) & 0xFF) | (leaf << 8) | ((base ^ at) << 10)
        if leaf:
            units[base] = (1 << 31) | offsets[prefix]
        for c in kids:
            units[base ^ c] = c
        for c in kids:
            place(prefix + bytes([c]), base ^ c, 256)

    place(b"", 0, 256)
    size = (max(units) | 255) + 1
    trie = struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])
    m = pb.ModelProto()
    m.ParseFromString(sentencepiece_codec.load_model(PATH))
    m.normalizer_spec.precompiled_charsmap = struct.pack("<I", len(trie)) + trie + strings
    m.normalizer_spec.remove_extra_whitespaces = True
    return m.SerializeToString()


def test_character_map(rows):
    """A model that rewrites characters: ids are the library's, spans point into the original bytes."""
    model = mapped_model()
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    hard = ["", "  ", " A\tA  éA ﬁn  ", "éééA", "ﬁﬁ", "a\t\tb", "日本 ﬁ é", *{r[1] or "" for r in rows}]
    for text in hard:
        ids = library.encode(text)
        assert codec.encode(text.encode())[0] == ids
        assert [x[0] for x in codec.spans(text.encode())] == ids
    assert [(a, b) for _, a, b in codec.spans("xé ﬁ".encode())][-1][1] == len("xé ﬁ".encode())


def test_documents(docs, empty, rows):
    model = sentencepiece_codec.load_model(PATH)
    out = sentencepiece_codec.encode_documents(docs, model)
    assert out.columns == ["doc_id", "ids", "decoded", "starts", "ends"] and out.count() == len(rows)
    assert out.where("size(ids) <> size(starts) or size(ids) <> size(ends)").count() == 0
    assert sentencepiece_codec.encode_documents(empty, model).collect() == [] and sentencepiece_codec.token_digests(empty, model).collect() == []


def test_a_worker_holds_little(spark, library):
    """Of a large batch only a small slice's ids and spans are held at once; peak measured after the codec's own tables are built."""
    import tracemalloc

    import pyarrow as pa

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [f"{i} " + "some words of a text, with 12 numbers; " * 100 for i in range(1200)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    run = sentencepiece_codec.encode_documents(Docs(), sentencepiece_codec.load_model(PATH))
    steps = run(iter([batch]))
    next(steps)
    tracemalloc.start()
    for _ in steps:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6, peak
    out = pa.Table.from_batches(run(iter([batch])))
    want = [library.encode(t or "") for t in texts]
    assert out["ids"].to_pylist() == want and out["decoded"].to_pylist() == [*map(library.decode, want)]
    assert out["doc_id"].to_pylist() == [*range(len(texts))] and [*map(len, out["ends"].to_pylist())] == [*map(len, want)]


def test_own_merges(library, rows):
    """Without the library's help the words' own merges give its ids too."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_model(PATH))
    codec.same = False
    for text in {r[1] or "" for r in rows}:
        assert codec.spans(text.encode()) == by_pieces(library, text.encode())
