"""SentencePiece encoding and decoding with offsets into the original bytes.

Normalisation walks the text by longest prefixes of the model's compiled character
map (a double-array trie) and records, for every normalised byte, the original byte
it came from; what lies between the bytes that can begin a rule is copied as a whole.
The normalised text is cut into words that no piece of the vocabulary can cross; each
distinct word is merged once, by the model's own scores, and kept in a bounded cache (a
model without rules leaves merging to the library, which gives the same ids faster).
Every piece is projected through the recorded alignment to a span of original bytes;
byte-fallback pieces share the span of their character.

Ids equal those of the sentencepiece library for BPE models (no begin or end ids, no
sampling); decoding is the library's own decode(ids).

Defined cases: a null text is empty; an empty text has no ids and decodes to "";
very long texts are handled word by word; repeated rows and further columns pass; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import DataFrame


from .common import quoted, small_batches, text_bytes

SPACE = "▁"
CACHE_WORDS = 400_000
#: bytes of text whose ids and spans a worker holds at once
SLICE = 256 << 10


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def heads(self) -> set[int]:
        """The bytes that begin a rule; rules begin where characters do."""
        if not self.units:
            return set()
        base = (self.units[0] >> 10) << ((self.units[0] & (1 << 9)) >> 6)
        return {c for c in range(1, 256) if c & 0xC0 != 0x80 and base ^ c < len(self.units) and self.units[base ^ c] & ((1 << 31) | 0xFF) == c}

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """(length, offset of the replacement) of the longest prefix of text[at:] in the map."""
        if not self.units:
            return None
        units, found = self.units, None
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            c = text[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = (i - at + 1, units[node] & ((1 << 31) - 1))
        return found

    def replacement(self, offset: int) -> bytes:
        return self.strings[offset : self.strings.index(b"\0", offset)]


@dataclass
class Codec:
    """One model, ready to encode; cheap enough to build once per task."""

    model: bytes
    cache: dict = field(default_factory=dict)

    def __post_init__(self):
        import re

        import numpy as np
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(self.model)
        if m.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        n = m.normalizer_spec
        self.charmap = CharMap(n.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = m.trainer_spec.treat_whitespace_as_suffix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.ids, self.scores, self.user, self.bytes_, self.unk = {}, {}, [], {}, 0
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.bytes_[int(p.piece[3:5], 16)] = i
            elif p.type in (1, 4, 5):
                self.ids.setdefault(p.piece, i)
                self.scores[p.piece] = p.score
                if p.type == 4:
                    self.user.append(p.piece)
            elif p.type == 2:
                self.unk = i
        self.sizes = [len(p.piece.encode()) if p.type in (1, 4, 5) else 0 for p in m.pieces]
        self.widths = np.array(self.sizes)
        self.decimal = [*map(str, range(len(m.pieces)))]
        self.first = [p.piece.startswith(SPACE) for p in m.pieces]
        self.unused = {p.piece for p in m.pieces if p.type == 5}
        self.user.sort(key=len, reverse=True)
        heads = self.charmap.heads() | {u.encode()[0] for u in self.user}
        # a rule can begin at these bytes and nowhere else
        self.heads = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in sorted(heads)) + b"]") if heads else None
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids) or self.user or self.unused or self.suffix or not self.escape
        self.same = not self.heads and not self.squeeze and self.dummy and not crossing
        # a word: a run of spaces with what follows it; no piece joins a letter to a space after it
        self.words = None if crossing else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    # -- normalisation -----------------------------------------------------
    def walk(self, text: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
        """(normalised, from, to, whether copied): the longest rule wherever one begins, and what lies between."""
        at, copied, n = 0, 0, len(text)
        users = [*map(str.encode, self.user)]
        while at < n:
            m = self.heads.search(text, at) if self.heads else None
            if not m:
                break
            at = m.start()
            user = next((u for u in users if text.startswith(u, at)), None)
            hit = None if user else self.charmap.longest(text, at)
            if not user and not hit:  # a character that no rule covers
                b = text[at]
                at += 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                continue
            if copied < at:
                yield text[copied:at], copied, at, True
            end = at + (len(user) if user else hit[0])
            yield user or self.charmap.replacement(hit[1]), at, end, False
            at = copied = end
        if copied < n:
            yield text[copied:], copied, n, True

    def normalize(self, text: bytes):
        """Normalised bytes and, as an array, for each of them and for the end the original byte it starts from."""
        import re

        import numpy as np

        steps = self.walk(text)
        if self.squeeze:  # blanks by themselves, as they may go
            cut = ((x, a, b, c, [*re.finditer(rb"[^ ]+| ", x)] if c else None) for x, a, b, c in steps)
            steps = ((m[0], a + m.start(), a + m.end(), True) if m else (x, a, b, c) for x, a, b, c, ms in cut for m in (ms or [None]))
        out, aligns = [], []
        space = SPACE.encode() if self.escape else b" "

        def add(piece: bytes, origin: int, copied: bool) -> None:
            if not copied:
                new = piece.replace(b" ", space)
                out.append(new)
                aligns.append(np.full(len(new), origin, np.int32))
                return
            out.append(piece.replace(b" ", space))
            own = np.arange(origin, origin + len(piece), dtype=np.int32)
            if len(out[-1]) > len(piece):
                own = np.repeat(own, np.where(np.frombuffer(piece, np.uint8) == 32, len(space), 1))
            aligns.append(own)

        begun, after_space, end = False, self.squeeze, 0
        for piece, a, b, copied in steps:
            if not begun:
                if self.squeeze and piece == b" ":
                    continue
                begun = True
                if self.dummy and not self.suffix:
                    add(b" ", a, False)
            if self.squeeze and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                add(piece, a, copied)
                after_space = self.squeeze and piece.endswith(b" ")
            end = b
        if not begun:
            return b"", np.array([len(text)], np.int32)
        norm, align = b"".join(out), np.concatenate(aligns)
        if self.squeeze:
            while norm.endswith(space):
                norm = norm[: -len(space)]
                end = int(align[len(norm)])
            align = align[: len(norm)]
        if self.dummy and self.suffix:
            norm, align = norm + space, np.r_[align, np.full(len(space), end, np.int32)]
        return norm, np.r_[align, np.int32(end)]

    # -- encoding ----------------------------------------------------------
    def _merge(self, word: str) -> list[str]:
        """BPE: again and again the neighbours whose union has the best score, the leftmost among equals."""
        scores = self.scores
        parts: list[str | None] = list(word)
        if len(parts) < 2:
            return list(word)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(-scores[parts[i] + parts[i + 1]], i, len(parts[i] + parts[i + 1])) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[j] is None or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0:
                    union = parts[a] + parts[b]
                    if union in scores:
                        heapq.heappush(heap, (-scores[union], a, len(union)))
        return [p for p in parts if p is not None]

    def _ids(self, word: str) -> list[int]:
        """ids of a word by our own merges; characters without a piece fall back to bytes."""
        out: list[int] = []
        for piece in self._merge(word):
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unk]
        return out

    def learn(self, words: list[str]) -> None:
        """Put the words that the cache lacks into it, ids and the same in decimal."""
        new = [w for w in dict.fromkeys(words) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = [*dict.fromkeys(words)]
        for w in new:
            ids = self._ids(w)
            self.cache[w] = (ids, ",".join(map(str, ids)))

    def _merged(self, norm: bytes, text: bytes) -> tuple[list[int], str]:
        """The ids of a normalised text, and the same in decimal joined by commas.

        The library takes no normalised text.  Where no rule can apply it makes of the text itself what walk() makes of it,
        and merges many times faster than Python; else distinct words are merged here, once each.
        """
        if self.same:
            ids = self.library.encode(text.decode("utf-8", "replace"))
            decimal = self.decimal
            return ids, ",".join([decimal[i] for i in ids])
        words = self.words.findall(norm.decode())
        try:
            got = [*map(self.cache.__getitem__, words)]
        except KeyError:
            self.learn(words)
            got = [*map(self.cache.__getitem__, words)]
        return [*chain.from_iterable([x[0] for x in got])], ",".join([x[1] for x in got])

    def encode(self, text: bytes) -> tuple[list[int], str]:
        """ids, and the same in decimal joined by commas."""
        if self.words is None:  # pieces cross words: the library's ids, without alignment
            ids = self.library.encode(text.decode("utf-8", "replace"))
            return ids, ",".join([self.decimal[i] for i in ids])
        return self._merged(self.normalize(text)[0], text)

    def aligned(self, text: bytes):
        """(ids, starts, ends, decimal): arrays of ids and of the bytes of the original text they stand for, and the ids as text."""
        import numpy as np

        if self.words is None:
            raise ValueError("this model's pieces cross words; spans are not supported")
        norm, align = self.normalize(text)
        listed, decimal = self._merged(norm, text)
        ids = np.array(listed, np.int32)
        if not len(ids):
            return listed, ids, ids, ""
        sizes = self.widths[ids]
        lone = sizes == 0
        if not lone.any():
            ends = np.cumsum(sizes)
            starts = ends - sizes
        else:
            heads = np.flatnonzero(np.r_[np.frombuffer(norm, np.uint8) & 0xC0 != 0x80, True])  # characters of the normalised text
            if self.bytes_:  # one byte each, and the span of the whole character
                ends = np.cumsum(np.where(lone, 1, sizes))
                starts = np.r_[0, ends[:-1]]
            else:  # unknown: one character each
                at, starts, ends = 0, np.zeros_like(sizes), np.zeros_like(sizes)
                for k, size in enumerate(sizes.tolist()):
                    starts[k] = at
                    at = ends[k] = at + (size or int(heads[np.searchsorted(heads, at, "right")]) - at)
            starts[lone] = heads[np.searchsorted(heads, starts[lone], "right") - 1]
            ends[lone] = heads[np.searchsorted(heads, ends[lone], "left")]
        return listed, align[starts], align[ends], decimal

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(id, from, to) for every id: bytes of the original text."""
        ids, starts, ends, _ = self.aligned(text)
        return [*zip(ids, starts.tolist(), ends.tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def load_model(path: str) -> bytes:
    """The model's bytes: under a megabyte, so every task may carry them."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, ids, decoded and, unless not asked for, starts and ends: each id's span in the text's UTF-8 bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = Codec(model)

        def lists(arrays: list) -> pa.Array:
            ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32, copy=False)))

        for batch in small_batches(batches, limit=SLICE):
            found, decoded = [], []
            for text in text_bytes(batch.column(1)):  # a text's ids are Python numbers only while it is decoded
                if spans:
                    ids, starts, ends, _ = codec.aligned(text)
                else:
                    ids = codec.encode(text)[0]
                decoded.append(codec.decode(ids))
                found.append((np.array(ids, np.int32), starts, ends) if spans else (np.array(ids, np.int32),))
            cols = [batch.column(0), *map(lists, zip(*found, strict=True))]
            cols.insert(2, pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded", "starts", "ends"][: len(cols)])

    schema = "doc_id long, ids array<int>, decoded string" + ", starts array<int>, ends array<int>" * spans
    return docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (all starts, then all ends, as little-endian 32-bit numbers) for every document."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        codec = Codec(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in small_batches(batches, limit=4 << 20):
            n, a, b, c = [], [], [], []
            for text in text_bytes(batch.column(1)):
                ids, starts, ends, decimal = codec.aligned(text)
                n.append(len(ids))
                a.append(sha(decimal.encode()))
                b.append(sha(codec.decode(ids).encode()))
                c.append(sha(starts.astype("<i4").tobytes() + ends.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *map(pa.array, (a, b, c))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
