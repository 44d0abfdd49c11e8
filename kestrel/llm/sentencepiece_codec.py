"""SentencePiece encoding with byte spans of the original text, and decoding.

Normalisation is done here: at every position the longest prefix found in the
model's compiled character map (a double-array trie) is replaced, and for each
byte of the normalised text the byte of the source it came from is recorded.
The library then cuts the normalised text into pieces, and every piece is
projected through that record to the bytes of the original text it stands for.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import take

SPACE = "▁"        # fixed value: the visible space
CACHE_WORDS = 200_000   # bound of each worker's cache of encoded words
BATCH_TEXTS = 256

SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())),
                    ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])
_loaded: dict[str, "Codec"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def codec(path: str) -> "Codec":
    """One codec per model and Python worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Codec(f.read())
    return _loaded[path]


def _fields(b: bytes):
    """(number, value) of a protocol buffer message; bytes for length-delimited fields."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out
    while at < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, b[at:at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, b[at:at + n]
            at += n


class CharMap:
    """Longest-prefix lookup in a compiled character map; empty bytes map nothing."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self._units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if size else ()
        self._texts = compiled[4 + size:]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, b: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of b[at:] and what replaces it."""
        units, found = self._units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for k in range(at, len(b)):
            node ^= b[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != b[k]:
                break
            node ^= offset(unit)
            if unit & 256:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self._texts[found[1]:self._texts.index(b"\0", found[1])]


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece
        norm = dict(kv for k, v in _fields(model) if k == 3 for kv in _fields(v))
        self.charmap = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The same model with a normaliser that changes nothing: of a field that occurs twice, the last counts.
        same = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(same)]) + same)
        sp, n = self.full, self.full.get_piece_size()
        if not sp.is_byte(sp.piece_to_id("<0x0A>")):
            raise ValueError("the model has no byte pieces")
        pieces = [sp.id_to_piece(k) for k in range(n)]
        self.width = np.array([1 if sp.is_byte(k) else len(p.encode()) for k, p in enumerate(pieces)], np.int64)
        plain = [p for k, p in enumerate(pieces) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        # Merges never join what no piece holds, so such texts may be cut there and each word encoded once.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in plain)
        self.cuttable &= self.escape and self.prefix and not self.squeeze and not self.charmap
        self._words: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte."""
        b = text.encode()
        if not b:
            return "", np.zeros(1, np.int64)
        if not self.charmap and not self.squeeze:
            mark = SPACE.encode() if self.escape else b" "
            raw = np.frombuffer(b, np.uint8)
            step = np.where(raw == 32, len(mark), 1)
            align = np.repeat(np.arange(len(b)), step)
            out = text.replace(" ", SPACE) if self.escape else text
            if self.prefix:
                out, align = mark.decode() + out, np.concatenate([np.zeros(len(mark), np.int64), align])
            return out, np.append(align, len(b))
        return self._mapped(b)

    def _mapped(self, b: bytes) -> tuple[str, np.ndarray]:
        space = SPACE.encode() if self.escape else b" "
        out, align, at = bytearray(), [], 0

        def put(part: bytes, source: int):
            out.extend(part)
            align.extend([source] * len(part))

        def step(at: int) -> tuple[int, bytes]:
            hit = self.charmap.longest(b, at) if self.charmap else None
            if hit:
                return hit
            n = 1
            while at + n < len(b) and b[at + n] & 0xC0 == 0x80:
                n += 1
            return n, b[at:at + n]

        if self.squeeze:
            while at < len(b):
                n, part = step(at)
                if part != b" ":
                    break
                at += n
            if at == len(b):
                return "", np.zeros(1, np.int64)
        if self.prefix:
            put(space, at)
        spaced = self.squeeze
        while at < len(b):
            n, part = step(at)
            if spaced:
                part = part.lstrip(b" ")
            for k in range(len(part)):
                put(space if part[k] == 32 else part[k:k + 1], at)
            if part:
                spaced = self.squeeze and part.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while out.endswith(space):
                end = align[len(out) - len(space)]
                del out[-len(space):], align[-len(space):]
        return out.decode(), np.array([*align, end], np.int64)

    def _cut(self, text: str) -> list[str] | None:
        """Words of a text; None where cutting isn't known to be safe."""
        if not self.cuttable or not text or SPACE in text:
            return None
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            words = line.split(" ")
            if "" in words[1:] or (not words[0] and len(words) > 1):
                return None
            out += [SPACE + w for w in words] if not k else [words[0], *[SPACE + w for w in words[1:]]]
        return [w for w in out if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self._cut(t) for t in texts]
        plain, words = self.plain, self._words
        bytes_of = lambda found: [np.asarray(x, "<i4").tobytes() for x in found]
        missing = list({w for c in cuts if c for w in c if w not in words})
        extra = dict(zip(missing, bytes_of(plain.encode(missing, num_threads=1)))) if missing else {}
        if len(words) + len(extra) <= CACHE_WORDS:
            words.update(extra)
            extra = {}
        elif len(words) < CACHE_WORDS:
            for w in missing[:CACHE_WORDS - len(words)]:
                words[w] = extra[w]
        out = []
        for t, c in zip(texts, cuts):
            if c is None:
                ids = np.asarray(plain.encode(self.normalise(t)[0]), "<i4")
            else:
                ids = np.frombuffer(b"".join([words[w] if w in words else extra[w] for w in c]), "<i4")
            out.append(ids)
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes [begin, end) of the original text for every piece."""
        _, align = self.normalise(text)
        ends = np.cumsum(self.width[ids])
        return align[ends - self.width[ids]], align[ends]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids, byte spans and decoded text of every document, without begin or end ids.

    NULL and empty texts give no ids and an empty decoded text. NULL ids and
    repeated rows are ordinary rows; an empty table gives no rows. Texts are
    encoded whole, in batches of bounded size, without a shuffle.
    """
    path = path or default_path()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                c = codec(path)
                texts = [t or "" for t in batch.column(1).slice(lo, BATCH_TEXTS).to_pylist()]
                ids = c.encode(texts)
                spans = [c.spans(t, x) for t, x in zip(texts, ids)]
                decoded = [c.full.decode(x.tolist()) for x in ids]
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                lists = lambda parts: pa.ListArray.from_arrays(
                    pa.array(at), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, BATCH_TEXTS), lists(ids), lists([s[0] for s in spans]),
                     lists([s[1] for s in spans]), pa.array(decoded, pa.string())], schema=_ARROW)

    return take(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)
