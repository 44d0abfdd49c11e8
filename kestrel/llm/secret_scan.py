"""Secret scan: pattern candidates, and structural confirmation of encoded keys and tokens.

Base spans come from three patterns. Beyond them, long runs of base64 or hex are
decoded and reported only if the bytes parse: as a DER key (every nested length
has to fit), an OpenSSH key or SSH wire key (length-prefixed fields that use up
the blob), or as a signed token whose header is JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import take

# The base kinds, in the order of their spans.
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("jwt", "pem", "der", "openssh", "sshwire")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")   # as runs are maximal, the same as [0-9a-f]+ of 16 or more

RUN = re.compile(r"[A-Za-z0-9+/_.=-]{40,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*")
BLOB = re.compile(r"[0-9A-Fa-f]{64,}(?![A-Za-z0-9+/_-])|[A-Za-z0-9+/_-]{40,}={0,2}")
PARTS = (re.compile(r"[0-9A-Fa-f]{64,}"), re.compile(r"[A-Za-z0-9+/]{40,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{40,}={0,2}"))
#: What every key encoding begins with in base64: a SEQUENCE, a four-byte length below 2^16, the OpenSSH magic.
HEAD = re.compile(r"M[A-P]|AAAA|b3BlbnNz")
INNER = re.compile(r"(?<=[^A-Za-z0-9])(?:M[A-P]|AAAA|b3BlbnNz)[A-Za-z0-9+/_-]{32,}+={0,2}")
#: Line ends: real ones, or written as in a string literal.
BREAK = r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{40,}}+{BREAK})+[A-Za-z0-9+/_-]*={{0,2}}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\[rn]){16,}?)-----END \1-----")
BATCH_TEXTS = 512

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
MAX_DEPTH = 12


def der(b: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """[(tag, children or None), ...] of b[at:end], or None where a nested length doesn't fit."""
    end = len(b) if end is None else end
    out = []
    if depth > MAX_DEPTH:
        return None
    while at < end:
        if at + 2 > end:
            return None
        tag, n = b[at], b[at + 1]
        at += 2
        if n & 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(b[at:at + k], "big")
            at += k
        if at + n > end:
            return None
        children = None
        if tag & 32:
            children = der(b, at, at + n, depth + 1)
            if children is None:
                return None
        out.append((tag, children))
        at += n
    return out


def der_key(b: bytes) -> bool:
    """One SEQUENCE with the fields of a private or public key."""
    if b[:1] != b"\x30":
        return False
    top = der(b)
    if not top or len(top) != 1 or not top[0][1]:
        return False
    fields = top[0][1]
    tags = [t for t, _ in fields]
    algorithm = lambda f: f[0] == SEQUENCE and bool(f[1]) and f[1][0][0] == OID
    if len(tags) >= 3 and tags[0] == INTEGER and algorithm(fields[1]) and tags[2] == OCTETS:
        return True    # private key information
    if len(tags) == 2 and algorithm(fields[0]) and tags[1] in (BITS, OCTETS):
        return True    # public key information, encrypted private key
    if tags[:2] == [INTEGER, OCTETS] and all(t & 0xE0 == 0xA0 for t in tags[2:]):
        return True    # elliptic-curve private key
    return len(tags) in (2, 9) and set(tags) == {INTEGER} and len(b) >= 60   # RSA keys


def _prefixed(b: bytes, at: int) -> int | None:
    if at + 4 > len(b):
        return None
    end = at + 4 + int.from_bytes(b[at:at + 4], "big")
    return end if end <= len(b) else None


def ssh_wire(b: bytes) -> bool:
    """Length-prefixed fields, the first a key type, that use up the blob."""
    at = _prefixed(b, 0)
    if at is None or not re.match(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]{2,60}$", b[4:at]):
        return False
    fields = 0
    while at is not None and at < len(b):
        at = _prefixed(b, at)
        fields += 1
    return at is not None and fields >= 1


def openssh(b: bytes) -> bool:
    """Magic, cipher, key derivation, its options, a key count and the public key."""
    magic = b"openssh-key-v1\0"
    at: int | None = len(magic)
    if not b.startswith(magic):
        return False
    for _ in range(3):
        at = _prefixed(b, at)
        if at is None:
            return False
    if at + 4 > len(b) or not 1 <= int.from_bytes(b[at:at + 4], "big") <= 16:
        return False
    end = _prefixed(b, at + 4)
    return end is not None and ssh_wire(b[at + 8:end])


def encoding(b: bytes) -> str | None:
    """Kind of the key encoding in a decoded blob."""
    return "openssh" if openssh(b) else "sshwire" if ssh_wire(b) else "der" if der_key(b) else None


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed_token(s: str) -> bool:
    """header.payload.signature whose header and payload are JSON objects; the header names an algorithm."""
    header, payload, _ = s.split(".", 2)
    try:
        h = json.loads(unbase64(header) or b"")
        p = json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(h.get("alg"), str) and isinstance(p, dict)


def _key(s: str) -> str | None:
    """Kind of the key that a blob of hex or base64 holds."""
    kind = None
    if len(s) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", s):
        kind = encoding(bytes.fromhex(s))
    return kind or encoding(unbase64(s) or b"")


def _blobs(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """Keys in a run of base64 in either alphabet: the whole run, or else its parts in one alphabet
    and what follows a sign in it."""
    kind = _key(text[lo:hi])
    if kind:
        return [(kind, lo, hi)]
    out, at = [], lo
    spans = {m.span() for p in (*PARTS, INNER) for m in p.finditer(text, lo, hi)} - {(lo, hi)}
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        kind = _key(text[a:b]) if a >= at else None
        if kind:
            out.append((kind, a, b))
            at = b
    return out


def claimed(head: bytes) -> int | None:
    """Bytes that an encoding says to have by its first bytes, 0 where it doesn't say, None where it is none."""
    if head[:1] == b"\x30" and len(head) >= 6:
        n = head[1]
        if n < 128:
            return 2 + n
        return 2 + (n & 127) + int.from_bytes(head[2:2 + (n & 127)], "big") if 1 <= n & 127 <= 4 else None
    return 0 if head.startswith(b"openssh-key-v1") or re.match(rb"\0\0\0.(ssh-|ecdsa|sk-)", head, re.DOTALL) else None


def _line_keys(text: str, lo: int, hi: int) -> list[tuple[str, int, int]]:
    """Keys over several lines of one width, the last of which may be shorter."""
    rows, at = [], lo
    for m in re.finditer(BREAK, text[lo:hi]):
        rows.append((at, lo + m.start()))
        at = lo + m.end()
    rows.append((at, hi))
    until = list(range(1, len(rows) + 1))      # past the last line of each one's width
    for k in range(len(rows) - 2, -1, -1):
        if rows[k][1] - rows[k][0] == rows[k + 1][1] - rows[k + 1][0]:
            until[k] = until[k + 1]
    out, k = [], 0
    while k < len(rows):
        j, width = k + 1, rows[k][1] - rows[k][0]
        size = claimed(unbase64(text[rows[k][0]:rows[k][0] + 24]) or b"") if HEAD.match(text, rows[k][0]) else None
        if size is not None:
            j = until[k]
            for n in (j + 1, j, j - 1):    # with the shorter line after them, or a last full one that is something else
                if k + 1 < n <= len(rows) and rows[n - 1][0] < rows[n - 1][1] and (n <= j or rows[j][1] - rows[j][0] < width) \
                        and (not size or -3 <= ((n - 1 - k) * width + rows[n - 1][1] - rows[n - 1][0]) * 3 // 4 - size <= 3):
                    kind = encoding(unbase64("".join(text[a:b] for a, b in rows[k:n])) or b"")
                    if kind:
                        out.append((kind, rows[k][0], rows[n - 1][1]))
                        j = n
                        break
            else:
                j = k + 1
        k = j
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    for run in RUN.finditer(text):
        lo, hi = run.span()
        for m in TOKEN.finditer(text, lo, hi):
            if signed_token(m.group()):
                out.append(("jwt", *m.span()))
        for m in BLOB.finditer(text, lo, hi):
            out += _blobs(text, *m.span())
    armoured = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if encoding(unbase64(re.sub(r"\\[rn]|\s", "", m.group(2))) or b""):
                armoured.append(("pem", *m.span()))
    out += armoured
    for m in LINES.finditer(text):
        out += [s for s in _line_keys(text, *m.span()) if not any(a < s[2] and s[1] < b for _, a, b in armoured)]
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every document, none where nothing is found.

    NULL texts are empty. NULL ids and repeated rows are ordinary rows; an empty
    table gives no rows. Whole texts are read, one batch at a time, without a shuffle.
    """
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t or "")]
                         for t in batch.column(1).slice(lo, BATCH_TEXTS).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, BATCH_TEXTS), pa.array(spans, _SPANS)],
                                                 names=["doc_id", "spans"])

    return take(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)


def _masked(text: str) -> str:
    """The text with every span replaced by [kind]; overlapping spans become one, named by the first."""
    out, at = [], 0
    spans = find(text)
    k = 0
    while k < len(spans):
        kind, lo, hi = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < hi:
            hi = max(hi, spans[k][2])
            k += 1
        out += [text[at:lo], f"[{kind}]"]
        at = hi
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, keep: tuple, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The columns ``keep`` with secrets in the text masked; ``size_col`` follows a changed text.

    NULL texts stay NULL. Every row stays.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = rows.schema
    at_text = keep.index(text_col)
    at_size = keep.index(size_col) if size_col in keep else None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(lo, BATCH_TEXTS)
                old = part.column(at_text).to_pylist()
                new = [t if t is None else _masked(t) for t in old]
                cols = list(part.columns)
                cols[at_text] = pa.array(new, cols[at_text].type)
                if at_size is not None:
                    size = cols[at_size].to_pylist()
                    cols[at_size] = pa.array([s if a == b else len(b) for s, a, b in zip(size, old, new)],
                                             cols[at_size].type)
                yield pa.RecordBatch.from_arrays(cols, names=list(keep))

    return rows.mapInArrow(run, schema)
