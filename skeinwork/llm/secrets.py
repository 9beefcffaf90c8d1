"""Secret scan with a recursive decoding worklist.

A text and every layer that can be unwrapped from it are scanned for the same kinds of secrets. Percent escapes and
Unicode escapes are replaced in the whole layer, with a map from each new character to the span it came from; base64
runs and compressed data become layers whose every character maps to the run. Layers go on a worklist until none
is new; one is known by its text and its map, so equal texts at other places count, and cycles end.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.llm import _text as tx

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|((?:\\x[0-9A-Fa-f]{2})+)|&#(?:x([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 wrapped over lines, which may be indented or be escaped line ends. A short last piece must end its line.
_WRAP = re.compile(r"(?:\r?\n[ \t]*|(?:\\r)?\\n)")
_WRAPPED = re.compile(rf"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{_WRAP.pattern}(?:[A-Za-z0-9+/_-]{{16,}}+|[A-Za-z0-9+/_-]++(?=[=\r\\"'<>)\]}},;]|[ \t]*(?:\n|\Z))))+={{0,2}}""")
#: Beginnings of gzip and of the usual zlib data.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Bytes that are unpacked at a time, and characters from which unpacked text is scanned in parts.
CHUNK, SEGMENT = 1 << 20, 1 << 22
#: Up to the last character that is in no secret and no encoded data.
_LAST_APART = re.compile(r"""(?s).*[^A-Za-z0-9+/_=.\-%\\&#;{}"':\s]""")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the secrets of one layer, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    # A run's first match is its longest, so demanding the length in the pattern finds the same as dropping short ones.
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _wbits(head: bytes) -> int:
    """zlib's number for gzip or zlib data by its first bytes; 0 for other data."""
    if head == b"\x1f\x8b":
        return 31
    return 15 if len(head) == 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0 else 0


def _unpacked(data: bytes, at: int, reach: list[int]) -> Iterator[bytes]:
    """What gzip or zlib data at ``at`` holds, in chunks; members that follow each other, or zeros, are one text.

    ``reach`` gets the end of the last member that is whole.
    """
    rest = data[at:]
    while wbits := _wbits(rest[:2]):
        unpack = zlib.decompressobj(wbits)
        try:
            while not unpack.eof:
                out = unpack.decompress(rest, CHUNK)
                rest = unpack.unconsumed_tail
                if not out and not unpack.eof:
                    return
                yield out
        except zlib.error:
            return
        reach[0] = len(data) - len(unpack.unused_data)
        rest = unpack.unused_data.lstrip(b"\0")


def _segments(chunks: Iterator[bytes], encoding: str) -> Iterator[str]:
    """The text of the chunks in parts, cut only behind characters that nothing looked for can contain."""
    decoder, held, size = codecs.getincrementaldecoder(encoding)("replace"), [], 0
    for chunk in chunks:
        new = decoder.decode(chunk)
        if size + len(new) >= SEGMENT and (m := _LAST_APART.match(new)):
            yield "".join([*held, new[: m.end()]])
            held, size, new = [], 0, new[m.end() :]
        held.append(new)
        size += len(new)
    if text := "".join([*held, decoder.decode(b"", True)]):
        yield text


def _texts(chunks: Callable[[], Iterator[bytes]]) -> Iterator[str]:
    """Bytes as UTF-8, and as UTF-16 of both orders if they hold a NUL. What is no text gives other characters."""
    nul = False

    def watched() -> Iterator[bytes]:
        nonlocal nul
        for chunk in chunks():
            nul = nul or b"\0" in chunk
            yield chunk

    yield from _segments(watched(), "utf-8")
    if nul:
        yield from _segments(chunks(), "utf-16-le")
        yield from _segments(chunks(), "utf-16-be")


def contents(data: bytes) -> Iterator[str]:
    """Texts that decoded bytes hold, as they are and unpacked; compressed data may stand behind other bytes."""
    yield from _texts(lambda: iter((data,)))
    reach = [0]
    for at in sorted({0, *(m.start() for m in _PACKED.finditer(data))}):
        if at >= reach[0]:
            yield from _texts(lambda at=at: _unpacked(data, at, reach))


class _Layer:
    """Text whose character i comes from starts[i]:ends[i] of the original; without lists, it is the original."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts[start], self.ends[end - 1]) if self.starts is not None else (start, end)

    def replaced(self, parts: list[tuple[int, int, str]]) -> _Layer:
        """With the spans of ``parts`` replaced by their texts."""
        starts, ends, last = [], [], 0
        for a, b, text in [*parts, (len(self.text), len(self.text), "")]:
            starts += range(last, a) if self.starts is None else self.starts[last:a]
            ends += range(last + 1, a + 1) if self.ends is None else self.ends[last:a]
            if text:
                lo, hi = self.origin(a, b)
                starts += [lo] * len(text)
                ends += [hi] * len(text)
            last = b
        return _Layer(_replaced(self.text, parts), starts, ends)

    def key(self) -> tuple[bytes, bytes]:
        return _digest(self.text), hashlib.blake2b(np.array([self.starts, self.ends]).tobytes(), digest_size=16).digest()


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _replaced(text: str, parts: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, new in parts:
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]])


def _escapes(m: re.Match) -> str:
    brace, four, eight, two, entity, number = m.groups()
    try:
        if four:
            return b"".join(int(x, 16).to_bytes(2, "big") for x in four.split("\\u")[1:]).decode("utf-16-be", "replace")
        if two:
            return bytes.fromhex(two.replace("\\x", "")).decode("utf-8", "replace")
        return chr(int(brace or eight or entity, 16) if not number else int(number))
    except (ValueError, OverflowError):
        return m[0]


def replacements(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Escapes of one kind with their spans and what they stand for."""
    if "%" in text and (found := list(_PERCENT.finditer(text))):
        yield [(*m.span(), bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")) for m in found]
    if ("\\" in text or "&#" in text) and (found := list(_UNICODE.finditer(text))):
        yield [(*m.span(), _escapes(m)) for m in found]


def embedded(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans of encoded data and what they hold."""
    for m in _PERCENT.finditer(text) if "%" in text else ():
        yield from ((*m.span(), inner) for inner in contents(bytes.fromhex(m[0].replace("%", ""))))
    for m in _UNICODE.finditer(text) if "\\" in text else ():
        if m[4]:
            yield from ((*m.span(), inner) for inner in contents(bytes.fromhex(m[4].replace("\\x", ""))))
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            run = _WRAP.sub("", m[0]) if pattern is _WRAPPED else m[0]
            body = run.rstrip("=").replace("-", "+").replace("_", "/")
            # Other text may stand before the data with no sign between, so it can begin at any of four offsets.
            for at in range(4):
                part = body[at : len(body) - ((len(body) - at) % 4 == 1)]
                data = base64.b64decode(part + "=" * (-len(part) % 4))
                yield from ((*m.span(), inner) for inner in contents(data))


def layers(text: str) -> Iterator[str]:
    """What can be unwrapped from an embedded text by one step."""
    yield from (_replaced(text, parts) for parts in replacements(text))
    yield from (inner for _, _, inner in embedded(text))


def kinds_within(text: str, known: dict[bytes, set[int]]) -> set[int]:
    """Kinds of the secrets in an embedded text and all its layers; all of them stand at one place, so kinds are enough."""
    key = _digest(text)
    if key not in known:
        out, seen, work = {kind for _, kind, _ in scan(text)}, {key}, [layers(text)]
        while work and len(out) < len(KINDS):
            inner = next(work[-1], None)
            if inner is None:
                work.pop()
            elif (k := _digest(inner)) not in seen:
                seen.add(k)
                out.update(kind for _, kind, _ in scan(inner))
                work.append(layers(inner))
        known[key] = out
    return known[key]


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as sorted (start, kind's number, end)."""
    base = scan(text)
    found, seen, known, work = set(base), set(), {}, [_Layer(text)]
    while work:
        layer = work.pop()
        for a, b, inner in embedded(layer.text):
            lo, hi = layer.origin(a, b)
            found.update((lo, kind, hi) for kind in kinds_within(inner, known))
        for parts in replacements(layer.text):
            inner = layer.replaced(parts)
            if inner.text == layer.text or (key := inner.key()) in seen:
                continue
            seen.add(key)
            for a, kind, b in scan(inner.text):
                lo, hi = inner.origin(a, b)
                found.add((lo, kind, hi))
            work.append(inner)
    return base, sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_assign``, ``n_access``, ``n_hex`` (base matches), ``base`` and ``spans``.

    ``base`` and ``spans`` are lists of structs (kind, start, end) in code points of the text, end exclusive, by start
    and then kind; ``spans`` also holds what decoded layers contain, at the encoded part's place. Null is empty.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find_secrets(t or "") for t in b.column("text").to_pylist()]
            count = [[sum(k == i for _, k, _ in base) for base, _ in both] for i in range(3)]
            lists = [[[{"kind": KINDS[k], "start": a, "end": e} for a, k, e in x[j]] for x in both] for j in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, pa.int64()) for c in count], *[pa.array(x, kind) for x in lists]], names=["id", "n_assign", "n_access", "n_hex", "base", "spans"])

    tx.small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema["id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", span), T.StructField("spans", span)])
    return docs.mapInArrow(emit, schema).withColumnRenamed("id", id_col)


def span_text(column: str):
    """A list of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
