"""Secret scan with a recursive decoding worklist.

Every text is scanned for secrets (fixed patterns below). Encoded segments are
then unwrapped: percent escapes and \\u or \\x escapes (in each run and in the
whole text), base64 runs (at the four alignments, every stretch that reads as
text), and compressed bytes (gzip, zlib, bzip2, xz) that
start anywhere in the bytes of these. Bytes that are not UTF-8 stay as single
characters. A decoded layer keeps, for each of its characters, the span of the
base text that it came from; it is scanned by the same patterns and unwrapped
again, until nothing new comes up. Layers already seen in the document are not
taken twice, which ends cycles. What is found in a layer is told by its span in
the base text.

A stream that unpacks to more than WINDOW bytes is read on in windows, each a
layer, so that memory is bounded and nothing is left out: windows are cut after
a control character, which no secret holds, and where none stands in a window
(a bomb of one long run), they overlap by OVERLAP bytes instead. Nulls and empty texts hold nothing. Repeated rows
are scanned by themselves; equal spans of one kind are told once. An empty
table gives no row. Further columns are kept by `redact`, passed by otherwise.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, lean, table

# The patterns of the contract.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

WINDOW, OVERLAP = 64 << 20, 1 << 20
_CONTROL = re.compile(rb"[\x00-\x1f\x7f]")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
_RUN = re.compile(r"[^\s\"'<>]+")
_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_WORD = re.compile(r"[^\s]+")
_ESCAPED = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_LITERAL = re.compile(_ESCAPED.pattern + r"|\\([abfnrtv\\'\"/0])")
_SHORT = dict(zip("abfnrtv\\'\"/0", "\a\b\f\n\r\t\v\\'\"/\0", strict=True))
_BYTES = re.compile(r"[\x00-\xff]{8,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_URLSAFE = {45: 43, 95: 47}
#: Bytes that read as text, as long as the shortest secret at least (token=abcdef); secrets have ASCII characters only.
_READABLE = re.compile(rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
#: How gzip, bzip2, xz and zlib (any window, no preset dictionary) start.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|" + b"|".join(re.escape(bytes([c, f])) for c in range(8, 128, 16) for f in range(256) if (c * 256 + f) % 31 == 0 and not f & 32))
_STRAY = {0xDC00 + i: i for i in range(128, 256)}

Layer = tuple[str, list[int], list[int]]


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets that stand in `text` as it is."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]  # runs are maximal: the same as HEX, then the length
    return out


def _url(s: str, starts, ends):
    """Percent escapes decoded as UTF-8, each character with the span of its escapes; then what is compressed in the bytes."""
    data, first, last, at, spaces = bytearray(), [], [], 0, []

    def plain(a: int, b: int) -> None:
        for c, f, g in zip(s[a:b], starts[a:b], ends[a:b], strict=True):
            coded = c.encode("utf-8", "surrogatepass")
            if c == "+":
                spaces.append(len(data))
            data.extend(coded)
            first.extend([f] * len(coded))
            last.extend([g] * len(coded))

    for m in _PERCENT.finditer(s):
        plain(at, m.start())
        data.append(int(m[1], 16))
        first.append(starts[m.start()])
        last.append(ends[m.end() - 1])
        at = m.end()
    if not at:
        return
    plain(at, len(s))
    yield _text(bytes(data), first, last)
    yield from _packed(bytes(data), first, last)
    if spaces:  # forms write a space as +
        for i in spaces:
            data[i] = 32
        yield from _packed(bytes(data), first, last)


def _unicode(s: str, starts, ends):
    """\\u and \\x escapes decoded, then what is compressed in characters below 256 (also with the short escapes of literals)."""
    if not _ESCAPED.search(s):
        return
    for pattern in (_ESCAPED, _LITERAL):
        out, first, last, at = [], [], [], 0
        for m in pattern.finditer(s):
            out.append(s[at : m.start()])
            first.extend(starts[at : m.start()])
            last.extend(ends[at : m.start()])
            code = m[1] or m[2]
            out.append(chr(int(code, 16)) if code else _SHORT[m[3]])
            first.append(starts[m.start()])
            last.append(ends[m.end() - 1])
            at = m.end()
        text = "".join(out) + s[at:]
        first.extend(starts[at:])
        last.extend(ends[at:])
        if pattern is _ESCAPED:
            yield text, first, last
        for m in _BYTES.finditer(text):
            a, b = m.span()
            yield from _packed(m[0].encode("latin-1"), first[a:b], last[a:b])


def _text(data: bytes, first: list[int], last: list[int]) -> Layer:
    """`data` as UTF-8; bytes that are not UTF-8 stay, each as the character of its number."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return text.translate(_STRAY), first, last
    a, b, i = [], [], 0
    for c in text:
        n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode("utf-8"))
        a.append(first[i])
        b.append(last[i + n - 1])
        i += n
    return text.translate(_STRAY), a, b


def _reader(data: memoryview):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zlib.decompressobj()


def _extent(data: memoryview) -> tuple[int, int, bool]:
    """How far the stream at the start of `data` can be read: bytes it gives, bytes it takes, and whether it is whole."""
    reader, at, given = _reader(data), 0, 0
    try:
        while at < len(data) and not reader.eof:  # in steps, so that bytes before a fault are kept
            step = data[at : at + 256]
            at += len(step)
            given += len(reader.decompress(step))
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        return given, at, False
    return given, at - len(reader.unused_data), reader.eof


def _unpacked(data: memoryview, window: int = WINDOW, overlap: int = OVERLAP):
    """What the stream at the start of `data` gives, in windows."""
    reader, at, out = _reader(data), 0, bytearray()
    try:
        while at < len(data) and not reader.eof:
            step = data[at : at + 256]
            at += len(step)
            out += reader.decompress(step)
            while len(out) > window + overlap:
                cut = max((m.end() for m in _CONTROL.finditer(out, window - overlap, window)), default=0)
                yield bytes(out[: cut or window])
                del out[: cut or window - overlap]
    except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
        pass
    yield bytes(out)


def _packed(data: bytes, first: list[int], last: list[int], end: int | None = None):
    """The layers of the compressed streams that start anywhere in `data`, and of those inside them.

    Their characters have the span of the stream; `end` is where a stream ends that takes `data` to its last byte.
    """
    work, seen = [(data, None)], set()
    while work:
        now, span = work.pop()
        at = 0
        while (m := _MAGIC.search(now, at)) is not None:
            stream = memoryview(now)[m.start() :]
            given, used, whole = _extent(stream)
            stop = m.start() + used
            at = stop if whole else m.start() + 1
            for out in _unpacked(stream) if given else ():
                key = hashlib.blake2b(out, digest_size=16).digest()
                if not out or key in seen:
                    continue
                seen.add(key)
                a, b = span or (first[m.start()], last[stop - 1] if stop < len(data) or end is None else end)
                yield _text(out, [a] * len(out), [b] * len(out))
                work.append((out, (a, b)))


def _base64(s: str, starts, ends):
    """What is readable, or compressed, in the bytes of `s` at each of the four alignments.

    A blob that / - or _ joins to words stands at one of these, and ends exactly: after it, the bits of / - _ make
    a byte that no secret has (0x0F, > or ?, or one that is not UTF-8), so the run need not be split there as well.
    """
    body = s.rstrip("=")
    for k in range(4):
        b = len(body) - ((len(body) - k) % 4 == 1)  # a lone last character has no whole byte
        data = binascii.a2b_base64(body[k:b].translate(_URLSAFE) + "=" * ((k - b) % 4))
        for m in _READABLE.finditer(data):
            at = [k + i // 3 * 4 + i % 3 for i in range(*m.span())]
            yield _text(m[0], [starts[p] for p in at], [ends[p + 1] for p in at])
        if _MAGIC.search(data):
            at = [k + i // 3 * 4 + i % 3 for i in range(len(data))]
            yield from _packed(data, [starts[p] for p in at], [ends[p + 1] for p in at], ends[-1] if b == len(body) else None)


#: (runs, what they hold, decoder, whether the whole text is decoded as well: a secret may go beyond the run of its escapes).
DECODERS = ((_RUN, "%", _url, True), (_WORD, "\\", _unicode, True), (_BASE64, "", _base64, False))


def layers(text: str):
    """(decoded text, starts, ends) of every layer below `text`, each once: the worklist."""
    work: list[Layer | tuple[str, None, None]] = [(text, None, None)]
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    while work:
        now, starts, ends = work.pop()
        for pattern, needs, decode, whole in DECODERS:
            if needs and needs not in now:
                continue
            for a, b in [(0, len(now))] * whole + [m.span() for m in pattern.finditer(now)]:
                run = now[a:b]
                if needs not in run:
                    continue
                at = (range(a, b), range(a + 1, b + 1)) if starts is None else (starts[a:b], ends[a:b])
                for layer in decode(run, *at):
                    if not layer[0] or layer[0] == run:
                        continue
                    key = hashlib.blake2b(f"{layer[1][0]}:{layer[2][-1]}:{layer[0]}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    if key not in seen:
                        seen.add(key)
                        work.append(layer)
                        yield layer


def secrets(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans of `text`, and all spans with those of its layers; by start, then kind as listed."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(scan(text), key=order)
    found = set(base)
    for now, starts, ends in layers(text):
        found.update((min(starts[a:b]), max(ends[a:b]), kind) for a, b, kind in scan(now))
    return base, sorted(found, key=order)


def told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the secrets of every row of `docs`."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = secrets(t or "")
                counts = [sum(x[2] == k for x in base) for k in KINDS]
                rows.append((d, *counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), FOUND)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """`text` with every span, overlapping ones together, replaced by `mark`."""
    out, at = [], 0
    spans = sorted((a, b) for a, b, _ in secrets(text)[1])
    i = 0
    while i < len(spans):
        a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][1])
        out += [text[at:a], mark]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with the secrets in `text` replaced; `n_chars`, where it is there, counts the new text."""
    arrow_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [redacted(t, mark) if t else t for t in old]
            cols = {n: batch.column(n) for n in names}
            if new != old:
                cols["text"] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in cols:
                    count = [n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new, strict=True)]
                    cols["n_chars"] = pa.array(count, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return docs.mapInArrow(lean(run), docs.schema)


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
