"""Secrets in whole texts: patterns, and encoded keys confirmed by their structure.

*Base* spans follow three patterns: assignments to a telling name, access key ids and hex runs.
Further kinds are reported only after decoding a candidate and parsing what it holds:

``pem``      a PEM block whose base64 body is one DER value with consistent nested lengths
``sshkey``   a public key in SSH wire format: length-prefixed fields that fill the blob exactly
``token``    a signed token: two JSON objects, the first naming an algorithm, and a signature
``der``      bare base64 of a key in DER: a sequence led by a version number or an algorithm
``hexkey``   the same in hex digits of either case

Base64 and hex may be wrapped by real or escaped line ends, wherever a line of it starts. What
they decode to is looked at once more: base64 of a PEM file counts as ``pem``, of an SSH key, public
or private, as ``sshkey``, and hex of any of these as ``hexkey``.

Spans are code points, end exclusive. Null text counts as empty and has none. Each input row
gives one output row, so repeated rows and null or repeated ids stay; columns other than id and
text are not carried along.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, islice
from typing import NamedTuple

from pyspark.sql import DataFrame

from ledgerlens.llm.rows import map_rows

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "sshkey", "token", "der", "hexkey")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
_PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\{1,4}[nrt/])+)-----END \1-----", re.ASCII
)
_ESCAPED_END = re.compile(r"\\{1,4}[nrt]")
_MAGIC = b"openssh-key-v1\0"
_SSH = re.compile(r"(?<![A-Za-z0-9+/])AAAA[A-Za-z0-9+/]{16,}={0,2}")
_JWT = re.compile(r"(?<![\w.-])eyJ[\w-]+\.[\w-]+\.[\w-]*(?![\w-])", re.ASCII)
# Runs of lines of base64 or hex, which real or escaped line ends and indents part.
_WRAP = r"(?:[ \t]*(?:\r?\n|\\{1,4}[nrt])[ \t]*)++"
_START = r"(?:(?<![%s\\])|(?<=\\)(?![nrt])|(?<=\\[nrt]))"
_BASE64 = re.compile(
    _START % "A-Za-z0-9+/" + rf"[A-Za-z0-9+/]{{16,}}+(?:{_WRAP}[A-Za-z0-9+/]++)*+={{0,2}}+(?!=)"
)
_ANY_HEX = re.compile(
    _START % "0-9A-Fa-f" + rf"[0-9A-Fa-f]{{16,}}+(?:{_WRAP}[0-9A-Fa-f]++(?![G-Zg-z]))*+"
)
_LINE = re.compile(rf"(?:{_WRAP})?([A-Za-z0-9+/]++=*+)")
#: An SSH key's type name; most fields of a public key or certificate, and keys in a private file.
_KEY_TYPE = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}")
_FIELDS, _KEYS = 16, 16
#: Bytes that a key in base64 or hex has at least.
_LEAST = {"base64": 30, "hex": 24}


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, by start and then kind."""
    lower, found = text.lower(), []
    if any(name in lower for name in _NAMES):
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [Span("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    at = _LONG_HEX.search(text)
    while at:  # runs shorter than 24 are passed over, a longer one is taken whole
        end = _HEX.match(text, at.start()).end()
        found.append(Span("hex", at.start(), end))
        at = _LONG_HEX.search(text, end)
    return sorted(found, key=lambda s: (s.start, BASE_KINDS.index(s.kind)))


def _base64(text: str, altchars: bytes | None = None) -> bytes:
    """Decoded base64 with or without its padding; nothing where it is none."""
    text = "".join(text.split()).rstrip("=")
    if "\\" in text:
        text = _ESCAPED_END.sub("", text).replace("\\", "").rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars, validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_values(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``data`` exactly; None unless all nested lengths agree."""
    values, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > 16:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag & 0x20 and der_values(content, depth + 1) is None:
            return None
        values.append((tag, content))
        at += size
    return values


def is_der(data: bytes) -> bool:
    """One DER sequence holding something, with nothing after it."""
    values = der_values(data) if data[:1] == b"\x30" else None
    return bool(values) and len(values) == 1 and len(values[0][1]) > 2


def is_der_key(data: bytes) -> bool:
    """A DER sequence laid out as a key: a small version and more, or an algorithm and bits."""
    if not is_der(data):
        return False
    fields = der_values(der_values(data)[0][1])
    if len(fields) < 2:
        return False
    (tag, content), (second, _) = fields[:2]
    if tag == 0x02 and len(content) == 1 and content[0] <= 3:
        return second in (0x02, 0x04, 0x30)
    algorithm = der_values(content) if tag == 0x30 else None
    return bool(algorithm) and algorithm[0][0] == 0x06 and second in (0x03, 0x04)


def ssh_key_size(data: bytes) -> int:
    """Bytes of the SSH key at the start of ``data``: a type name and its fields; 0 if none."""
    fields, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if not 0 < size <= len(data) - at - 4:
            break
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if len(fields) < 2 or at != len(data):
        return 0
    return at if _KEY_TYPE.fullmatch(fields[0]) else 0


def is_signed_token(text: str) -> bool:
    """Header and claims are JSON objects, the header names its algorithm, the rest decodes."""
    header, claims, signature = text.split(".")
    try:
        head = json.loads(_base64(header, b"-_"))
        body = json.loads(_base64(claims, b"-_"))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)):
        return False
    return head["alg"].lower() == "none" or len(_base64(signature, b"-_")) >= 16


def _pem_body(text: str) -> bool:
    """Whether a PEM body holds DER, or the magic bytes of an SSH private key."""
    data = _base64(text)
    return is_der(data) or data.startswith(_MAGIC)


def _der_size(data: bytes) -> int:
    """Bytes that the DER sequence at the start of ``data`` says it has; 0 if there is none."""
    if data[:1] != b"\x30" or len(data) < 6:
        return 0
    if not data[1] & 0x80:
        return 2 + data[1]
    width = data[1] & 0x7F
    return 2 + width + int.from_bytes(data[2 : 2 + width], "big") if 1 <= width <= 4 else 0


def _fields(data: bytes, at: int) -> Iterator[int]:
    """Where the length-prefixed fields from ``at`` on end."""
    while at + 4 <= len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return
        yield at


def _private_end(data: bytes, at: int) -> int:
    """Where the OpenSSH private key that starts at ``at`` ends; -1 if it is not whole."""
    ends = list(islice(_fields(data, at + len(_MAGIC)), 3))  # cipher, key derivation, its options
    if len(ends) < 3:
        return -1
    count = int.from_bytes(data[ends[2] : ends[2] + 4], "big")
    if not 1 <= count <= _KEYS:
        return -1
    ends = list(islice(_fields(data, ends[2] + 4), count + 1))
    return ends[count] if count < len(ends) else -1


def _ssh_ends(data: bytes, at: int) -> Iterator[int]:
    """Where an SSH public key that starts at ``at`` may end: after each field from the second on."""
    last = at
    for count, end in enumerate(islice(_fields(data, at), _FIELDS), 1):
        if end == last + 4 or count == 1 and not _KEY_TYPE.fullmatch(data, at + 4, end):
            return
        if count > 1:
            yield end
        last = end


class _Run:
    """Lines of base64 or hex digits as one row of digits that remembers its places."""

    def __init__(self, text: str, m: re.Match, coding: str):
        lines = list(_LINE.finditer(text, m.start(), m.end()))
        self.spans = [line.span(1) for line in lines]
        parts = [line[1].rstrip("=") for line in lines]
        self.digits, self.coding = "".join(parts), coding
        #: Digits before each line, and in all.
        self.before = list(accumulate(map(len, parts), initial=0))

        #: What the run decodes to from each phase on, and the PEM blocks in that.
        self.decoded: dict[int, bytes] = {}
        self.blocks: dict[int, list[tuple[int, int]]] = {}

    def _bytes(self, digits: str) -> bytes:
        if self.coding == "hex":
            return bytes.fromhex(digits[: len(digits) // 2 * 2])
        return _base64(digits[:-1] if len(digits) % 4 == 1 else digits)

    def head(self, line: int) -> bytes:
        start = self.before[line]
        return self._bytes(self.digits[start : start + 64])

    def _place(self, line: int) -> tuple[int, int]:
        """The phase of a line's digits, and its place in the bytes decoded from that phase."""
        start = self.before[line]
        if self.coding == "hex":
            return start % 2, start // 2
        return start % 4, start // 4 * 3

    def data(self, line: int) -> tuple[bytes, int]:
        """Decoded bytes that hold the rest of the run from ``line``, and where it starts.

        The run is decoded once for each phase, four times at most, however many lines ask.
        """
        phase, at = self._place(line)
        if phase not in self.decoded:
            self.decoded[phase] = self._bytes(self.digits[phase:])
        return self.decoded[phase], at

    def pem_ends(self, line: int) -> Iterator[int]:
        """Where the PEM blocks end that start at ``line`` or later, counted from ``line``."""
        data, at = self.data(line)
        phase, _ = self._place(line)
        if phase not in self.blocks:
            found = _PEM.finditer(data.decode("latin-1")) if b"-----BEGIN " in data else ()
            self.blocks[phase] = [m.span() for m in found if _pem_body(m[2])]
        blocks = self.blocks[phase]
        for _, end in islice(blocks, bisect.bisect_left(blocks, (at, 0)), None):
            yield end - at

    def last_line(self, line: int, size: int) -> int:
        """The line that ends with byte ``size`` counted from ``line``; -1 if none does."""
        end = self.before[line] + (2 * size if self.coding == "hex" else -(-4 * size // 3))
        at = bisect.bisect_left(self.before, end)
        return at - 1 if line < at < len(self.before) and self.before[at] == end else -1

    def keys(self) -> Iterator[tuple[str, int, int]]:
        """(kind, first line, last line) of the keys, each from the start of a line."""
        done = 0
        for line in range(len(self.spans)):
            if line < done:
                continue
            for kind, size in self._at(line):
                last = self.last_line(line, size)
                if size >= _LEAST[self.coding] and last >= 0:
                    yield kind, line, last
                    done = last + 1
                    break

    def _at(self, line: int) -> Iterator[tuple[str, int]]:
        """(kind, bytes) of what may be a key at a line; a head of its bytes tells what to parse."""
        head = self.head(line)
        size = _der_size(head)
        if size and self.last_line(line, size) >= 0:
            data, at = self.data(line)
            if is_der_key(data[at : at + size]):
                yield "der", size
                return
        if head.startswith(_MAGIC):
            data, at = self.data(line)
            yield "sshkey", _private_end(data, at) - at
        elif re.match(rb"\0\0\0.(ssh|ecdsa|sk)-", head, re.DOTALL):
            data, at = self.data(line)
            yield from (("sshkey", end - at) for end in _ssh_ends(data, at))
        elif line == 0 or head.startswith(b"-----BEGIN "):
            # The first line stands for blocks that start inside a line as well.
            for end in islice(self.pem_ends(line), None if line == 0 else 1):
                yield from (("pem", at) for at in self._line_ends(line, end))

    def _line_ends(self, line: int, size: int) -> Iterator[int]:
        """Bytes up to the first line end at ``size`` or later, counted from ``line``."""
        per = 2 if self.coding == "hex" else 4 / 3
        at = bisect.bisect_left(self.before, self.before[line] + int(-(-size * per // 1)))
        if at < len(self.before):
            yield int((self.before[at] - self.before[line]) / per)


def structured_spans(text: str) -> Iterator[Span]:
    """Candidates whose decoded content parses."""
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if _pem_body(m[2]):
                yield Span("pem", *m.span())
    if "AAAA" in text:
        for m in _SSH.finditer(text):
            if ssh_key_size(_base64(m[0])):
                yield Span("sshkey", *m.span())
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if is_signed_token(m[0]):
                yield Span("token", *m.span())
    for coding, pattern in (("base64", _BASE64), ("hex", _ANY_HEX)):
        for m in pattern.finditer(text):
            run = _Run(text, m, coding)
            for kind, first, last in run.keys():
                kind = "hexkey" if coding == "hex" else kind
                yield Span(kind, run.spans[first][0], run.spans[last][1])


def find_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and the confirmed ones; both by start, then kind."""
    text = text or ""
    added = set(structured_spans(text))
    added = sorted(added, key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return base_spans(text), added


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every span as (kind, start, end), by start and kind."""
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()

    def start() -> Callable[..., tuple]:
        def spans(key, text):
            base, added = find_spans(text)
            both = sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))
            return key, [s._asdict() for s in both]

        return spans

    schema = f"`{id_col}` {id_type}, spans array<struct<kind:string,start:int,end:int>>"
    return map_rows(rows, schema, start)
