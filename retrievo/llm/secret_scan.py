r"""Operator 10: secrets, also under layers of encoding.

A worklist holds the layers of a text.  Each layer is scanned, then unwrapped: URL escapes, Unicode
escapes and the zeros of UTF-16 give one decoded copy of the whole layer, each base64 run (also of
several lines) gives the bytes inside it, read as UTF-8 or else as Latin-1, and zlib, gzip and bzip2
streams are looked for in the bytes that any decoder gives.  A layer seen before at the same place is not queued again, so
the work ends at a fixpoint also for encodings that decode to themselves.  Every decoded character
knows the span of the original that it came from; a secret found in a layer is reported at that span.
What a base64 run holds has the run's span: it is found once and reported wherever the run stands.

Defined cases: null text is empty text; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.  A stream that inflates to more than ``MAX_LAYER`` bytes is
read in pieces that overlap by ``OVERLAP``: an encoded run longer than that, or a stream in the
stream, that lies across a border is read in two parts.  A broken stream counts up to the fault.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and a pattern for each.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{1,15}+[ \t]*+(?:\r\n|\n|\r)[ \t]*+)?[A-Za-z0-9+/_-]{16,}+"
    r"(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
WIDE = re.compile(r"\0(?=[\x01-\x7f]\0)|(?<=\0[\x01-\x7f])\0")  # zeros beside ASCII in UTF-16
SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
ESCAPED = re.compile(UNICODE.pattern + r"""|\\[0-7]{1,3}|\\[abfnrtv\\'"]""")
HEADER = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
MAX_LAYER, OVERLAP, CHUNK = 64 << 20, 1 << 20, 1 << 14

FINDINGS = "array<struct<start:int,kind_rank:int,end:int,kind:string,layer:string,secret:string>>"


def matches(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, rank of the kind, secret) of the base findings of one layer."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield m.start(), m.end(), 0, m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 16:
                yield m.start(), m.end(), 1, m[0]
    for m in HEX.finditer(text):
        yield m.start(), m.end(), 2, m[0]


def _escape(token: str) -> str | None:
    digits = token.strip("\\&#;{}uUxX") if token[0] == "\\" else token[2:-1]
    code = int(digits, 16) if token[0] == "\\" else int(digits[1:], 16) if digits[0] in "xX" else int(digits)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Places:
    """Where the characters of a layer stand in the original text: runs of copied characters, and runs that came of one token.

    Runs are as long as can be, so equal maps are equal arrays; memory goes with the tokens, not with the text.
    """

    def __init__(self):
        self.starts, self.low, self.high = array("q"), array("q"), array("q")  # high is -1 where characters are copied
        self.size = 0

    def copied(self, low: int, length: int) -> None:
        if length and not (self.starts and self.high[-1] < 0 and self.low[-1] + self.size - self.starts[-1] == low):
            self._new(low, -1)
        self.size += length

    def decoded(self, low: int, high: int, length: int) -> None:
        if high == low + 1 and length == 1:
            self.copied(low, 1)
            return
        if length and not (self.starts and self.low[-1] == low and self.high[-1] == high):
            self._new(low, high)
        self.size += length

    def _new(self, low: int, high: int) -> None:
        self.starts.append(self.size)
        self.low.append(low)
        self.high.append(high)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The place in the original of some characters, one at least."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        low = self.low[i] + (start - self.starts[i] if self.high[i] < 0 else 0)
        return low, self.high[j] if self.high[j] >= 0 else self.low[j] + end - self.starts[j]

    def over(self, below: Places) -> Places:
        """This map, from a layer to the one that ``below`` maps to the original, carried on to the original."""
        out = Places()
        for i, start in enumerate(self.starts):
            length = (self.starts[i + 1] if i + 1 < len(self.starts) else self.size) - start
            low = self.low[i]
            if self.high[i] >= 0:
                out.decoded(*below.span(low, self.high[i]), length)
                continue
            j, end = bisect_right(below.starts, low) - 1, low + length
            while low < end:
                until = min(end, below.starts[j + 1] if j + 1 < len(below.starts) else below.size)
                if below.high[j] < 0:
                    out.copied(below.low[j] + low - below.starts[j], until - low)
                else:
                    out.decoded(below.low[j], below.high[j], until - low)
                low, j = until, j + 1
        return out

    def name(self) -> bytes:
        return hashlib.blake2b(self.starts.tobytes() + self.low.tobytes() + self.high.tobytes(), digest_size=16).digest()


def _rewritten(text: str, pattern: re.Pattern, decode) -> tuple[str, Places] | None:
    """The text with every match decoded, and the places of its characters in it."""
    out, places, at, changed = [], Places(), 0, False
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None:
            continue
        changed = True
        out += [text[at : m.start()], new]
        if len(out) > 1 << 16:  # many short strings take more room than a long one
            out = ["".join(out)]
        places.copied(at, m.start() - at)
        places.decoded(m.start(), m.end(), len(new))
        at = m.end()
    if not changed:
        return None
    out.append(text[at:])
    places.copied(at, len(text) - at)
    return "".join(out), places


def _percent(token: str) -> str:
    return bytes.fromhex(token.replace("%", "")).decode("utf-8", "replace")


REWRITES = [
    ("%", URL, _percent, "url"), ("\\", UNICODE, _escape, "unicode"), ("&#", UNICODE, _escape, "unicode"), ("\0", WIDE, lambda token: "", "utf16"),
]


def _byte(token: str) -> str | None:
    """An escape as one byte, where it is one."""
    if token[0] == "%":
        return chr(int(token[1:], 16))
    if token[0] == "\\" and token[1] in SIMPLE:
        return SIMPLE[token[1]]
    code = int(token[1:], 8) if token[0] == "\\" and token[1].isdigit() else ord(_escape(token) or "￿")
    return chr(code) if code < 256 else None


#: Escapes byte by byte: compressed streams are looked for in what they give.
VIEWS = [("%", re.compile("%[0-9A-Fa-f]{2}"), "url"), ("\\", ESCAPED, "unicode"), ("&#", ESCAPED, "unicode")]


def _stream(data: bytes, at: int) -> Iterator[tuple[bytes, int, bool]]:
    """What the stream at a place gives, in parts, each with the place read up to and whether it is the end.

    A broken stream gives what comes out before the fault."""
    bzip = data[at : at + 3] == b"BZh"
    z = bz2.BZ2Decompressor() if bzip else zlib.decompressobj(47)
    try:
        while not z.eof:
            need = not bzip or z.needs_input
            feed = data[at : at + CHUNK] if need else b""
            if need and not feed:
                return
            at += len(feed)
            if bzip:
                out = z.decompress(feed, MAX_LAYER)
            else:
                before = z.copy()
                try:
                    out = z.decompress(feed)
                except zlib.error:
                    for i in range(len(feed)):
                        yield before.decompress(feed[i : i + 1]), at - len(feed) + i + 1, False
                    return
            yield out, at - len(z.unused_data), z.eof
    except (zlib.error, OSError, ValueError, EOFError):
        return


def _streams(data: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the compressed streams in some bytes."""
    at = 0
    while m := HEADER.search(data, at):
        got, end, whole = False, m.end(), False
        for out, end, whole in _stream(data, m.start()):  # noqa: B007
            got = got or bool(out)
        if got:
            yield m.start(), end
        at = end if whole else m.start() + 1


def _pieces(data: bytes, at: int) -> Iterator[bytes]:
    """The content of a stream; a large one in pieces that overlap."""
    held, first = bytearray(), True
    for out, *_ in _stream(data, at):
        held += out
        if len(held) >= MAX_LAYER:
            yield bytes(held)
            del held[:-OVERLAP]
            first = False
    if len(held) > (0 if first else OVERLAP):
        yield bytes(held)


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _base64(token: str) -> bytes:
    """The bytes inside a base64 run, also of several lines."""
    body = re.sub(r"[\s=]+", "", token).replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _runs(layer: str) -> list[tuple[int, int]]:
    """Start and end of base64 runs, the short ones first: lines by themselves, and lines of one length as one
    run, with and without the lines of another length before and after them."""
    out = {m.span() for m in BASE64.finditer(layer)}
    for m in WRAPPED.finditer(layer) if "\n" in layer or "\r" in layer else ():
        lines = [x.span() for x in LINE.finditer(layer, *m.span())]
        lines[-1] = (lines[-1][0], m.end())
        sizes = [len(layer[a:b].rstrip("=")) for a, b in lines]
        out.add((m.start(), m.end()))
        i = 0
        while i < len(lines):
            j = i
            while j + 1 < len(lines) and sizes[j + 1] == sizes[i]:
                j += 1
            out |= {(lines[a][0], lines[b][1]) for a in {max(i - 1, 0), i} for b in {j, min(j + 1, len(lines) - 1)} if a < b}
            i = j + 1
    return sorted(out, key=lambda x: (x[1] - x[0], x))


def _inside(name: str, pieces: Iterator[bytes]) -> list[tuple[int, str, str]]:
    """(rank, layers, secret) of what some bytes hold, one for each kind: all of it has the bytes' place."""
    out, seen, tokens, stack = {}, set(), set(), [((name, piece) for piece in pieces)]

    def opened(runs, streams):
        for name, token in runs:
            yield f"{name}/base64", _base64(token)
        for name, data in streams:
            for start, _ in _streams(data):
                for piece in _pieces(data, start):
                    yield f"{name}/stream", piece

    while stack:
        if (item := next(stack[-1], None)) is None:
            stack.pop()
            continue
        text = _text(item[1])
        work, runs, streams = deque([(item[0], text)]), [], []
        while work:
            name, layer = work.popleft()
            mark = hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if mark in seen:
                continue
            seen.add(mark)
            if layer is text:
                streams.append(item)
            for _, _, k, secret in matches(layer):
                out.setdefault(k, (k, name, secret))
            for needle, pattern, decode, label in REWRITES:
                if needle in layer and (child := _replaced(layer, pattern, decode)) != layer:
                    work.append((f"{name}/{label}", child))
            for needle, pattern, label in VIEWS:
                if needle in layer and (view := _replaced(layer, pattern, _byte)) != layer:
                    streams.append((f"{name}/{label}", view.encode("latin-1", "replace")))
            for s, e in _runs(layer):
                if (token := layer[s:e]) not in tokens:
                    tokens.add(token)
                    runs.append((name, token))
        stack.append(opened(runs, streams))
    return list(out.values())


def _replaced(text: str, pattern: re.Pattern, decode) -> str:
    return pattern.sub(lambda m: m[0] if (new := decode(m[0])) is None else new, text)


def _mark(layer: str) -> bytes:
    return hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Told:
    """Places where a secret was told, none inside another; they are added in the order of their lengths."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []

    def within(self, start: int, end: int) -> bool:
        i = bisect_left(self.spans, (start,))
        return i < len(self.spans) and self.spans[i][1] <= end

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


def findings(text: str) -> list[tuple[int, int, int, str, str, str]]:
    """(start, rank, end, kind, layer, secret) in all layers; the base layer is named ''."""
    out = [(s, k, e, KINDS[k], "", secret) for s, e, k, secret in matches(text)]
    known = {(s, k, e) for s, k, e, *_ in out}
    whole = [sorted((s, e) for s, k2, e, *_ in out if k2 == k) for k in range(len(KINDS))]  # of a kind none overlap
    held = {}  # base64 run -> what it holds, for every place where it stands
    maps, work = {_mark(text): {None}}, deque([(text, None, "")])

    def add(s, k, e, name, secret):
        i = bisect_right(whole[k], (s, len(text))) - 1
        inside = i >= 0 and e <= whole[k][i][1]
        if (s, k, e) not in known and not inside:
            known.add((s, k, e))
            out.append((s, k, e, KINDS[k], name, secret))

    while work:
        layer, places, name = work.popleft()
        span = places.span if places else lambda s, e: (s, e)
        if name:
            for s, e, k, secret in matches(layer):
                low, high = span(s, e)
                add(low, k, high, name, secret)
        for needle, pattern, decode, label in REWRITES:
            if needle in layer and (new := _rewritten(layer, pattern, decode)):
                child, at = new
                at = at.over(places) if places else at
                seen = maps.setdefault(_mark(child), set())
                if at.name() not in seen:
                    seen.add(at.name())
                    work.append((child, at, f"{name}/{label}"))
        for needle, pattern, label in VIEWS:
            if needle in layer and (new := _rewritten(layer, pattern, _byte)):
                view, at = new
                data = view.encode("latin-1", "replace")
                for s, e in _streams(data):
                    low, high = span(*at.span(s, e))
                    for k, below, secret in _inside("/stream", _pieces(data, s)):
                        add(low, k, high, f"{name}/{label}{below}", secret)
        told: dict[tuple, Told] = {}
        for s, e in _runs(layer):
            token = layer[s:e]
            if token not in held:
                held[token] = _inside("", iter([_base64(token)]))
            for k, below, secret in held[token]:
                # lines joined to a run say nothing new of what one of them holds
                of = told.setdefault((k, secret), Told())
                if not of.within(s, e):
                    low, high = span(s, e)
                    add(low, k, high, f"{name}/base64{below}", secret)
                    of.add(s, e)
    return sorted(out)


def scan(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id and its findings, those of the base layer with layer ''."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "findings": [findings(t or "") for t in pdf["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, findings {FINDINGS}")


def merged(found: list[tuple]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover all findings."""
    out: list[tuple[int, int]] = []
    for s, _, e, *_ in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask`` (and ``n_chars`` kept true, if there)."""
    columns = docs.columns

    def clean(text: str) -> str:
        spans = merged(findings(text))
        if not spans:
            return text
        out, at = [], 0
        for s, e in spans:
            out += [text[at:s], mask]
            at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore")

    out = docs.withColumn("text", cleaned("text"))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's findings."""
    base = F.filter("findings", lambda s: s["layer"] == "")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))
