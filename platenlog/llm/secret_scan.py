"""Secrets, also wrapped ones: a worklist of layers, each scanned, unwrapped and mapped back.

A text is the first layer. What a layer holds in percent escapes, Unicode escapes, base64 or
base64 of compressed bytes makes further layers, which are scanned in the same way until
nothing is left to unwrap. A layer whose content has been seen for the same stretch of the
text is not opened again, so archives that unpack to themselves, and escapes that can be
taken off in either order, come to an end. Every find is carried back, layer by layer, to
the characters of the text that it comes from.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
# A stretch that would unpack to more than the text's allowance; it is named, not passed over.
UNOPENED = "unopened"
KINDS = (*BASE_KINDS, UNOPENED)

# Patterns of the base kinds, fixed values; letters of the names in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
# One of these is in every name.
NAMES = (b"passw", b"secret", b"token", b"key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
# Runs of either alphabet; lines of 60 and more go on in the next line. The shortest text with a
# secret in it is 16 characters, and the shortest packed one some 10 bytes, so 12 characters miss nothing.
RUN = re.compile(
    r"(?<![A-Za-z0-9+/])(?:(?:[A-Za-z0-9+/]{60,}\r?\n)+[A-Za-z0-9+/]*|[A-Za-z0-9+/]{12,})={0,2}"
)
URL_RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9]{12,}={0,2}")
CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")

# What a text's layers may hold together, in characters: so much, and so many times its own length.
ALLOWANCE = 16 << 20
ALLOWANCE_TIMES = 16

SPANS = "array<struct<kind:string,start:bigint,end:bigint,via:string>>"

Back = Callable[[int, int], tuple[int, int]]


class Layer(NamedTuple):
    text: str
    back: Back
    via: str


def found_in(text: str) -> Iterator[tuple[str, int, int]]:
    """The base spans of one layer, leftmost and non-overlapping within a kind."""
    low = text.encode("utf-8", "replace").lower()
    if any(name in low for name in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    # A run that is long enough is taken whole, from its first character.
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


def substituted(layer: Layer, swaps: list[tuple[int, int, str]], how: str) -> Layer:
    """The layer's text with stretches replaced by one character each; the rest stays."""
    parts, starts, sources, at, made = [], [], [], 0, 0
    for start, end, char in swaps:
        # A stretch of the old text, then the new character.
        parts += [layer.text[at:start], char]
        starts += [made, made + start - at]
        sources += [(at, None), (start, end)]
        made += start - at + 1
        at = end
    parts.append(layer.text[at:])
    starts.append(made)
    sources.append((at, None))

    def place(k: int) -> tuple[int, int]:
        n = bisect_right(starts, k) - 1
        start, end = sources[n]
        return (start, end) if end is not None else (start + k - starts[n], start + k - starts[n] + 1)

    def back(start: int, end: int) -> tuple[int, int]:
        return layer.back(place(start)[0], place(end - 1)[1])

    return Layer("".join(parts), back, f"{layer.via}>{how}" if layer.via else how)


def percent_swaps(text: str) -> list[tuple[int, int, str]]:
    swaps = []
    for m in PERCENT.finditer(text):
        at = m.start()
        for char in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
            # A byte that is no text is a character of its own.
            odd = "\udc80" <= char <= "\udcff"
            end = at + 3 * (1 if odd else len(char.encode()))
            swaps.append((at, end, "\ufffd" if odd else char))
            at = end
    return swaps


def escape_swaps(text: str) -> list[tuple[int, int, str]]:
    swaps = []
    for m in ESCAPE.finditer(text):
        code = int(m[6]) if m[6] else int(m[m.lastindex], 16)
        sound = code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
        swaps.append((m.start(), m.end(), chr(code) if sound else "\ufffd"))
    return swaps


def unpacked(data: bytes, most: int) -> tuple[bytes | None, bool]:
    """Compressed bytes, unpacked, and whether they came to at most ``most`` bytes; None if they are not compressed."""
    if data[:3] == b"\x1f\x8b\x08":
        opener = zlib.decompressobj(31)
    elif data[:1] == b"\x78" and len(data) > 7 and int.from_bytes(data[:2], "big") % 31 == 0:
        opener = zlib.decompressobj(15)
    elif data[:3] == b"BZh":
        opener = bz2.BZ2Decompressor()
    elif data[:6] == b"\xfd7zXZ\x00":
        opener = lzma.LZMADecompressor()
    else:
        return None, True
    try:
        out = opener.decompress(data, most + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None, True
    return out, len(out) <= most


def decoded(run: str) -> bytes | None:
    bare = run.replace("\r", "").replace("\n", "").rstrip("=")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), altchars=b"-_" if "-" in bare or "_" in bare else None)
    except (binascii.Error, ValueError):
        return None


def runs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Stretches that are base64 of something readable or compressed, and the bytes."""

    def sound(start: int, run: str) -> Iterator[tuple[int, int, bytes]]:
        data = decoded(run)
        if data is not None and (readable(data) is not None or unpacked(data, 0)[0] is not None):
            yield start, start + len(run), data

    for pattern, own in ((RUN, None), (URL_RUN, ("-", "_"))):
        if own and not any(c in text for c in own):
            continue
        for m in pattern.finditer(text):
            run = m.group()
            if own and not any(c in run for c in own):
                continue
            taken = list(sound(m.start(), run))
            # A path or a prefix may stand before what is encoded.
            if not taken and not run.rstrip("=").isalnum():
                taken = [t for p in PIECE.finditer(run) for t in sound(m.start() + p.start(), p.group())]
            yield from taken


def readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(text) else text


def wrapped_in(layer: Layer, room: Callable[[int], int]) -> Iterator[Layer | tuple[int, int]]:
    """The layers that a layer holds; a bare span for what would not fit. ``room`` says what is left, less what is taken."""
    for mark, swaps_of, how in (("%", percent_swaps, "url"), (("\\", "&#"), escape_swaps, "unicode")):
        if any(c in layer.text for c in mark):
            swaps = swaps_of(layer.text)
            if swaps and room(len(layer.text)) >= 0:
                yield substituted(layer, swaps, how)
            elif swaps:
                yield layer.back(swaps[0][0], swaps[-1][1])
    for start, end, data in runs(layer.text):
        via = f"{layer.via}>base64" if layer.via else "base64"
        whole = layer.back(start, end)
        text = readable(data)
        if text is None:
            # Compressed, perhaps several times over.
            seen = set()
            while True:
                digest = hashlib.sha256(data).digest()
                more, fits = unpacked(data, max(room(0), 0)) if digest not in seen else (None, True)
                if not fits:
                    yield whole
                    break
                if more is None:
                    text = data.decode("utf-8", "replace")
                    break
                seen.add(digest)
                data, via = more, f"{via}>packed"
                room(len(more))
            if text is not None:
                yield Layer(text, lambda _a, _b, whole=whole: whole, via)
        elif room(len(text)) >= 0:
            yield Layer(text, _base64_back(layer, start, end, text), via)
        else:
            yield whole


def _base64_back(layer: Layer, start: int, end: int, text: str) -> Back:
    """Three bytes are four characters; line ends between them do not count."""
    run = layer.text[start:end]
    places = None if "\n" not in run else [k for k, c in enumerate(run) if c not in "\r\n"]
    plain = text.isascii()

    def back(a: int, b: int) -> tuple[int, int]:
        first, last = (a, b) if plain else (len(text[:a].encode()), len(text[:b].encode()))
        first, last = 4 * first // 3, -(-4 * last // 3) - 1
        if places is not None:
            first, last = places[first], places[last]
        return layer.back(start + first, start + last + 1)

    return back


def scan(text: str, allowance: int = ALLOWANCE, times: int = ALLOWANCE_TIMES) -> list[dict]:
    """All spans of a text, by start, kind and end; ``via`` is empty for those of the text itself."""
    left = allowance + times * len(text)

    def room(taken: int) -> int:
        nonlocal left
        left -= taken
        return left

    found: dict[tuple[str, int, int], str] = {}
    seen = set()
    work = [Layer(text, lambda a, b: (a, b), "")]
    while work:
        layer = work.pop()
        if not layer.text:
            continue
        if layer.via:
            own = (layer.back(0, len(layer.text)), hashlib.sha256(layer.text.encode("utf-8", "replace")).digest())
            if own in seen:
                continue
            seen.add(own)
        for kind, start, end in found_in(layer.text):
            at = (kind, *layer.back(start, end))
            found[at] = min(layer.via, found.get(at, layer.via))
        for inner in wrapped_in(layer, room):
            if isinstance(inner, Layer):
                work.append(inner)
            else:
                found.setdefault((UNOPENED, *inner), layer.via)
    rank = {kind: k for k, kind in enumerate(KINDS)}
    ordered = sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))
    return [{"kind": k, "start": a, "end": b, "via": found[k, a, b]} for k, a, b in ordered]


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", allowance: int = ALLOWANCE, times: int = ALLOWANCE_TIMES
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``.

    Spans are in code points of the whole text, end exclusive, by start, kind (in the order of
    ``KINDS``) and end, each once. ``via`` names the layers a span was found through, and is
    empty for those of the text itself, which always stay. A find in escapes or base64 is
    mapped to the characters that carry it, one in compressed bytes to the whole run.

    All layers of a text together may hold ``allowance`` characters and ``times`` its length;
    a stretch that would unpack to more has a span of kind ``unopened``. A null or empty text
    has no spans; repeated rows and null ids give one row each; other columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    value = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())])
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [scan(t.as_py() or "", allowance, times) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, value)], ["doc_id", "spans"])

    return rows.mapInArrow(search, f"doc_id bigint, spans {SPANS}")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the text's own spans, all spans as text, and how many were unwrapped, per row of :func:`find_secrets`."""

    def shown(spans):
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    base = F.filter("spans", lambda s: (s["via"] == "") & s["kind"].isin(*BASE_KINDS))

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind in BASE_KINDS],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_unwrapped"),
    )
