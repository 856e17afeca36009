"""Secret scanning: the stated patterns one by one, and round trips through nested wrappings."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

from platenlog.llm import secret_scan
from platenlog.llm.queries import QUERIES
from tests.llm.test_texts import ODD, docs

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 12,
    ),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def base_spans(text):
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, (pattern, holds)) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if holds(m)
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_base_spans_random(spark):
    draw = random.Random(7)
    parts = ["token", "Secret", "api_key", "APIKEY", "password", "passwd", "pass", "=", " : ", '"', "'", "AKIA", "AKIAABCD", "0123456789abcdef",
             "deadbeef", "ABCDEF012345", "a-b_c.d/e+f", " ", "\n", "é", "K", "ſecret", "==", "xyz", "%3D", "\\u003d", "dG9rZW49", "&#61;"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(16))) for _ in range(800)] + ODD
    texts += ["token" * 9_000, "a" * 60_000, "AKIA" * 20_000, "%41" * 20_000, "\\u0041" * 9_000, "A" * 50_000]
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in got[k] if s["via"] == ""] == base_spans(text), text[:200]
        order = [(s["start"], secret_scan.KINDS.index(s["kind"]), s["end"]) for s in got[k]]
        assert order == sorted(set(order))
    assert secret_scan.find_secrets(docs(spark, [])).count() == 0


WRAPS = {
    "url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "quote": urllib.parse.quote,
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entity": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "url64": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
    "lines": lambda t: base64.encodebytes((t + " é" * 60).encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
    "zlib": lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    "bz2": lambda t: base64.b64encode(bz2.compress(t.encode())).decode(),
    "xz": lambda t: base64.b64encode(lzma.compress(t.encode())).decode(),
    "twice": lambda t: base64.b64encode(zlib.compress(gzip.compress(t.encode()))).decode(),
}


def test_nested_wrappings():
    """What is wrapped up to five times is found, inside the characters that carry it."""
    draw = random.Random(3)
    for _ in range(400):
        secret = f'token = "{hashlib.sha1(str(draw.random()).encode()).hexdigest()}"'
        wrapped, names = secret, [draw.choice(sorted(WRAPS)) for _ in range(draw.randrange(1, 6))]
        for name in names:
            wrapped = WRAPS[name](wrapped if draw.random() < 0.5 else f"é, so: {wrapped} ;")
        start = len("ßee \n")
        text = "ßee \n" + wrapped + " \nend"
        spans = [s for s in secret_scan.scan(text) if s["kind"] == "assign" and s["via"]]
        assert spans, names
        assert all(start <= s["start"] < s["end"] <= start + len(wrapped) for s in spans), names


def test_spans_are_mapped():
    secret = 'é token = "11acdfb36bb72224148e6160f674b4be45601bff" ü'
    at = secret.index("token"), secret.index('" ü')
    for name in ("url", "unicode", "entity"):
        wrapped = "x " + WRAPS[name](secret)
        (span,) = [s for s in secret_scan.scan(wrapped) if s["kind"] == "assign"]
        assert WRAPS[name](secret[at[0] : at[1]]) == wrapped[span["start"] : span["end"]]
    encoded = WRAPS["base64"](secret)
    (span,) = [s for s in secret_scan.scan(encoded) if s["kind"] == "assign"]
    # The characters that hold its first and its last byte, and no more.
    first, last = len(secret[: at[0]].encode()), len(secret[: at[1]].encode())
    assert (span["start"], span["end"]) == (first * 8 // 6, -(-last * 8 // 6))
    (span,) = [s for s in secret_scan.scan("a/b/" + encoded + "?") if s["kind"] == "assign"] or [{"start": None}]
    assert span["start"] is not None


def test_archives_that_do_not_end():
    """A bomb is named and not opened; one that unpacks to itself, and long chains, come to an end."""
    bomb = base64.b64encode(zlib.compress(b"0" * (1 << 24))).decode()
    found = secret_scan.scan(f"see {bomb}", allowance=1 << 20)
    assert [(s["kind"], s["start"], s["end"]) for s in found if s["kind"] != "hex"] == [("unopened", 4, 4 + len(bomb))]
    assert [(s["kind"], s["via"]) for s in secret_scan.scan(bomb, allowance=1 << 25)] == [("hex", "base64>packed")]
    chain = "token=abcdefghijklmnop"
    for _ in range(30):
        chain = base64.b64encode(zlib.compress(chain.encode())).decode()
    assert any(s["kind"] == "assign" for s in secret_scan.scan(chain))


def test_query(spark):
    rows = QUERIES["op11_secrets"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        assert set(shown.split(",")) <= set(r.spans.split(",")) and r.n_unwrapped == len([s for s in r.spans.split(",") if s]) - len(base)
