"""The operators' results by plain, slow Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[str]:
    return [w for w in re.split(BLANKS, text or "") if w]


def fingerprint(text: str | None, width: int = 3) -> int:
    own = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", own)
    if not tokens:
        return 0
    made = [b" ".join(tokens[k : k + width]) for k in range(len(tokens) - width + 1)] or [b" ".join(tokens)]
    counts = Counter(bit for s in made for bit in range(64) if xxhash.xxh64_intdigest(s, 42) >> bit & 1)
    return sum(1 << bit for bit, n in counts.items() if 2 * n > len(made))


def groups(n: int, linked) -> list[int]:
    """The number of the first member of the group of each of n things."""
    head = list(range(n))

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def alike(a: str, b: str, min_chars: int) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < min_chars or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def lines_left(texts: list[str], min_chars: int) -> list[list[str]]:
    """For texts in order of their documents, the lines that stay."""
    earlier: list[str] = []
    out = []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            blank = not line.strip(" ")
            if blank or not any(alike(line, other, min_chars) for other in earlier):
                kept.append(line)
            if not blank:
                earlier.append(line)
        out.append(kept)
    return out


def substrings(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed, runs, digest of what is left) of each text."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, width: int) -> set[str]:
    own = words((text or "").lower())
    return {" ".join(own[k : k + width]) for k in range(len(own) - width + 1)}


def contained(doc: str | None, item: str | None, width: int = 5, threshold: float = 0.8) -> bool:
    own = words(item)
    if not own:
        return False
    width = min(width, len(own))
    asked = shingles(item, width)
    return len(asked & shingles(doc, width)) >= threshold * len(asked) - 1e-9


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text: str | None) -> list[tuple[str, int, int]]:
    def holds(kind: str, found: str) -> bool:
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(part) <= 255 for part in found.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    ]
