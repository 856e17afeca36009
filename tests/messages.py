"""Message bodies for tests, and a plain one-message-at-a-time reading of them."""

from __future__ import annotations

import struct


def attr(tag: int, name: str | bytes, value: bytes) -> bytes:
    name = name.encode() if isinstance(name, str) else name
    return struct.pack(">BH", tag, len(name)) + name + struct.pack(">H", len(value)) + value


CHARSET = attr(0x47, "attributes-charset", b"utf-8")
LANGUAGE = attr(0x48, "attributes-natural-language", b"en")
URI = attr(0x45, "printer-uri", b"ipp://localhost:6310/ipp/print")


def message(code: int, *parts: bytes, version=(1, 1), request_id=42, document=b"", end=b"\x03") -> bytes:
    return bytes(version) + struct.pack(">HI", code, request_id) + b"".join(parts) + end + document


def plain_read(body: bytes):
    """(fixed fields, header length, groups, tokens) or ('end-of-data', need, have) or ('bad-utf8',)."""
    at = 0

    class Wrong(Exception):
        pass

    def take(n):
        nonlocal at
        if len(body) - at < n:
            raise Wrong("end-of-data", n, len(body) - at)
        at += n
        return body[at - n : at]

    def text(raw):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise Wrong("bad-utf8") from None

    least = {0x21: 4, 0x23: 4, 0x31: 11, 0x32: 9, 0x33: 8}
    try:
        fixed = (take(1)[0], take(1)[0], int.from_bytes(take(2), "big"), int.from_bytes(take(4), "big"))
        groups, tokens, attr_pos, value_pos, name = [], [], 0, 0, ""
        while True:
            tag = take(1)[0]
            if tag == 3:
                break
            if tag in (1, 2, 4, 5):
                groups.append(tag)
                attr_pos, value_pos, name = 0, 0, ""
                continue
            if tag <= 0x0F or not groups:
                at -= 1
                break
            own = text(take(int.from_bytes(take(2), "big")))
            value = take(int.from_bytes(take(2), "big"))
            if len(value) < least.get(tag, 0):
                raise Wrong("end-of-data", least[tag], len(value))
            if tag in (0x41, 0x42, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49):
                text(value)
            if own:
                attr_pos, value_pos, name = attr_pos + 1, 1, own
            elif attr_pos:
                value_pos += 1
            tokens.append((len(groups), groups[-1], len(tokens) + 1, attr_pos, value_pos, tag, name, value))
        return fixed, at, groups, tokens
    except Wrong as wrong:
        return wrong.args
