"""Nested values against a plain reading with a stack, and odd collections."""

import random

from platenlog.functions import codes
from platenlog.operators import attributes, decode, nested
from tests.messages import attr, message

BEGIN, END, NAME = codes.BEGIN_COLLECTION, codes.END_COLLECTION, codes.MEMBER_NAME
NUMBER = codes.INTEGER


def plain_values(tokens):
    """(at, level, collection, member, item, tag, value) of one attribute's values, with a stack of [collection, member, items]."""
    stack, out = [[0, None, 0]], []
    for at, (tag, value) in enumerate(tokens, start=1):
        if tag == END:
            if len(stack) > 1:
                stack.pop()
        elif tag == NAME and len(stack) > 1:
            stack[-1][1:] = [value.decode(), 0]
        else:
            top = stack[-1]
            top[2] += 1
            out.append((at, len(stack) - 1, top[0], top[1], top[2], tag, value))
            if tag == BEGIN:
                stack.append([at, None, 0])
    return out


def values_of(spark, bodies):
    frame = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bodies)], "seq long, body binary")
    return attributes.explode_attributes(decode.decode_messages(frame), "seq")


def body_of(*attributes_of_group):
    parts = [attr(tag, "" if n else name, value) for name, tokens in attributes_of_group for n, (tag, value) in enumerate(tokens)]
    return message(0x000B, b"\x04", *parts)


def number(n):
    return NUMBER, n.to_bytes(4, "big")


def size(x, y):
    return [(BEGIN, b""), (NAME, b"x-dimension"), number(x), (NAME, b"y-dimension"), number(y), (END, b"")]


def test_random_nesting(spark):
    """Balanced or not, closed or not, names and ends anywhere, several values, messages without any value."""
    draw = random.Random(8)
    kinds = [(BEGIN, b""), (BEGIN, b""), (END, b""), (END, b""), (NAME, b"m"), (NAME, b"n"), (NAME, b""), number(7), (codes.KEYWORD, b"k")]
    written = [
        [(f"a{k}", [draw.choice(kinds) for _ in range(draw.randrange(1, 25))]) for k in range(draw.randrange(4))] for _ in range(80)
    ]
    # Deeper than anything a device says.
    written.append([("deep", [token for k in range(300) for token in ((BEGIN, b""), (NAME, b"m%d" % k))] + [number(1)] + [(END, b"")] * 300)])
    got = {}
    for r in nested.nested_values(values_of(spark, [body_of(*w) for w in written]), "seq").collect():
        row = (r.place, r.level, r.collection, r.member, r.item, r.tag, bytes(r.value))
        assert r.opens == (r.tag == BEGIN) and r.group_pos == 1 and r.delimiter == 4
        got.setdefault((r.seq, r.attr_pos, r.name), []).append(row)
    want = {}
    for seq, attributes_of_message in enumerate(written):
        for attr_pos, (name, tokens) in enumerate(attributes_of_message, start=1):
            if rows := plain_values(tokens):
                want[seq, attr_pos, name] = rows
    assert {k: sorted(v) for k, v in got.items()} == want
    assert max(r[1] for r in got[80, 1, "deep"]) == 300


def test_media_sizes(spark):
    ranged = [(BEGIN, b""), (NAME, b"x-dimension"), (codes.RANGE_OF_INTEGER, b"\0\0\0\1\0\0\0\2"), (NAME, b"y-dimension"), number(100), (END, b"")]
    twice = [(BEGIN, b""), (NAME, b"y-dimension"), number(300), number(400), (NAME, b"x-dimension"), number(200), (END, b"")]
    empty = [(BEGIN, b""), (END, b"")]
    inner = [(BEGIN, b""), (NAME, b"media-size"), *size(2, 3), (NAME, b"x-dimension"), number(500), (END, b"")]

    def column(*sizes):
        return [(BEGIN, b""), (NAME, b"media-size"), *[t for s in sizes for t in s], (END, b"")]

    bodies = [
        body_of(("media-col", column(size(21000, 29700)))),
        body_of(("media-col", column(size(1, 2), ranged, twice, empty)), ("media-col-ready", column(size(21590, 27940)))),
        # A size inside a size; a size that is an attribute itself; dimensions without a collection; no value at all.
        body_of(("media-col", column(inner))),
        body_of(("media-size", size(5, 6)), ("x-dimension", [number(9)])),
        message(0x000B, b"\x04"),
    ]
    rows = nested.media_sizes(nested.nested_values(values_of(spark, bodies), "seq"), "seq").collect()
    assert sorted((r.seq, r.name, r.place, r.level, r.width_mm, r.height_mm) for r in rows) == [
        (0, "media-col", 3, 1, 210.0, 297.0),
        (1, "media-col", 3, 1, 0.01, 0.02),
        (1, "media-col", 9, 1, None, 1.0),
        (1, "media-col", 15, 1, 2.0, 3.0),
        (1, "media-col", 22, 1, None, None),
        (1, "media-col-ready", 3, 1, 215.9, 279.4),
        (2, "media-col", 3, 1, 5.0, None),
        (2, "media-col", 5, 2, 0.02, 0.03),
    ]


def test_one_shuffle(spark):
    plan = nested.media_sizes(nested.nested_values(values_of(spark, [message(0x000B, b"\x04")]), "seq"), "seq")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning") <= 2
