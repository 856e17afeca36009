"""Hard negatives against plain Python, in one unit of work and in many, and their odd inputs."""

import random

from pyspark.sql import functions as F

from platenlog.llm import negatives

ROWS = "vec_id bigint, embedding array<double>, label bigint, slot int, score string, block string"


def plain_mine(rows, anchors, low=30, high=90):
    own = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        whole = [int(256 * x // 1) for x in vector]
        own[vec_id] = min(own.get(vec_id, (label, vector, whole)), (label, vector, whole))
    out = []
    for a in anchors:
        if a not in own:
            continue
        label, vector, whole = own[a]
        scored = [
            (-sum(x * y for x, y in zip(whole, w, strict=True)), k, other == label)
            for k, (other, v, w) in own.items()
            if k != a and len(v) == len(vector)
        ]
        scored.sort()
        for minus, positive, _ in [s for s in scored if s[2]][:5]:
            inside = [(n, k) for n, k, same in scored if not same and low * -minus <= 100 * -n <= high * -minus]
            out += [(a, positive, rank + 1, k, -minus, -n) for rank, (n, k) in enumerate(inside[:10])]
    return sorted(out)


def mined(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_equals_plain(spark):
    draw = random.Random(2)
    rows = [(k, [draw.gauss(0, 1) + (k % 3) for _ in range(6)], k % 4) for k in range(300)]
    # Equal vectors, so that scores tie; vectors of few values; another length; an id twice.
    rows += [(400 + k, rows[k % 5][1], k % 2) for k in range(60)]
    rows += [(500 + k, [float(draw.randrange(-1, 2)) for _ in range(6)], draw.randrange(3)) for k in range(120)]
    rows += [(700 + k, [1.0, 2.0], k % 2) for k in range(20)] + [(3, [0.0] * 6, 9), (3, [0.0] * 6, 9), (-100, [0.5] * 6, 1)]
    rows += [(800, None, 1), (801, [1.0] * 6, None), (802, [1.0, None, 0, 0, 0, 0], 1), (803, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (804, [float("inf")] * 6, 1), (805, [], 0), (806, [], 1)]
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], c) for k, v, c in rows]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS)
    asked = [k for k in range(-100, 900) if k % 10 == 0]
    anchors = spark.createDataFrame([(k,) for k in [*asked, asked[0], None]], "vec_id bigint")
    want = plain_mine(rows, asked)
    assert len(want) > 1000
    assert mined(negatives.mine_negatives(table, anchors)) == want
    assert mined(negatives.mine_negatives(table, anchors, anchor_bytes=600, slot_bytes=900)) == want
    assert negatives.mine_negatives(table.limit(0), anchors).count() == 0
    assert negatives.mine_negatives(table, anchors.limit(0)).count() == 0


def test_scores_of_any_size(spark):
    for scale in (2.0**18, 2.0**26, 2.0**31):
        draw = random.Random(int(scale))
        rows = [(k, [draw.randrange(1, 1000) / 8 * scale ** 0.5 for _ in range(3)], k % 2) for k in range(60)]
        table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS)
        anchors = table.where(F.col("vec_id") % 20 == 0)
        assert mined(negatives.mine_negatives(table, anchors)) == plain_mine(rows, [0, 20, 40])
    huge = spark.createDataFrame([(k, [1e150, float(k)], k % 2, 1, "x", "y") for k in range(8)], ROWS)
    got = mined(negatives.mine_negatives(huge, huge.where("vec_id = 0")))
    assert got == []  # all scores are held at the end of a long, so none is below a positive's


def test_pass_down_the_keys():
    """Windows open at positives, close when full or passed, and a tie at 0 goes in after its positive."""

    def key(score, negative, ids):
        flip = 1 << 63
        return (5 + flip).to_bytes(8, "big") + (flip - 1 - score).to_bytes(8, "big") + bytes([negative]) + (ids + flip).to_bytes(8, "big")

    rows = [key(100, 0, 1), key(95, 1, 2), key(90, 1, 3), key(50, 0, 4), key(45, 1, 6), key(30, 1, 7), key(29, 1, 8), key(0, 0, 9), key(0, 1, 2), key(-5, 0, 3)]
    assert rows == sorted(rows)
    got = [(p, rank, n) for _, p, rank, n, _, _ in negatives.opened(iter(rows), 2, 30, 90)]
    assert got == [(1, 1, 3), (1, 2, 6), (4, 1, 6), (4, 2, 7), (9, 1, 2)]
