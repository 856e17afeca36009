"""Near duplicates, lines, substrings and benchmark items against plain Python, and their odd inputs."""

import random

import numpy as np

from platenlog.llm import bwt, components, decontamination, lines, simhash, substrings
from tests.llm import plain
from tests.llm.test_texts import ODD, docs

SF = "/root/testdata/sf0.001"


def rows_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()


# Near duplicates


def test_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    near = {tuple(sorted(x)) for x in links}
    heads = plain.groups(441, lambda a, b: (b, a) in near)
    assert all(heads[k] == root for k, root in got.items())
    assert set(got) == {k for x in links if x[0] != x[1] for k in x}


def test_simhash_equals_all_pairs(spark):
    """Fingerprints of crowds around two centres, crowded and uncrowded ways alike."""
    draw = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(2):
        centre = draw.getrandbits(64)
        fps |= {centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) & (1 << 64) - 1 for _ in range(150)}
    own = [simhash._signed(x & (1 << 64) - 1) for x in sorted(fps)]
    heads = plain.groups(len(own), lambda a, b: ((own[a] ^ own[b]) & (1 << 64) - 1).bit_count() <= 2)
    table = spark.createDataFrame([(x,) for x in own], "fp long")
    for crowd in (2, 20, 1000):
        found = simhash.links(table, crowd)
        assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() is not None for r in found.take(1))
        roots = {r.node: r.root for r in components.components(found).collect()}
        grouped: dict = {}
        for k, x in enumerate(own):
            grouped.setdefault(roots.get(x, x), set()).add(k)
        wanted: dict = {}
        for k, head in enumerate(heads):
            wanted.setdefault(head, set()).add(k)
        assert sorted(map(sorted, grouped.values())) == sorted(map(sorted, wanted.values())), crowd


def test_near_duplicates(spark):
    texts = [r.text for r in rows_of(spark)] + ODD
    got = simhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    fps = [plain.fingerprint(t) for t in texts]
    assert [r.fp & (1 << 64) - 1 for r in got] == fps
    assert [r.component_id for r in got] == plain.groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    """Repeated rows, repeated ids, null ids and texts, extra columns: one row of each group."""
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "q r s t"), (None, "q r s t"), (5, None), (6, ""), (7, "x y z"), (7, "other words here")]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, component_id string")
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == [(False, 0, "q r s t"), (True, 1, "a b c d"), (True, 5, ""), (True, 7, "other words here"), (True, 7, "x y z")]
    assert simhash.keep_one(table.limit(0)).count() == 0


# Lines


def check_lines(spark, texts, min_chars):
    table = docs(spark, texts)
    got = {r.doc_id: r for r in lines.dedup_lines(table, min_chars=min_chars).collect()}
    for k, left in enumerate(plain.lines_left([t or "" for t in texts], min_chars)):
        if texts[k] is None:
            assert got[k].text is None
        else:
            assert got[k].text == "\n".join(left), (k, texts[k])
        all_lines = (texts[k] or "").split("\n")
        assert got[k]["__lines"] == len(all_lines) and got[k]["__removed"] == len(all_lines) - len(left)


def test_lines_random(spark):
    draw = random.Random(8)
    base = ["".join(draw.choice("ab") for _ in range(draw.randrange(2, 15))) for _ in range(12)]

    def line():
        own = list(draw.choice(base))
        for _ in range(draw.randrange(3)):
            k = draw.randrange(len(own) + 1)
            own[k : k + draw.randrange(2)] = draw.choice(["", "a", "é"])
        return "".join(own)

    check_lines(spark, ["\n".join(line() for _ in range(draw.randrange(6))) for _ in range(60)], 4)


def test_lines_of_documents(spark):
    check_lines(spark, [r.text for r in rows_of(spark)][:60] + ODD + ["\n\n", " \n ", "x" * 40_000, "x" * 39_999 + "y"], 20)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_lines_plan_is_short(spark):
    """The driver plans and compiles the search for near lines once, and not for each time that its lines are read."""
    near = lines.near_lines(docs(spark, [r.text for r in rows_of(spark)][:60]), "doc_id", "text", 20, 1000)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange ") < 20 and plan.count("Generate") < 8, plan.count("Exchange ")


def test_lines_odd_rows(spark):
    rows = [(None, "a line of its own"), (1, "a line of its own"), (1, "another line"), (2, "another line"), (2, "another line")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, line string")
    kept = lines.dedup_lines(table)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(False, 0, "a line of its own"), (True, 1, ""), (True, 1, "another line"), (True, 2, ""), (True, 2, "")]
    assert "line" in kept.columns


# Substrings


def test_bwt():
    draw = random.Random(1)
    for _ in range(150):
        length = draw.choice([8, 9, 12, 20, 40])
        base = [bytes(draw.choice(b"ab") if draw.random() < 0.8 else draw.randrange(256) for _ in range(draw.randrange(120))) for _ in range(4)]
        texts = [b"".join(draw.choice(base) for _ in range(draw.randrange(3)))[draw.randrange(9) :] for _ in range(draw.randrange(1, 7))]
        seen: dict = {}
        for t in texts:
            for k in range(len(t) - length + 1):
                seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
        want = [[k for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1] for t in texts]
        assert [x.tolist() for x in bwt.repeated_starts(texts, length)] == want


def check_substrings(spark, texts, **settings):
    length = settings.get("length", 200)
    got = substrings.dedup_substrings(docs(spark, texts), **settings).orderBy("doc_id").collect()
    want = plain.substrings([(t or "").encode() for t in texts], length)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want


def test_substrings_random(spark):
    draw = random.Random(9)
    base = ["".join(draw.choice("abé ") for _ in range(draw.randrange(60))) for _ in range(8)]
    texts = ["".join(draw.choice(base) for _ in range(draw.randrange(6))) for _ in range(80)] + ODD + ["z" * 500]
    for crowd in (1, 3, 10_000):
        check_substrings(spark, texts, length=40, gram=12, crowd=crowd, shard_bytes=4000)


def test_stretches_of_one_text_merge():
    """A narrow stretch inside a wider one does not end it; stretches of other shards stay apart."""
    first, last = np.array([143, 100, 101, 100, 300]), np.array([185, 142, 140, 142, 310])
    assert substrings._merged(np.array([0, 0, 0, 1, 0]), first, last) == [(0, 100, 185), (0, 300, 310), (1, 100, 142)]
    assert substrings._merged(first[:0], first[:0], first[:0]) == []


def test_substrings_beside_one_passage(spark):
    """One passage in many texts with other bytes beside it, some of which repeat."""
    draw = random.Random(12)
    passage = "".join(draw.choice("abcd") for _ in range(34))
    sides = ["".join(draw.choice("ab") for _ in range(draw.randrange(30))) for _ in range(6)]
    texts = [draw.choice(sides) + passage + draw.choice(sides) + passage[: draw.randrange(34)] for _ in range(120)]
    for crowd in (2, 10_000):
        check_substrings(spark, texts, length=40, gram=12, crowd=crowd, shard_bytes=2000)


def test_substrings_of_documents(spark):
    check_substrings(spark, [r.text for r in rows_of(spark)] + ["q" * 199, "r" * 200, "s" * 201])
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    draw = np.random.default_rng(3)
    long = bytes(draw.integers(97, 123, 30_000, dtype=np.uint8)).decode()
    whole = substrings.anchors([long.encode()], 200, 32)
    monkeypatch.setattr(substrings, "SLAB", 4000)
    parts: list = []
    import pyarrow as pa

    for own in substrings._slabs(pa.array([long.encode()]), 200):
        owner, at, anchor, around = substrings.anchors([p for _, _, p, _, _ in own], 200, 32)
        for k, a, x, y in zip(owner, at, anchor, around, strict=True):
            if own[k][3] <= own[k][1] + a < own[k][4]:
                parts.append((own[k][1] + a, x, y))
    assert sorted(parts) == sorted(zip(*whole[1:], strict=True))


# Benchmark items


def test_contained_items(spark):
    documents = [r.text for r in rows_of(spark)][:80] + ODD
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:25]
    items += [None, "", "one", "two words", "word word word word", "é ü ñ", "A B C D E F G H I J K"]
    some = items[3].split()
    documents += [items[4].upper(), "x " + " ".join(some[:-1]) + " y", " ".join(some[: len(some) // 2]), "a b c d e f g h i j z k"]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, mark string")
    want = {(d, k) for d, doc in enumerate(documents) for k, item in enumerate(items) if plain.contained(doc, item)}
    assert len(want) > 5
    for most in (0, 10**6):
        found = decontamination.contaminated(docs(spark, documents), bench, broadcast_hashes=most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    clean = decontamination.without_contaminated(docs(spark, documents), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(len(documents))) - {d for d, _ in want})
    assert clean.columns == docs(spark, []).columns
    assert decontamination.contaminated(docs(spark, []), bench).count() == 0
    assert decontamination.contaminated(docs(spark, documents), bench.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, items[4]), (None, items[4])], "doc_id long, text string")
    assert decontamination.contaminated(odd, bench).count() == 2
