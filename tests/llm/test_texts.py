"""Chat formatting, personal data, packing and sharding against plain Python, and their odd inputs."""

import hashlib
import itertools
import random
import time
import tracemalloc
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from platenlog.llm import chat, packing, pii, sharding
from tests.llm import plain

DOCS = "doc_id bigint, text string, spans string, n int, size string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "x", 1, None) for k, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t ", "one", "one", "word " * 30_000, "é ü\nñ", "<|im_end|> & &amp; &lt;|"]


# Chat


def test_chat_reads_back(spark):
    """Nulls, ties, markers inside texts, neighbours of one role, an extra column with a clashing name."""
    rows = [
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "<|im_end|>\n<|im_start|>user\nx"),
        (1, 3, "assistant", "<|im_more|>&lt;|&amp;"), (1, 4, "assistant", ""), (2, None, None, None),
        (2, 0, "assistant", "late"), (2, 0, "assistant", "late"), (None, 0, "odd\nrole<|", "&#10;|"), (3, 0, "user", "<"),
        (4, 0, "assistant", "|>é𝄞"), (5, 0, "user", "y" * 300_000),
    ]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert len(got) == 6
    for conv in {r[0] for r in rows}:
        want = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in got[conv].turns] == [w[2:] for w in want]
        assert got[conv].loss_text == "".join(w[3] for w in want if w[2] == "assistant")
    shown = {r.conv_id: r for r in made.collect()}
    assert shown[1].formatted.startswith("<|im_start|>user\na<|im_more|>b<|im_end|>\n<|im_start|>assistant\n")
    assert shown[1].formatted.count("<|im_start|>") == 2
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    """More pieces than a block, byte order marks and wide characters, and time in proportion."""
    said = ["\ufeffa", "é𝄞", "", "<|x", "plain words"]
    seconds = {}
    for n in (4_000, 4_000, 16_000):
        rows = spark.range(n).select(
            F.lit(1).cast("bigint").alias("conv_id"),
            F.col("id").alias("turn"),
            F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
            F.get(F.array(*[F.lit(t) for t in said]), (F.col("id") % len(said)).cast("int")).alias("text"),
        )
        begun = time.monotonic()
        row = chat.read_back(chat.format_conversations(rows)).first()
        seconds[n] = time.monotonic() - begun
        assert [t.text for t in row.turns] == [said[k % len(said)] for k in range(n)]
        assert row.loss_text == "".join(said[k % len(said)] for k in range(n) if k % 3)
    assert seconds[16_000] < 8 * seconds[4_000] + 1


# Personal data


def test_pii_random(spark):
    draw = random.Random(5)
    parts = ["a@b.co", "@", ".", "+49 (30) 1234-567", "4111 1111 1111 1111", "5500005555555559", "1.2.3.4", "300.1.1.1", "é",
             "1.2.3.4.5", "-", " ", "007", "+", "x_y", "12", "a@b.c_d@e.f", "..@x.y", "\n"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(600)] + ODD
    texts += ["1" * 50_000, "." * 20_000 + "@", "a@" * 5_000, "+1" * 5_000, "1." * 9_000, "%" * 50_000]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts)).collect()}
    for k, text in enumerate(texts):
        base = [(s["kind"], s["start"], s["end"]) for s in got[k] if s["kind"] in pii.BASE_KINDS]
        assert base == plain.personal(text), text
    assert pii.pii_digest(pii.find_pii(docs(spark, []))).count() == 0


def test_pii_checks_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00.", "DE88370400440532013000", "ssn 123-45-6789", "part 123-45-6789", "visa 4111111111111111", "4111111111111111"]
    got = [{s.kind: s.score for s in r.spans} for r in pii.find_pii(docs(spark, texts)).orderBy("doc_id").collect()]
    assert "iban" in got[0] and "iban" not in got[1] and "ssn" in got[2] and "ssn" not in got[3]
    assert got[4]["card"] > got[5]["card"]
    row = pii.pii_digest(pii.find_pii(docs(spark, ["é a@b.co 1.2.3.4"]))).first()
    assert row.n_email == 1 and row.n_ip == 1 and row.spans == "email:2:8,ip:9:16"
    assert row.base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()


def test_pii_account_numbers():
    """A country's length ends a number, whatever capitals follow; unknown countries take what there is."""
    known = "DE89 3704 0044 0532 0130 00"
    for text, want in {
        f"IBAN {known} BIC COBADEFFXXX": [known],
        f"{known} {known}": [known, known],
        f"{known}X": [],
        f"A{known}": [],
        "GB82WEST12345698765432 NOW": ["GB82WEST12345698765432"],
        "NO93 8601 1117 947": ["NO93 8601 1117 947"],
        "DE12 NO93 8601 1117 947": ["NO93 8601 1117 947"],
        "DE89  3704 0044 0532 0130 00": [],
        "ZZ00" * 20_000: [],
        "": [],
    }.items():
        assert [text[a:b] for a, b in pii.accounts(text)] == want, text[:60]
    # No country ZZ: the whole run, which has to pass by itself.
    body = "0123456789AB"
    code = next(f"ZZ{k:02d}{body}" for k in range(100) if pii.mod97(f"ZZ{k:02d}{body}"))
    assert [code[a:b] for a, b in pii.accounts(code)] == [code]


# Packing


def test_bounds_are_best():
    draw = random.Random(3)
    for _ in range(60):
        counts = {draw.randrange(1, 30): draw.randrange(1, 9) for _ in range(draw.randrange(1, 9))}
        k = draw.randrange(1, 5)

        def padding(bounds, counts=counts):
            return sum(c * min(b for b in bounds if b >= n) for n, c in counts.items())

        best = min(
            padding((*some, max(counts)))
            for size in range(k)
            for some in itertools.combinations(sorted(counts)[:-1], min(size, len(counts) - 1))
        )
        bounds = packing.best_bounds(counts, k)
        assert len(bounds) <= k and bounds == sorted(bounds) and padding(bounds) == best
    assert packing.best_bounds({}, 3) == []


def test_bounds_of_many_lengths():
    """All lengths against all would be over 100 MB of the driver."""
    tracemalloc.start()
    bounds = packing.best_bounds({n: n % 7 + 1 for n in range(1, 2049)}, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(bounds) == 8 and bounds[-1] == 2048 and most < 16 << 20


def test_pack(spark):
    texts = ODD + [" ".join("w" * (k % 37)) for k in range(900)]
    rows = packing.pack(docs(spark, texts), max_len=64, buckets=4, budget=256).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == len(plain.words(text)) + 1
        assert [r.first_word for r in own] == [64 * j for j in range(len(own))] and max(r.n_tokens for r in own) <= 64
    batches: dict = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), own in batches.items():
        room = max(1, 256 // own[0].bucket_len)
        assert sorted(r.place for r in own) == list(range(len(own))) and len(own) <= room
        assert len(own) == room or (bucket, batch + 1) not in batches
    assert len({b for b, _ in batches}) <= 4
    assert packing.pack(docs(spark, []), max_len=64).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], "doc_id long, text string")
    assert packing.pack(twice).count() == 3


# Sharding


def test_shards(spark):
    draw = random.Random(4)
    texts = ["x" * draw.randrange(400) for _ in range(3000)] + ["same text"] * 1500 + ODD[:5]
    rows = sharding.shard_documents(docs(spark, texts), 10, block_rows=(50, 50)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    bytes_, slots = {}, {}
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 16
        bytes_[r.shard] = bytes_.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(bytes_.values()) / 10
    assert len(bytes_) == 10 and max(bytes_.values()) < 1.02 * mean and min(bytes_.values()) > 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs(spark, []), 10).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (3, None)], "doc_id long, text string")
    assert sorted(r["size"] for r in sharding.shard_documents(odd, 4).collect()) == [16, 17, 17]


def test_ring_moves_only_what_overflows():
    owners = [s for _, s in sharding.ring_points(8, 16)]
    draw = random.Random(1)
    sizes = [draw.randrange(100) for _ in owners]
    pieces = sharding.walk_ring(sizes, owners, 8, Fraction(1, 10))
    limit = -(-sum(sizes) * Fraction(11, 10) // 8)
    load, moved = [0] * 8, 0
    for arc in range(len(owners)):
        own = sorted(p for p in pieces if p[0] == arc)
        ends = [p[1] for p in own[1:]] + [sizes[arc]]
        for (_, start, shard), end in zip(own, ends, strict=True):
            load[shard] += end - start
            moved += (end - start) * (shard != owners[arc])
    natural = [sum(s for s, o in zip(sizes, owners, strict=True) if o == k) for k in range(8)]
    assert sum(load) == sum(sizes) and max(load) <= limit
    assert moved == sum(max(0, n - int(limit)) for n in natural)


@pytest.mark.parametrize("name", ["op1_packing", "op6_chat", "op8_lines", "op10_decontamination"])
def test_query_equals_sql(spark, name):
    from platenlog.llm.expected_sql import EXPECTED
    from platenlog.llm.queries import QUERIES
    from tests.compare import database, difference

    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) and difference(got, database(sf).sql(EXPECTED[name]).df()) is None


def test_query_rows(spark):
    from platenlog.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    placed = QUERIES["op5_sharding"](spark, sf)
    assert placed.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert placed.count() == n and placed.select(F.max("shard")).first()[0] < 40
    found = QUERIES["op9_pii"](spark, sf)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert found.count() == n
