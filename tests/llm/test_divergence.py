"""The audit of sources against plain Python, in one block and in many, and its odd inputs."""

import random
import re
from collections import Counter, defaultdict

from platenlog.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = "doc_id bigint, text string, lang string, source string, n bigint, term string, a string"


def plain_audit(rows, least_docs, top):
    docs, groups, counts = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(counter, kept=kept):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(whole)
        pairs = {s: sum(abs(p[t] - x) for t, x in shares(counts[lang, s]).items()) for s in own if s != source}
        terms = {t: p[t] - q[t] for t in kept if counts[lang, source][t] and p[t] > q[t]}
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            best = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(best)]
    return sorted(out)


def found(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


def test_equals_plain(spark):
    draw = random.Random(11)
    words = ["the", "The", "É", "é", "été", "x1y", "foo_bar", "日本", "a", "𝄞", "K", "zz", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = []
    for _ in range(300):
        text = draw.choice([" ", "-", "\n"]).join(draw.choice(words) for _ in range(draw.randrange(12)))
        rows.append((text, draw.choice(["en", "en", "de", None, ""]), draw.choice(["s1", "s10", "s2", None, "é", "Z"])))
    # A text of which there are many copies, over sources; nulls, rows without terms, very long texts.
    rows += [("the same old text", "en", draw.choice(["s1", "s2"])) for _ in range(200)]
    rows += [(None, "en", "only null"), ("12 !", "de", "no terms"), ("w " * 50_000, "en", "long"), ("x", "fr", "s1"), ("y", "fr", "s2")]
    table = spark.createDataFrame([(k, *r, 1, "t", "a") for k, r in enumerate(rows)], ROWS)
    want = plain_audit(rows, 5, 4)
    assert any(r[2] == "pair" and r[0] == "fr" and r[4] == 0 for r in want)
    assert found(divergence.audit_sources(table, least_docs=5, top=4)) == want
    assert found(divergence.audit_sources(table, least_docs=5, top=4, block=2, chunk=3, held=20)) == want
    assert divergence.audit_sources(table.limit(0)).count() == 0


def test_counts_beyond_a_long(spark):
    numbers = spark.sql("select cast(4000000000000000000 as bigint) as n, cast(9000000000000000000 as bigint) as total, 7L as terms")
    got = numbers.select(divergence.smoothed(numbers.n, numbers.total, numbers.terms, 10**9, 5).alias("p")).first().p
    assert got == 1 + 10**9 * (4 * 10**18 + 5) // (9 * 10**18 + 35)
