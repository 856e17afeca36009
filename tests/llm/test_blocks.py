"""Sharding on arcs of many blocks: a cut parts at most the group it falls in."""

from collections import Counter, defaultdict

from platenlog.llm import sharding


def test_copies_stay_together(spark):
    texts = [f"text {k % 1200} {'x' * (k % 1200 % 37)}" for k in range(7200)]
    for rows in (texts, texts + ["hot"] * 900):
        table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        got = sharding.shard_documents(table, 3, nodes=2, block_rows=(64, 64)).collect()
        assert sorted(r.doc_id for r in got) == list(range(len(rows)))
        shards, slots, loads = defaultdict(set), defaultdict(list), Counter()
        for r in got:
            shards[rows[r.doc_id]].add(r.shard)
            slots[r.shard].append(r.slot)
            loads[r.shard] += r.size
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        # Three shards: an arc is cut where a shard is full.
        assert sum(len(s) > 1 for s in shards.values()) <= 3
        assert max(loads.values()) <= sum(loads.values()) / 3 * 1.001 + 6 * 70
