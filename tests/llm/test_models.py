"""Language identification and neighbour search: held-out accuracy, recall, and their odd inputs."""

import numpy as np

from platenlog.llm import ann, graph, language
from platenlog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = QUERIES["op4_language"](spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(spark):
    texts = [None, "", "12 !!", "the and", "é", "ж" * 5, "the " * 40_000]
    rows = [(k, "the cat and the hat", "en") for k in range(20)] + [(50 + k, "der die und das", "de") for k in range(20)]
    rows += [(100 + k, t, None) for k, t in enumerate(texts)] + [(None, "der die", "de"), (None, "der die", "de")]
    table = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(table).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows)
    assert [by[100 + k].lang_pred for k in range(3)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "en" and by[106].lang_pred == "en" and by[104].lang_pred in ("en", "de")
    assert all(r.lang_pred == "de" and not r.held_out for r in got if r.doc_id is None)
    assert language.identify(table.limit(0)).count() == 0
    alone = language.identify(table.where("lang is null")).collect()
    assert {r.lang_pred for r in alone} == {"und"}
    kept = language.accepted(table, least=0.0)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3


def test_language_of_copies(spark):
    """Forty texts in 40,000 rows, or one text in all of them, are a language like one of 300 different texts."""
    words = ["the cat", "and the", "hat with", "this thing", "those who", "there was"]
    many = [(k, f"{words[k % 6]} {words[k // 6 % 6]} {k % 40 % 7}", "en") for k in range(40)]
    rows = [(k, many[k % 40][1], "en") for k in range(40_000)] + [(50_000 + k, "o rato roeu a roupa", "pt") for k in range(40_000)]
    rows += [(100_000 + k, f"der die und das {'abcdefghijklmnop'[k % 16]}{k}", "de") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(table)
    assert model.languages == ["de", "en", "pt"]
    asked = spark.createDataFrame([(1, "the hat and the cat"), (2, "die und der"), (3, "o rato roeu")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(asked.selectExpr("*", "string(null) as lang"), model=model).collect()}
    assert got == {1: "en", 2: "de", 3: "pt"}


def test_many_labels(spark):
    """Five hundred labels are all learned, by a bounded number of texts and landmarks."""
    draw = np.random.default_rng(4)
    own = ["".join(chr(97 + c) for c in draw.integers(0, 26, 5)) for _ in range(1000)]
    rows = [(k, f"{own[2 * (k % 500)]} {own[2 * (k % 500) + 1]} {k}", f"l{k % 500}") for k in range(3000)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 500 and model.presence.shape[1] <= language.ALL_LANDMARKS
    codes = [language.grams(text) for _, text, _ in rows]
    best = [model.languages[k] for k in model.scores(codes).argmax(axis=1)]
    assert np.mean([a == lang for a, (_, _, lang) in zip(best, rows, strict=True)]) > 0.95


def test_kernel_and_ridge_by_hand():
    """Scores equal ridge regression written out on the kernel's own features."""
    texts = [("a", "abc abd"), ("a", "abd abe"), ("b", "xyz xyw"), ("b", "xyw abc"), ("c", "qrs"), ("a", "abc"), ("c", "qrt q")]
    samples = [(lang, language.grams(text)) for lang, text in texts]
    model = language.fit(samples, landmarks=2, ridge=0.1)
    marks = [set(c) for lang in "abc" for c in [set(c.tolist()) for x, c in samples if x == lang][:2]]

    def k(x, y):
        return len(x & y) / np.sqrt(len(x) * len(y))

    between = np.array([[k(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(between)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = np.array([[k(set(c.tolist()), m) for m in marks] for _, c in samples]) @ root
    targets = np.array([[1.0 if lang == x else -1.0 for x in "abc"] for lang, _ in samples])
    design = np.hstack([features, np.ones((len(samples), 1))])
    penalty = 0.1 * len(samples) * np.eye(design.shape[1])
    penalty[-1, -1] = 0
    weight = np.array([len(samples) / 3 / sum(x == lang for x, _ in samples) for lang, _ in samples])[:, None]
    by_hand = design @ np.linalg.solve(design.T @ (weight * design) + penalty, design.T @ (weight * targets))
    assert np.allclose(model.scores([c for _, c in samples]), by_hand, atol=1e-4)


def exact(vectors: dict, query, own):
    near = [(-float(np.dot(np.float64(v), np.float64(query))), k) for k, v in vectors.items() if k != own]
    return [k for _, k in sorted(near)]


def test_graph_recall():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(3000, 24)).astype(np.float32) * draw.uniform(0.2, 3, size=(3000, 1)).astype(np.float32)
    built = graph.build(points)
    found, _ = built.search(np.concatenate((points[:200], np.zeros((200, 1), np.float32)), axis=1), 96)
    near = np.argsort(-(points[:200] @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found[:, :20], near, strict=True)]) > 0.95


def test_neighbours(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = QUERIES["op7_ann"](spark, SF).collect()
    own = {r.vec_id: r.embedding for r in vectors.collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {k for k in own if k % 20 == 0}
    hits = 0
    for k, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and k not in {r.vec_id for r in found}
        assert all(a.score >= b.score for a, b in zip(found, found[1:], strict=False))
        hits += len({r.vec_id for r in found} & set(exact(own, own[k], k)[:20]))
    assert hits / (20 * len(by)) >= 0.9


def test_neighbours_odd(spark):
    """Nulls, zeros, infinities, other lengths, ties, repeated rows, a vector that very many share."""
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(100, [0.5, 0.5]), (100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0])]
    rows += [(103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [3.0]), (None, [9.0, 9.0]), (107, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = ann.nearest_neighbours(table, table.where("vec_id in (0, 100, 101, 102, 106)")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 100}
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in got if r.query_id == 100] == list(range(20))
    few = ann.nearest_neighbours(table.where("vec_id >= 59"), table.where("vec_id = 100")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in few] == [(1, 59, 0.5)]
    assert ann.nearest_neighbours(table.limit(0), table).count() == 0
    assert ann.nearest_neighbours(table, table.limit(0)).count() == 0
