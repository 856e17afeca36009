"""Language stage: foreign and gibberish texts go, labelled ones stay."""

import random

import corpus_pipeline

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
]


def test_foreign_texts_go(spark):
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    gibberish = ["".join(draw.choice(letters) for _ in range(200)), " ".join("".join(draw.sample(letters, 6)) for _ in range(40))]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(FOREIGN + gibberish)], docs.schema)
    kept = dict(corpus_pipeline.STAGES)["language"](spark, docs.unionByName(planted), SF)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
