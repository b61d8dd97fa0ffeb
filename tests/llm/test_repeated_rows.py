"""Tables whose rows are repeated give what the rows alone give."""

import random

from pyspark.sql import functions as F

from mnemoweave.llm import op04_minhash, op09_langid
from mnemoweave.llm._common import Scratch


def test_minhash_of_repeated_rows(spark):
    rng, rows = random.Random(4), []
    for f in range(8):
        words, chain = [f"w{rng.randrange(10**9)}" for _ in range(120)], []
        for i in range(5):  # neighbours are 0.83 similar, others less than 0.7
            for at in (10 + 20 * i, 20 + 20 * i, 119):
                words[at] = f"w{rng.randrange(10**9)}"
            chain.append(" ".join(words))
        # the second and fourth have the least ids: a star links the third to one of them
        rows += [(10 * f + n, chain[i]) for n, i in enumerate((1, 3, 2, 0, 4))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = op04_minhash.near_duplicates(docs, Scratch(spark, "twice"), rounds=0).collect()
    assert len(got) == 2 * len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: i - i % 10 for i, _ in rows}


def test_langid_learns_from_copies(spark):
    many = spark.range(30_000).select(F.lit("ein Satz, der oft kopiert ist").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([("une phrase", "fr"), ("encore une phrase", "fr")], "text string, lang string")
    got = op09_langid.training_sample(many.unionByName(few).unionByName(few))
    assert got["de"].decode() == "ein satz, der oft kopiert ist"
    assert sorted(got["fr"].decode().split("\n")) == ["encore une phrase", "une phrase"]
