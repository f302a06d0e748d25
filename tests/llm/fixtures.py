"""Small tables with everything that operators must stand: nulls, repeats, long and empty texts, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, blob string, n int, component long"


def words(rng: random.Random, n: int, kinds: int = 400) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = words(rng, 120)
    passage = words(rng, 40)
    changed = base.split()
    changed[60] = "other"
    texts = [base, base, " ".join(changed), words(rng, 80) + " " + passage + " " + words(rng, 50), passage + " " + words(rng, 30), words(rng, 90) + "\n" + passage, None, "", "   ", "é" * 150 + " " + "é" * 150, "a" * 900, words(rng, 3), words(rng, 3), "ab" * 300, "12345 !!", words(rng, 4000), passage, "The end.\n\n  Next\tone."]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], len(t or ""), 7, "k", "b", 1, 2) for i, t in enumerate(texts)]
    return rows


def messy(seed: int = 1) -> list[tuple]:
    """As documents(), with repeated rows, a repeated id with another text, and null ids."""
    rows = documents(seed)
    return [*rows, rows[0], rows[3], (2, "another text " * 20, "en", "s2", 10, None, None, None, None, None), (None, rows[0][1], "en", "s1", 1, 1, "x", "y", 2, 3), (None, None, None, None, None, None, None, None, None, None)]


def write(spark, folder, rows, schema=SCHEMA, name="documents") -> str:
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
