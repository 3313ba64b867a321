"""Small documents with awkward values, and rows of a DataFrame as plain values."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, copies int, lines string"


def word(rng):
    return "".join(rng.choice("the re on an is or ed ly un é ß ж".split()) for _ in range(rng.randint(1, 4)))


def documents(n=60, seed=1):
    rng = random.Random(seed)
    texts = [" ".join(word(rng) for _ in range(rng.randint(3, 60))) for _ in range(n)]
    texts += [None, None, "", " \n ", "!!! 123", "a", "A", "É", "é", texts[0], texts[0].upper(), texts[1] + " x", "word " * 3000, "z" * 20000]
    texts += [texts[2].replace(" ", "\n"), "emoji 🎉🎉 done", "\u00a0\u2003 wide   gaps \r\n\tend  "]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), 0, "x", "y", 1, "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, texts[4], "en", "a", 0, "x", "y", 1, "z"), (None, texts[5], "en", "b", 0, "x", "y", 1, "z")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def values(df, *names):
    return sorted((tuple(r[n] for n in names) if names else tuple(r) for r in df.collect()), key=repr)
