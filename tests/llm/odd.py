"""Rows with nulls, empty and very long texts, ties, repeats, and extra columns whose names the operators use themselves."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, key string, row string, size string, taken string, ids string, lang_pred string, signature string, kept string"
WORDS = ["alpha", "beta", "gamma", "delta", "Ünï", "the", "of", "x1", "end."]


def texts():
    rnd = random.Random(11)
    make = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))
    long, passage, base = make(30_000), make(60), make(120)
    near = base.split()
    near[60] = "other"
    return [
        None, "", " \n\t ", "one", "a b c d e", "a b c d e", "a b c d", "All Rights Reserved", "x" * 50_000, long, long, base, " ".join(near), base + "\n" + passage, make(80) + "\n" + passage + "\n" + make(3),
        passage, make(40), "\x1c\x85 q", "l\n\n\nl\nl\n" * 40, "12 34 !!", make(25) + "\n" + make(25), "tie", "tie",
    ]


def docs(spark, parts=3):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", "t", None, "s"][i % 4]) for i, t in enumerate(texts())]
    rows += [(3, "one", "en", "s"), (3, "two texts with one id", "fr", "t"), (None, "a null id here", "en", None), (None, None, None, None)]
    rows = [(*r, 7, 0.5, 9, "k", "r", "z", "t", "i", "p", "g", "q") for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
