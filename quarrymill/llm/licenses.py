"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is any run of so many consecutive words as the template has and a quarter more, wherever lines break. It holds the
template if it has at least THRESHOLD of the template's distinct words, the one that names the license among them. Words are ordered by their frequency over the whole
corpus, rarest first. A block that holds a template has one of the template's first ``n - need + 1`` words (prefix filter), so
only the surroundings of such words are looked at. They must have ``need`` words of the template in all (length filter), and
of the block that starts at a word of the template, the words of the text that are left must be as many (position filter). Only
blocks that pass are compared as sets. Templates are a fixed list, so the prefix index reaches the driver; blocks are made and
verified where their document lies, and nothing is shuffled but the words' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let, text_of, written

#: A word, after lower-casing A-Z; and the same before it.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by which well-known licenses are applied, and their labels.
TEMPLATES = {
    "licensed under cc by": "cc-by",
    "licensed under a creative commons attribution license": "cc-by",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license version 2 0": "mpl-2.0",
    "all rights reserved": "reserved",
    "this work is in the public domain": "public-domain",
}
#: The word of each notice that names the license or its act; without it a block is another text.
NAMES = {
    "licensed under cc by": "cc", "licensed under a creative commons attribution license": "commons", "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license version 3": "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license": "gnu",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lesser", "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "permission", "redistribution and use in source and binary forms with or without modification are permitted": "redistribution",
    "subject to the terms of the mozilla public license version 2 0": "mozilla", "all rights reserved": "reserved", "this work is in the public domain": "domain",
}


def _need(n: int, threshold: float) -> int:
    return max(1, -int(-threshold * n // 1))


def word_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """(word, n): how often each of ``words`` stands in the whole corpus; words that don't are left out."""
    all_words = F.regexp_extract_all(F.translate(text_of(docs), UPPER, LOWER), F.lit(WORD), 0)
    return docs.select(F.explode(F.filter(all_words, lambda w: w.isin(words))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def prefix_index(counts: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD, names: dict[str, str] = NAMES) -> list[tuple[str, list[str], list[str], int, int, str | None]]:
    """(label, words, prefix, need, length, name) of each template: its distinct words, the rarest of which are its prefix, the words
    of a block, and the word that must be among them. ``counts`` (word, n) has no more rows than the templates have words."""
    n = {r["word"]: r["n"] for r in counts.collect()}
    out = []
    for text, label in templates.items():
        words = sorted(set(text.split()), key=lambda w: (n.get(w, 0), w))
        need, length = _need(len(words), threshold), len(text.split())
        out.append((label, words, words[: len(words) - need + 1], need, length + length // 4, names.get(text)))
    return out


def _most(words: Column, at: Column, template: tuple) -> Column:
    """The largest number of the template's words in a block around one of its prefix words, if it is enough; else null.
    ``at`` (i, w) has the places of all templates' prefix words."""
    _, terms, prefix, need, length, name = template
    wanted = F.array(*[F.lit(w) for w in terms])

    def around(a: Column) -> Column:
        since = F.greatest(a["i"] - (length - 1), F.lit(0))
        near = F.slice(words, since + 1, a["i"] - since + length)

        def blocks(x: Column) -> Column:
            named = lambda j: F.array_contains(F.slice(x, j + 1, length), name) if name else F.lit(True)
            size = lambda j: F.when(F.get(x, j).isin(terms) & (F.size(x) - j >= need) & named(j), F.size(F.array_intersect(F.slice(x, j + 1, length), wanted)))
            return F.when((F.size(F.array_intersect(x, wanted)) >= need) & (F.array_contains(x, name) if name else F.lit(True)), F.array_max(F.transform(F.sequence(F.lit(0), F.size(x) - 1), size)))

        return let(near, blocks)

    most = F.array_max(F.transform(F.filter(at, lambda a: a["w"].isin(prefix)), around))
    return F.when(most >= need, most)


def _places(words: Column, phrase: str) -> Column:
    """Places, from 0, at which the words of ``phrase`` stand one after another."""
    first, *rest = phrase.split()
    place = F.transform(words, lambda w, i: F.when(w == first, i))
    return F.filter(F.array_compact(place), lambda i: F.slice(words, i + 2, len(rest)) == F.array(*[F.lit(x) for x in rest]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES, names: dict[str, str] = NAMES) -> DataFrame:
    """One row a document of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base columns are those of the phrases (n_base counts their places, which first_word and last_word bound). labels has
    those of the phrases and of the templates, which need the word that ``names`` has for them, if any; score is the largest containment, 1 for a phrase, 0 without a label. Null and
    empty texts have no words. Every row is judged alone, whatever its doc_id; other columns are left out.
    """
    words = sorted({w for t in templates for w in t.split()})
    index = prefix_index(written(word_counts(docs, words), "license-words"), templates, threshold, names)
    probes = sorted({w for t in index for w in t[2]})
    plain = F.translate(text_of(docs), UPPER, LOWER)
    gap, edge = ANY_CASE.replace("[^", "["), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    seen = f"(?i:{'|'.join(gap.join(p.split()) for p in phrases)}|(?<!{edge})(?:{'|'.join(probes)})(?!{edge}))"
    # only texts with a phrase or a prefix word are taken apart
    low = F.when(text_of(docs).rlike(seen), F.regexp_extract_all(plain, F.lit(WORD), 0))
    rows = docs.select("doc_id", F.regexp_count(text_of(docs), F.lit(ANY_CASE)).cast("long").alias("n_words"), F.coalesce(low, F.array().cast("array<string>")).alias("_w"))
    at = F.array_compact(F.transform("_w", lambda w, i: F.when(w.isin(probes), F.struct(i.alias("i"), w.alias("w")))))
    rows = rows.select("doc_id", "n_words", "_w", at.alias("_at"), *[_places(F.col("_w"), p).alias(f"_p{i}") for i, p in enumerate(phrases)])
    # where no prefix word stands there is nothing to look at
    like = [F.when(F.size("_at") > 0, _most(F.col("_w"), F.col("_at"), t) / len(t[1])) for t in index]
    starts = F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(x)) for i, x in enumerate(phrases.values())]))
    rows = rows.select("doc_id", "n_words", starts.alias("_s"), F.array_distinct(base).alias("_base"), F.array(*[F.struct(F.lit(t[0]).alias("label"), x.alias("like")) for t, x in zip(index, like, strict=True)]).alias("_t"))
    found = F.filter("_t", lambda x: x["like"].isNotNull())
    rows = rows.select("doc_id", "n_words", "_s", "_base", found.alias("_t"))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    labels = F.array_union("_base", F.transform("_t", lambda x: x["label"]))
    score = F.when(F.size("_s") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_t", lambda x: x["like"])), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", F.size("_s").cast("long").alias("n_base"), F.array_min("_s").cast("long").alias("first_word"), F.array_max("_s").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"),
    )
