"""Token search and guide texts against plain versions."""

import random
import re

from pyspark.sql import functions as F

from quarrymill.operators import guides as G
from quarrymill.operators import search


def test_tokens_meet_the_texts_that_hold_them(spark):
    rnd = random.Random(3)
    words = ["abc", "abcd", "bc", "c", "大安", "大安森林", "x.y", "🙂ab", "tee", "coffee", "a" * 200, "\t", "q\nr", ""]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) if i % 9 else None) for i in range(300)]
    tokens = ["a", "ab", "abc", "bcd", "大", "安森", "🙂", "b🙂", "c abc", "d 大安", "ee", "fee t", "a" * 70, "zzz", "x.", " ", "", "c  c", "q\nr a"]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    got = search.containing(docs, spark.createDataFrame([(t,) for t in tokens * 2], "token string"), "text", "id").collect()
    want = {(i, t) for i, x in texts for t in tokens if t.strip() and t in (x or "")}
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 200
    assert search.containing(docs, spark.createDataFrame([], "token string"), "text", "id").count() == 0
    assert search.containing(docs.limit(0), spark.createDataFrame([("a",)], "token string"), "text", "id").count() == 0


def test_sections_are_scored_like_row_by_row(spark):
    rnd = random.Random(6)
    words = "rent rental tax refund days 183 gold card stay 退稅 leave".split()
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", ".", "s"]) for _ in range(n))
    index = [(i, f"g{i % 7}", f"s{i % 5}", make(2), make(4).title() if i % 6 else None, make(3), make(rnd.choice([0, 5, 90])), i % 4 == 0) for i in range(200)]
    asked = [(q, sorted(rnd.sample(["rent", "tax", "gold card", "183", "退稅", "nothing", "s", "e s"], rnd.randint(0, 4)))) for q in range(40)]
    df = spark.createDataFrame(index, "entry long, slug string, section_id string, title string, heading string, keywords string, text string, faq boolean")
    got = {}
    for r in search.search_sections(df, spark.createDataFrame(asked, "q int, tokens array<string>")).collect():
        got.setdefault(r["q"], []).append((r["place"], r["slug"], r["section_id"], r["heading"], round(r["score"], 6), r["snippet"]))

    def shown(text, tokens):
        at = min((p for t in tokens if (p := text.lower().find(t)) >= 0), default=None)
        if at is None:
            return text[:220] + "…" * (len(text) > 220)
        a, b = max(0, at - 110), min(len(text), at + 110)
        return "…" * (a > 0) + text[a:b].strip() + "…" * (b < len(text))

    for q, tokens in asked:
        scored = []
        for entry, slug, sec, title, heading, keywords, text, faq in index:
            per = [sum(w * min(3, (f or "").lower().count(t)) for f, w in ((heading, 4), (title, 1.5), (keywords, 2), (text, 1))) for t in tokens]
            if sum(per):
                scored.append((-sum(per) * (1 + sum(x > 0 for x in per) / len(tokens)) * (1.1 if faq else 1), entry, slug, sec, heading, text, faq))
        want, seen = [], set()
        for s, _, slug, sec, heading, text, faq in sorted(scored, key=lambda x: x[:2]):
            if (k := (slug, sec, heading if faq else "")) not in seen and len(want) < 6:
                seen.add(k)
                want.append((len(want) + 1, slug, sec, heading, round(-s, 6), shown(text, tokens)))
        assert sorted(got.get(q, [])) == want, (q, tokens)


def spelled(text, facts):
    """The text without marks, one mark after the other from the left."""
    if not text:
        return ""

    def one(m):
        t = m[0]
        if t[0] == "*":
            return spelled(t[2:-2], facts)
        if t[0] == "`":
            return t[1:-1]
        if t[0] == "{":
            return facts.get(t[7:-2], "—")
        if t.startswith("[[guide:"):
            slug, label, *_ = [*t[8:-2].split("|"), ""]
            return label or slug
        return spelled(re.match(r"\[([^\]]+)\]", t)[1], facts)

    return " ".join(re.sub(G.MARK, one, text).split())


def test_marks_are_read_from_the_left(spark):
    facts = {"a": "A **b** `c`", "b2": "twelve"}
    texts = [
        None, "", "plain", "**b {{fact:a}} [x `y`](u) ** z", "[**k** {{fact:b2}}](http://u) {{fact:none}}", "[[guide:g-1]] [[guide:g2|the  guide]] [[guide:g3|]]", "`**not bold**` and `{{fact:a}}`", "** open {{fact:a}", "a*b**c*d**e**",
        "[x](a b) [y]() [[guide:Bad]] {{fact:A}}", " 　 two\n\nlines ", "[**[n](u)**](v)", "{{fact:a}}{{fact:a}}**{{fact:b2}}**",
    ]
    rnd = random.Random(8)
    texts += ["".join(rnd.choice(["**", "`", "[", "]", "(u)", "[[guide:g|", "]]", "{{fact:a}}", "x ", " y", "{{fact:b2}}", "|"]) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    named = G.with_names(rows, spark.createDataFrame(list(facts.items()), "id string, display string"), ["i"], F.array("text"))
    got = {r["i"]: r["p"] for r in named.select("i", G.plain(F.col("text"), F.col("names")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spelled(t, facts), t


def test_guides_with_odd_blocks(spark):
    block = lambda **k: {n: k.get(n) for n in ("p", "list", "steps", "callout", "table", "stats", "faq", "facts", "cite")}
    secs = [
        {"id": "one", "heading": "H", "keywords": None, "blocks": [block(p="a"), block(facts=["x"]), block(list=[]), block(list=["b", "**c**"], p="")]},
        {"id": "two", "heading": None, "keywords": ["k"], "blocks": None}, {"id": "three", "heading": "Q", "keywords": [], "blocks": [block(faq=[{"q": "why", "a": None}]), block(callout={"title": None, "text": "t"})]},
    ]
    guides = spark.createDataFrame([("g", 2, "T", "tax", ["w"], None, None, secs), ("h", 3, None, None, None, None, None, None)], G.GUIDE)
    got = [(r["entry"], r["section_id"], r["heading"], r["text"], r["keywords"], r["faq"]) for r in G.guide_index(guides, spark.createDataFrame([], "id string, display string")).orderBy("entry").collect()]
    at = 2 * 10**12
    assert got == [(at, "one", "H", "a   b c", "w", False), (at + 10**6, "two", "", "", "w k", False), (at + 2 * 10**6, "three", "why", "", "w", True), (at + 2 * 10**6 + 1, "three", "Q", " t", "w", False)]


def test_tokens_of_many_phrases_are_met_once(spark, monkeypatch):
    for most in (0, 3, 12):
        monkeypatch.setattr(search, "COMMON", most)  # all tokens common, some, few
        test_sections_are_scored_like_row_by_row(spark)


def test_counts_stop_at_the_third_place(spark):
    from quarrymill.functions import search as S

    rows = [("aaaa", "aa"), ("aaaaaaaaa", "a"), ("大安大安 大安大安", "大安"), ("x", "xy"), ("", "a"), ("🙂b🙂", "🙂"), ("abcabc", "bc")]
    got = spark.createDataFrame(rows, "hay string, token string").select("hay", "token", S.counted(F.col("hay"), F.col("token")).alias("n")).collect()
    assert [r["n"] for r in got] == [min(3, h.count(t)) for h, t in rows]


def test_no_row_is_written_for_each_token_of_each_section(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["a", "aa", "aaaa", "ererer", "rer", "er", "大安", "安", "🙂b", "b🙂b🙂b", "q\nr", "x" * 80, "e s", "ß", "İ", "and", "", "\t", "|", "s"]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "er"]) for _ in range(n))
    index = [(i, f"g{i % 50}", f"s{i % 6}" if i % 11 else None, make(1), make(rnd.choice([1, 2, 8])) if i % 7 else None, make(2), make(rnd.choice([0, 9, 60])) if i % 13 else None, i % 3 == 0) for i in range(400)]
    tokens = [w.lower() for w in words if w.strip(" ")] + ["ere", "rere", "🙂b🙂", "xx", "er e", "aa a", "r\nq", "zz", "a.", "大安 er", "\nr"]
    asked = [(i * 10 + k, [t, *more]) for i, t in enumerate(tokens) for k, more in enumerate([[], ["topic"], ["er", "安"], ["|", "topic", "aa"], ["  "]]) if t not in more]
    rows = {}
    old = search.written

    def counted(df, name):
        out = old(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(search, "written", counted)
    df = spark.createDataFrame(index, "entry long, slug string, section_id string, title string, heading string, keywords string, text string, faq boolean")
    for common in (64, 20):
        monkeypatch.setattr(search, "COMMON", common)
        got = {}
        for r in search.search_sections(df, spark.createDataFrame(asked, "q int, tokens array<string>")).collect():
            got.setdefault(r["q"], []).append((r["place"], r["slug"], r["section_id"], r["heading"], round(r["score"], 6)))
        pairs = 0
        for q, of in asked:
            scored = []
            for entry, slug, sec, title, heading, keywords, text, faq in index:
                per = [sum(w * min(3, (f or "").lower().count(t)) for f, w in ((heading, 4), (title, 1.5), (keywords, 2), (text, 1))) if t.strip() or "\t" in t else 0 for t in of]
                pairs += sum(x > 0 for x in per)
                if sum(per):
                    scored.append((-sum(per) * (1 + sum(x > 0 for x in per) / len(of)) * (1.1 if faq else 1), entry, slug, sec, heading, faq))
            want, seen = [], set()
            for s, _, slug, sec, heading, faq in sorted(scored, key=lambda x: x[:2]):
                if (k := (slug, sec, heading if faq else "")) not in seen and len(want) < 6:
                    seen.add(k)
                    want.append((len(want) + 1, slug, sec, heading, round(-s, 6)))
            assert sorted(got.get(q, [])) == want, (q, of)
        assert pairs > 10_000 and (common == 20 or max(rows.values()) <= 6 * len(asked)), rows  # a row for each pair before
