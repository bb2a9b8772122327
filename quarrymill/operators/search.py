"""Search over tables of phrases: which texts hold which tokens, listings by phrase, sections by phrase.

Tokens are found anywhere in a text, as letters and not as words. A token's longest word is known by the rarest of its
runs of three letters (or fewer, if it is shorter) and meets the words of all texts that have that run; texts and tokens then
meet by these words. All of these are equi-joins, so neither phrases nor texts are walked for each of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import search as S
from . import listings as L
from . import windows as W
from .joins import beside, first_of_each, skewed_join, spread, written

GRAM = 3


#: Words of so many letters are cut by place; longer ones, for which that takes the square of their length, by letters.
SHORT = 64


def grams(text: Column, sizes: list[int]) -> Column:
    """The different runs of so many letters that stand in the words of a text (between spaces)."""
    none = F.array().cast("array<string>")
    places = lambda n, k: F.sequence(F.lit(1), n - (k - 1))

    def of(w: Column, k: int) -> Column:
        letters = lambda c: F.transform(places(F.size(c), k), lambda i: F.array_join(F.slice(c, i, F.lit(k)), ""))
        cut = F.transform(places(F.length(w), k), lambda i: F.substring(w, i, F.lit(k)))
        return F.when(F.length(w) < k, none).when(F.length(w) <= SHORT, cut).otherwise(N.let(F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0)), letters))

    words = F.array_distinct(F.split(text, " "))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(*[of(w, k) for k in sizes]) if len(sizes) > 1 else of(w, sizes[0]))))


def containing(docs: DataFrame, tokens: DataFrame, text: str, key: str) -> DataFrame:
    """(key, token): the rows of ``docs`` whose ``text`` holds each of ``tokens`` (token). Keys are unique.

    The texts' different words are looked at once: a token's longest word meets the words that have its rarest run of
    letters, and texts meet tokens by these words. Only tokens of several words are then compared with texts.
    """
    in_docs = docs.select(key, F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), " "))).alias("word")).filter("word <> ''")
    parts = F.transform(F.filter(F.split("token", " "), lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    wanted = tokens.select("token").filter("trim(token) <> ''").distinct().withColumn("part", F.array_max(parts)["w"])
    wanted = written(wanted.withColumn("size", F.least(F.lit(GRAM), F.length("part"))), "tokens")
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())  # GRAM at most
    if not sizes:
        return docs.select(key, F.lit("").alias("token")).limit(0)
    own = [wanted.filter(F.col("size") == k).select("part", F.explode(grams(F.col("part"), [k])).alias("gram")) for k in sizes]
    offered = own[0]
    for o in own[1:]:
        offered = offered.unionByName(o)
    offered = written(offered.distinct(), "grams")
    found = written(in_docs.select("word").distinct(), "words").select("word", F.explode(grams(F.col("word"), sizes)).alias("gram"))
    found = written(beside(found, offered.select("gram").distinct(), "gram"), "grams")
    counts = found.groupBy("gram").agg(F.count("*").alias("n"))
    rare = offered.join(counts, "gram", "left").groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    pairs = beside(found, rare, "gram").filter(F.col("word").contains(F.col("part"))).join(wanted, "part").select("word", "token", (F.col("token") == F.col("part")).alias("whole"))
    held = written(beside(in_docs, written(pairs, "words"), "word").select(key, "token", "whole").distinct(), "held")
    rest = skewed_join(held.filter("not whole"), docs.select(key, F.col(text).alias("_text")), key).filter(F.col("_text").contains(F.col("token")))
    return held.filter("whole").select(key, "token").unionByName(rest.select(key, "token"))


def time_frames(spark, now: str) -> DataFrame:
    """(when_key, lo, hi) of the windows and months that phrases name: 22 rows."""
    months = F.element_at(F.array(*[F.lit(f"month:{m}") for m in S.MONTHS]), F.col("month"))
    both = W.windows(spark, now).unionByName(W.month_windows(spark, now).select(months.alias("name"), "start", "end"))
    return both.select(F.col("name").alias("when_key"), N.instant(F.col("start")).alias("lo"), N.instant(F.col("end")).alias("hi"))


def search_listings(events: DataFrame, asked: DataFrame, now: str, most: int = 20) -> DataFrame:
    """(q, uid, hit, place): the first ``most`` listings for each phrase of ``asked`` (q and what ``parse_queries`` makes).

    A listing fits if it meets every condition and holds every token; those with a token in their title (hit 2) come first,
    then the order of results. Phrases that ask for the same are answered once. One with tokens looks among the listings that hold
    its rarest; one without looks among the first ``most`` of each kind of listing (window, topic, price, language, online,
    city), as no other can be among its first.
    """
    spark = events.sparkSession
    parts = ["when_key", "free", "english", "in_person", "city", "topic", "sub", "tokens"]
    asked = asked.withColumn("tokens", F.array_sort(F.array_distinct("tokens")))
    asked = written(asked.select("q", F.sha1(F.to_json(F.struct(*parts))).alias("ask"), *parts), "asked")
    asks = asked.dropDuplicates(["ask"]).drop("q").join(F.broadcast(time_frames(spark, now)), "when_key", "left")
    asks = asks.select("ask", "lo", "hi", F.coalesce("when_key", F.lit("*")).alias("in_window"), F.coalesce(F.concat_ws("/", "topic", "sub"), F.lit("")).alias("in_topic"), F.col("free").alias("only_free"),
                       F.col("english").alias("only_english"), "in_person", F.col("city").alias("in_city"), "tokens")
    asks = written(asks.withColumn("in_topic", F.when(F.col("in_topic") == "", "*").otherwise(F.col("in_topic"))), "asks")
    has = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    order = L.order()
    rows = events.filter(L.matches(now)).select(
        "uid", order[0].alias("o1"), order[1].alias("o2"), N.instant(F.col("starts_at")).alias("s"), F.coalesce("is_free", F.lit(False)).alias("is_free"), has("lang:en").alias("is_english"),
        has("online").alias("is_online"), "city", L.topic_ids().alias("topics"), L.search_blob(with_address=True).alias("blob"), F.lower(F.concat_ws(" ", "title", F.coalesce("title_en", F.lit("")))).alias("head"),
    )
    rows = written(rows, "searched")
    by_order = [F.col("o1"), F.col("o2"), F.col("uid")]

    # with tokens: by the rarest
    spoken = asks.filter(F.size("tokens") > 0)
    held = written(containing(rows, spoken.select(F.explode("tokens").alias("token")), "blob", "uid"), "held")
    each = spoken.select("ask", F.explode("tokens").alias("token")).join(held.groupBy("token").agg(F.count("*").alias("n")), "token", "left")
    rarest = each.groupBy("ask").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    pairs = beside(held, written(spoken.join(rarest, "ask"), "asks"), "token").drop("token")
    pairs = skewed_join(pairs, rows, "uid").filter(F.forall("tokens", lambda t: F.col("blob").contains(t)))
    timed = F.col("lo").isNull() | F.coalesce(F.col("s").between(F.col("lo"), F.col("hi")), F.lit(False))
    pairs = pairs.filter(timed & ((F.col("in_topic") == "*") | F.array_contains("topics", F.col("in_topic"))))

    # without: among the first of each kind
    frames = F.broadcast(time_frames(spark, now))
    inside = rows.join(frames, F.col("s").between(F.col("lo"), F.col("hi"))).select(*rows.columns, F.col("when_key").alias("in_window"))
    kinds = inside.unionByName(rows.withColumn("in_window", F.lit("*"))).withColumn("in_topic", F.explode(F.concat(F.array(F.lit("*")), "topics")))
    kinds = first_of_each(kinds, ["in_window", "in_topic", "is_free", "is_english", "is_online", "city"], by_order, most)
    silent = beside(kinds, asks.filter(F.size("tokens") == 0), ["in_window", "in_topic"])

    cols = ["ask", "uid", "o1", "o2", "is_free", "is_english", "is_online", "city", "only_free", "only_english", "in_person", "in_city", "tokens", "head"]
    both = pairs.select(*cols).unionByName(silent.select(*cols))
    both = both.filter((~F.col("only_free") | F.col("is_free")) & (~F.col("only_english") | F.col("is_english")) & (~F.col("in_person") | ~F.col("is_online")) & (F.col("in_city").isNull() | F.coalesce(F.col("in_city") == F.col("city"), F.lit(False))))
    hit = F.when(F.exists("tokens", lambda t: F.col("head").contains(t)), 2).otherwise(1)
    both = first_of_each(both.select("ask", "uid", "o1", "o2", hit.alias("hit")), ["ask"], [F.desc("hit"), *by_order], most)
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("hit"), *by_order))  # ``most`` rows
    return skewed_join(asked.select("q", "ask"), written(both.select("ask", "uid", "hit", place.alias("place")), "found"), "ask").select("q", "uid", "hit", "place")


#: A token of more phrases than this is a common one.
COMMON = 64
FIELDS = {"heading": 4.0, "title": 1.5, "keywords": 2.0, "text": 1.0}


#: Letters of a block of entries (more, if one section has more).
BLOCK = 4_000_000


def _finder(most: int | None = None):
    """What is done with a block of entries (an Arrow table with entry and FIELDS, in lower case) and sets of tokens (tokens).

    Without ``most``, (no, entry, s, m) of all sets (no) and entries that meet: what the tokens of the set weigh in the entry, and how
    many it holds. With ``most``, (no, entry, score): the best entries for each phrase (no, n, head, least) of a set (``a``), of each group
    (``of``) one; a phrase's score is that of its set and of what the entry is known to have of its head (``known``).
    """
    fields = FIELDS.items()

    def repeated(begin, size):
        """The places begin, begin + 1, ... of each range, one range after the other."""
        import numpy as np

        return np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)

    def added(key, value):
        """The different keys, sorted, and the sums of their values."""
        import numpy as np

        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        return key, np.add.reduceat(value[order], first) if len(key) else value[:0]

    def held(words, parts):
        """Arrays (word, part, times), by word: how often each of ``parts`` (strings without spaces) stands in each of ``words``. The
        letters of many words go down the tree of parts together, a letter a step."""
        import numpy as np

        edges, ends = {}, [-1]
        for i, part in enumerate(parts):
            node = 0
            for c in part:
                child = edges.setdefault(node << 21 | ord(c), len(ends))
                if child == len(ends):
                    ends.append(-1)
                node = child
            ends[node] = i
        known = np.sort(np.fromiter(edges, "int64", len(edges)))
        child, ends = np.array([edges[k] for k in known.tolist()], "int64"), np.array(ends)
        lengths = np.array([len(p) for p in parts], "int64")

        def of_some(words):
            letters = np.frombuffer("".join(words).encode("utf-32-le"), "uint32").astype("int64")
            size = np.array([len(w) for w in words], "int64")
            word, stop = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size)
            at, node, depth, found = np.arange(len(letters)), np.zeros(len(letters), "int64"), 0, [(np.zeros(0, "int64"),) * 2]
            while len(at) and len(known):
                key = node << 21 | letters[at + depth]
                to = np.minimum(np.searchsorted(known, key), len(known) - 1)
                on = known[to] == key
                at, node, depth = at[on], child[to[on]], depth + 1
                full = ends[node] >= 0
                found.append((at[full], ends[node[full]]))
                on = at + depth < stop[at]
                at, node = at[on], node[on]
            at, part = map(np.concatenate, zip(*found))
            key = word[at] * max(1, len(parts)) + part
            order = np.argsort(key, kind="stable")  # places of a part stay in order
            key, at = key[order], at[order]
            some, times = np.unique(key, return_counts=True)
            word, part = some // max(1, len(parts)), some % max(1, len(parts))
            close = key[1:][(np.diff(key) == 0) & (np.diff(at) < lengths[key[1:] % max(1, len(parts))])]
            for i in np.unique(np.searchsorted(some, close)).tolist():  # places that overlap
                times[i] = words[word[i]].count(parts[part[i]])
            return word, part, times

        out = [(np.zeros(0, "int64"),) * 3]
        for first in range(0, len(words), 1 << 15):
            word, part, times = of_some(words[first : first + (1 << 15)])
            out.append((word + first, part, times))
        return tuple(map(np.concatenate, zip(*out)))

    def sums(entries, sets):
        """Arrays (set, entry, s, m), by set, then entry. Each different word is looked at once, for the tokens' longest words."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        of = {}
        for i, tokens in enumerate(sets["tokens"].to_pylist()):
            for t in tokens:
                if t.strip(" "):
                    of.setdefault(t, []).append(i)
        longest = {t: max(t.split(" "), key=len) for t in of}
        parts = list(dict.fromkeys(longest.values()))
        split = [pc.split_pattern(entries[f].combine_chunks(), " ") for f, _ in fields]
        words = pa.concat_arrays([pc.list_flatten(x) for x in split]).dictionary_encode()
        ids, n_words = words.indices.to_numpy(), max(1, len(words.dictionary))
        word, part, times = held(words.dictionary.to_pylist(), parts)
        begin = np.searchsorted(word, np.arange(n_words + 1))
        keys, weights, done = [], [], 0
        for x, (_, weight) in zip(split, fields):
            entry = pc.list_parent_indices(x).to_numpy().astype("int64")
            both, n = np.unique(entry * n_words + ids[done : done + len(entry)], return_counts=True)
            done += len(entry)
            size = np.diff(begin)[both % n_words]
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 1 << 18)[1:])
            cuts = np.searchsorted(both, both[cuts] // n_words * n_words)  # parts of some 260,000 pairs, cut between entries
            for own, m, k in zip(np.split(both, cuts), np.split(n, cuts), np.split(size, cuts)):
                at = repeated(begin[own % n_words], k)
                key, times_there = added(np.repeat(own // n_words, k) * len(parts) + part[at], np.repeat(m, k) * times[at])
                keys.append(key)
                weights.append(np.minimum(3, times_there) * weight)
        key, s = added(np.concatenate(keys), np.concatenate(weights))
        order = np.argsort(key % max(1, len(parts)), kind="stable")
        part, entry, s = key[order] % max(1, len(parts)), key[order] // max(1, len(parts)), s[order]
        begin = np.searchsorted(part, np.arange(len(parts) + 1))
        number, out = {p: i for i, p in enumerate(parts)}, [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        for t, its in of.items():
            there = slice(*begin[number[longest[t]] :][:2])
            e, of_t = entry[there], s[there]
            if t != longest[t]:  # words apart: the fields that hold the longest are read
                hay = [(entries[f].take(pa.array(e)).to_pylist(), weight) for f, weight in fields]
                of_t = np.array([sum(min(3, h.count(t)) * weight for h, (_, weight) in zip(row, hay)) for row in zip(*(h for h, _ in hay))], "float64")
                e, of_t = e[of_t > 0], of_t[of_t > 0]
            out += [(np.full(len(e), i), e, of_t) for i in its if len(e)]
        which, where, weigh = map(np.concatenate, zip(*out))
        key = which * max(1, len(entries)) + where
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        if not len(key):
            return key, key, np.zeros(0), key
        return key // len(entries), key % len(entries), np.add.reduceat(weigh[order], first), np.diff(np.append(first, len(order)))

    def summed(entries, sets):
        import pyarrow as pa

        which, where, s, m = sums(entries, sets)
        return pa.table({"no": sets["no"].take(pa.array(which)), "entry": entries["entry"].take(pa.array(where)), "s": pa.array(s), "m": pa.array(m, pa.int64())})

    def best(entries, sets):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        entries = entries.sort_by("entry")
        which, where, s, m = sums(entries, sets)
        begin, end = (np.searchsorted(which, np.arange(len(sets)), side=x) for x in ("left", "right"))
        flat = lambda c: (pc.list_parent_indices(c).to_numpy(), pc.list_flatten(c))
        field = lambda rows, f, null: pc.fill_null(pc.struct_field(rows, f), null).to_numpy(zero_copy_only=False)
        (of_set, asks), (of_entry, known) = flat(sets["a"].combine_chunks()), flat(entries["known"].combine_chunks())
        no, n, head, least = field(asks, "no", -1), field(asks, "n", 1), field(asks, "head", -1), field(asks, "least", -1.0)
        known_head, known_s, known_m = field(known, "head", -1), field(known, "s", 0.0), field(known, "m", 0)
        more = np.where(entries["faq"].to_numpy(), 1.1, 1.0)
        group = entries["of"].combine_chunks().dictionary_encode().indices.to_numpy()
        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        for h in np.unique(head):
            mine, of_head = np.flatnonzero(head == h), known_head == h
            hs, hm = np.zeros(len(entries)), np.zeros(len(entries), "int64")
            hs[of_entry[of_head]], hm[of_entry[of_head]] = known_s[of_head], known_m[of_head]
            size = (end - begin)[of_set[mine]]
            ask = np.repeat(mine, size)
            pair = repeated(begin[of_set[mine]], size)
            e = where[pair]
            score = (s[pair] + hs[e]) * (1 + (m[pair] + hm[e]) / n[ask]) * more[e]
            reach = score >= least[ask]
            ask, e, score = ask[reach], e[reach], score[reach]
            order = np.lexsort((-score, ask))  # stable: of equal scores the first entry
            ask, e, score = ask[order], e[order], score[order]
            own = np.sort(np.unique(ask * (group.max(initial=0) + 1) + group[e], return_index=True)[1])
            ask, e, score = ask[own], e[own], score[own]
            top = np.arange(len(ask)) - np.searchsorted(ask, ask) < most
            out.append((no[ask[top]], e[top], score[top]))
        no, e, score = map(np.concatenate, zip(*out))
        return pa.table({"no": pa.array(no), "entry": entries["entry"].take(pa.array(e)), "score": pa.array(score)})

    return best if most else summed


def beside_blocks(entries: DataFrame, sets: DataFrame, blocks: int, find, schema: str) -> DataFrame:
    """``find`` (of two Arrow tables) of each block of ``entries`` (block: below ``blocks``) and all of ``sets``, which every block is given."""
    dealt = sets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by_block = lambda rows: rows.repartition(blocks, "block").groupBy("block")
    return by_block(entries).cogroup(by_block(dealt)).applyInArrow(lambda left, right: find(left, right), schema)


def search_sections(index: DataFrame, asked: DataFrame, most: int = 6) -> DataFrame:
    """(q, place, slug, section_id, heading, faq, score, snippet): the best ``most`` entries of a guide index for each phrase of ``asked``
    (q, tokens: expanded already).

    ``index`` has entry (a number that gives the order of equal scores), slug, section_id, title, heading, keywords, text and faq. An entry's score
    is that of its tokens by field, more for more different ones and for a question. Of a section and of a question the
    best entry stays. Phrases with equal tokens are answered once. An entry that has common tokens of a phrase only is not met with
    each phrase that has them: the best of these are found once.
    """
    spark = index.sparkSession
    asked = written(asked.select("q", "tokens", F.sha1(F.to_json("tokens")).alias("ask")), "asked")
    asks = written(asked.filter(F.size("tokens") > 0).dropDuplicates(["ask"]).select("ask", "tokens").withColumn("no", F.monotonically_increasing_id()), "asks")
    index = written(index.select("entry", "slug", "section_id", "faq", *FIELDS), "sections")
    group = ["slug", "section_id", "of"]
    of = F.when(F.col("faq"), F.col("heading")).otherwise(F.lit("")).alias("of")
    about = index.select("entry", "slug", "section_id", "faq", of)
    # blocks of whole sections, so that what a section or question has is told within one
    letters = index.agg(F.sum(sum((F.length(F.coalesce(f, F.lit(""))) for f in FIELDS), F.lit(0)))).first()[0] or 0
    blocks = max(4 * spark.sparkContext.defaultParallelism, letters // BLOCK + 1)
    block = F.pmod(F.xxhash64("slug", "section_id"), F.lit(blocks)).cast("int")
    low = index.select(block.alias("block"), "entry", "faq", F.to_json(F.struct("slug", "section_id", of)).alias("of"), *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS])
    each = asks.select("no", F.explode(F.array_distinct("tokens")).alias("token"))

    # tokens of many phrases apart from the others; what phrases have in common of either is summed once
    common = each.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON).select("token", F.lit(True).alias("common"))
    two = beside(each, written(common, "common"), "token", "left").groupBy("no").agg(
        F.array_sort(F.collect_list(F.when(F.col("common"), F.col("token")))).alias("h"), F.array_sort(F.collect_list(F.when(F.col("common").isNull(), F.col("token")))).alias("r"), F.count("*").alias("n"))
    two = written(two, "parts")
    numbered = lambda c, to: written(two.filter(F.size(c) > 0).select(c).distinct().withColumn(to, F.monotonically_increasing_id()), to)
    heads, rests = numbered("h", "head"), numbered("r", "rest")
    two = written(two.join(heads, "h", "left").join(rests, "r", "left").select("no", "n", "head", "rest"), "parts")

    scored = lambda s, m: s * (1 + m / F.col("n")) * F.when(F.col("faq"), 1.1).otherwise(1.0)
    top = lambda rows, by: first_of_each(rows.groupBy(*by, *group).agg(F.min_by(F.struct("entry", "score"), F.struct(-F.col("score"), "entry")).alias("b")).select(*by, *group, "b.*"), by, [F.desc("score"), F.col("entry")], most, by="entry")

    # entries with common tokens alone: only the best for all of these can be among a phrase's best, as other tokens add to a score
    of_heads = beside_blocks(low, heads.select(F.col("head").alias("no"), F.col("h").alias("tokens")), blocks, _finder(), "no long, entry long, s double, m long")
    of_heads = written(of_heads.withColumnRenamed("no", "head"), "head")
    kinds = two.filter("head is not null").select("head", "n").distinct()
    firsts = written(top(beside(of_heads, kinds, "head").join(about, "entry").withColumn("score", scored(F.col("s"), F.col("m"))), ["head", "n"]), "firsts")
    least = firsts.groupBy("head", "n").agg(F.when(F.count("*") == most, F.min("score")).alias("least"))
    shared = beside(two, firsts, ["head", "n"]).select("no", *group, "entry", "score")

    # entries with others: of each block the best that reach the score of the last of these
    known = of_heads.groupBy("entry").agg(F.collect_list(F.struct("head", "s", "m")).alias("known"))
    wanted = two.filter("rest is not null").join(least, ["head", "n"], "left").groupBy("rest").agg(F.collect_list(F.struct("no", "n", "head", "least")).alias("a"))
    wanted = written(rests.join(wanted, "rest").select(F.col("r").alias("tokens"), "a"), "wanted")
    entries = low.join(known, "entry", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<head:bigint,s:double,m:bigint>>")))
    own = beside_blocks(entries, wanted, blocks, _finder(most), "no long, entry long, score double")
    own = written(first_of_each(own, ["no"], [F.desc("score"), F.col("entry")], most, by="entry"), "own").join(about, "entry")
    best = top(shared.unionByName(own.select("no", *group, "entry", "score")), ["no"]).join(asks.select("no", "ask"), "no").select("ask", "entry", "score")
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "entry"))  # ``most`` rows
    best = written(best.withColumn("place", place), "best")
    shown = beside(index, best.select("entry").distinct(), "entry").select("entry", "slug", "section_id", "heading", "faq", F.coalesce("text", F.lit("")).alias("text"))
    best = skewed_join(spread(best.join(asks, "ask")), shown, "entry")
    best = best.select("ask", "place", "slug", "section_id", "heading", "faq", "score", S.snippet(F.col("text"), F.col("tokens")).alias("snippet"))
    return skewed_join(asked.select("q", "ask"), written(best, "found"), "ask").drop("ask")
