"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's character-class histogram and its histogram of common words are compared with those of four
languages by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).  A language's
reference is the mean histogram of the documents whose ``lang`` names it, taken over all of them, so the
references follow the corpus.  A document passes if its nearest language is within ``MAX_CLASS_DISTANCE`` by
character classes and, from ``MIN_WORDS_FOR_COMMON`` words on, a language is within its own limit by common
words; shorter texts hold too few common words for the second comparison.  The base rules come first.

A language's limit by common words follows the corpus too.  It lies ``LIMIT_WAY`` of the way from the
``BULK`` quantile of the distances of the language's own documents (all that the comparison decides: enough
words, base rules passed) to the distance of a text without a common word, and always below the latter, so
that such a text never passes, while no fixed share of the documents is cut off.

Defined results: null and empty texts have no words: every count is 0 and the base rules reject them.
Documents of other or null languages are compared like the rest but add to no reference; if a reference has
no documents it is left out, and without any the verdict is the base rules'.  A language without documents for the quantile
takes the distance of a text without a common word as its limit (exclusive).  Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelab.llm.common import stored

# Common words of the four languages.
COMMON_WORDS = {
    "de": "der die das und in zu den von mit ist des im nicht ein eine als auch auf für sich dem",
    "en": "the of and to in a is that for it was on are as with by this from at be or",
    "es": "el la de que y en los del se las un por con para una su al es lo como",
    "fr": "le la les de des du un une et en que qui dans pour par sur est pas avec au",
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})

# Character classes: everything else that is not white space is the last class.
CLASS_PATTERNS = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:]", "mark": r"[!?]", "quote": r"['\"()\-]", "symbol": r"[#*$%&|<>]",
}
CLASSES = [*CLASS_PATTERNS, "other"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CLASS_DISTANCE = 0.30
MIN_WORDS_FOR_COMMON = 100
#: Quantile that bounds the bulk of a language's documents, and the steps in which distances are counted for it.
BULK = 0.95
STEPS = 1000
LIMIT_WAY = 0.75

SPACE = r"[\x20\x09-\x0D]"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def _named(value: Column, use) -> Column:
    """``use(x)`` with x standing for ``value``, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more.

    The windows' hashes are sorted and those with an equal neighbour kept; texts without any are done.
    Few such hashes are looked up in the windows; for many the windows are sorted with their places instead
    (the same count, without a product of the two lengths).
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def by_sort(h: Column) -> Column:
        def marked(s: Column) -> Column:
            return covered(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))
        return _named(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), marked)

    def by_lookup(h: Column, twice: Column) -> Column:
        return covered(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull()))

    def counted(h: Column) -> Column:
        twice = _named(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k + 1) == x)))
        chosen = _named(twice, lambda t: F.when(F.size(t) == 0, F.lit(0)).when(F.size(t) < 64, by_lookup(h, t)).otherwise(by_sort(h)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(chosen)

    return F.when(n < 4, F.lit(0)).otherwise(_named(hashes, counted)).cast("long")


def _histogram(places: Column, total: Column) -> Column:
    """Sparse histogram [(i, share)] of the vocabulary places found; the last entry holds all other words."""
    def shares(ordered: Column) -> Column:
        return _named(F.transform(F.array_distinct(ordered), lambda i: F.struct(i.alias("i"), F.array_position(ordered, i).alias("at"))), lambda runs: F.transform(
            runs, lambda r, k: F.struct(r["i"].alias("i"), ((F.coalesce(F.get(runs, k + 1)["at"], F.size(ordered) + 1) - r["at"]) / total).alias("share"))))
    rest = F.array(F.struct(F.lit(len(VOCABULARY)).alias("i"), ((total - F.size(places)) / total).alias("share")))
    return F.concat(_named(F.sort_array(places), shares), rest)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts, and the histograms of character classes and common words."""
    docs = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    docs = docs.select("doc_id", "lang", "text", F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "").alias("words"), F.regexp_replace(text, f"{SPACE}+", "").alias("solid"),
                       F.filter(F.split(F.regexp_replace(F.lower(text), r"[\p{P}\p{S}\s]+", " "), " "), lambda w: F.length(w).between(1, max(map(len, VOCABULARY)))).alias("short"))
    # what is left without lower-case letters is a small part of most texts
    docs = docs.withColumn("rest", F.regexp_replace("solid", r"\p{Ll}+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    place = F.create_map(*(x for i, w in enumerate(VOCABULARY) for x in (F.lit(w), F.lit(i))))
    docs = docs.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.length("solid").cast("long").alias("word_chars"),
        F.array(F.length("solid") - F.length("rest"), *(_count(F.col("rest"), p) for k, p in CLASS_PATTERNS.items() if k != "lower")).alias("counts"),
        _named(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.filter(F.transform("short", lambda w: F.element_at(place, w)), lambda i: i.isNotNull()).alias("common"))
    counted = F.aggregate("counts", F.lit(0), lambda acc, x: acc + x)
    classes = F.transform(F.concat("counts", F.array((F.col("word_chars") - counted).cast("int"))), lambda c, i: F.struct(i.alias("i"), (c / F.col("word_chars")).alias("share")))
    return docs.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("counts")[list(CLASS_PATTERNS).index("symbol")].cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_words") > 0, classes).alias("classes"), F.when(F.col("n_words") > 0, _histogram(F.col("common"), F.col("n_words"))).alias("common"))


def references(measured: DataFrame, histogram: str, size: int) -> dict[str, list[float]]:
    """Mean histogram of each of the four languages that has documents with words."""
    known = measured.where(F.col("lang").isin(sorted(COMMON_WORDS)) & (F.col("n_words") > 0))
    entries = known.select("lang", F.explode(histogram).alias("e")).groupBy("lang", "e.i").agg(F.sum("e.share").alias("total"))
    docs = known.groupBy("lang").agg(F.count("*").alias("n"))
    out: dict[str, list[float]] = {}
    for r in entries.join(docs, "lang").collect():  # at most four languages times the fixed vocabulary
        out.setdefault(r["lang"], [0.0] * size)[r["i"]] = r["total"] / r["n"]
    return dict(sorted(out.items()))


def _distance(histogram: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a sparse histogram and a reference; an entry the document lacks adds half its share."""
    q = F.array(*(F.lit(float(x)) for x in reference))
    def term(e: Column) -> Column:
        def parts(y: Column) -> Column:
            m = (e["share"] + y) / 2
            own = F.when(e["share"] > 0, e["share"] * F.log2(e["share"] / m)).otherwise(0.0)
            other = F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)
            return (own + other - y) / 2
        return _named(F.get(q, e["i"]), parts)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.transform(histogram, term), F.lit(sum(reference) / 2), lambda acc, x: acc + x)))


def _nearest(histogram: str, refs: dict[str, list[float]]) -> Column:
    distances = [_distance(F.col(histogram), r) for r in refs.values()]
    return F.array_min(F.array(*distances)) if distances else F.lit(0.0)


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def wordless_distance(reference: list[float]) -> float:
    """Jensen-Shannon distance of a text without a common word and a reference of common words."""
    y = reference[-1]
    m = (1 + y) / 2
    return sqrt(max(0.0, sum(reference[:-1]) / 2 + (-log2(m) + (y * log2(y / m) if y > 0 else 0.0)) / 2))


def word_limits(measured: DataFrame, refs: dict[str, list[float]]) -> dict[str, float]:
    """Largest distance by common words that each language accepts."""
    bulk: dict[str, float] = {}
    if refs:
        own = F.coalesce(*(F.when(F.col("lang") == k, _distance(F.col("common"), r)) for k, r in refs.items()))
        judged = measured.where(F.col("lang").isin(list(refs)) & (F.col("n_words") >= MIN_WORDS_FOR_COMMON) & ~_base_failed())
        counts = judged.groupBy("lang", F.ceil(own * STEPS).alias("step")).agg(F.count("*").alias("n"))
        steps = defaultdict(list)
        for r in counts.collect():  # at most four languages times STEPS + 1
            steps[r["lang"]].append((r["step"], r["n"]))
        for lang, found in steps.items():
            left = ceil(BULK * sum(n for _, n in found))
            for step, n in sorted(found):
                left -= n
                if left <= 0:
                    bulk[lang] = step / STEPS
                    break
    limits = {}
    for lang, r in refs.items():
        most = wordless_distance(r)
        low = min(bulk.get(lang, most), most)
        limits[lang] = min(low + LIMIT_WAY * (most - low), most - 1e-6)
    return limits


def judge(measured: DataFrame) -> DataFrame:
    """Result of the rules from stored ``measures`` (read for the references, the limits and the verdicts)."""
    by_class, by_word = references(measured, "classes", len(CLASSES)), references(measured, "common", len(VOCABULARY) + 1)
    limits = word_limits(measured, by_word)
    base_failed = _base_failed()
    spare = [F.lit(limits[k]) - _distance(F.col("common"), r) for k, r in by_word.items()]
    worded = F.array_max(F.array(*spare)) >= 0 if spare else F.lit(True)
    out = measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
                          _nearest("classes", by_class).alias("class_distance"), _nearest("common", by_word).alias("word_distance"), worded.alias("worded"))
    near = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & ((F.col("n_words") < MIN_WORDS_FOR_COMMON) | F.col("worded"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(near, F.lit(False))).drop("worded")


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, distances and kept of every row of ``docs`` (doc_id, text, lang)."""
    return judge(stored(measures(docs), "rule-measures"))
