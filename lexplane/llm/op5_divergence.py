"""Quality rules by distribution divergence, in DataFrame operations only.

Each document's histograms of character classes and of common words are compared with those of its language, summed
over all documents, by Jensen-Shannon distance. Texts are read once; the counts are written and the rest works on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, broadcast_if_small

#: Common words of each language.
COMMON = {
    "en": "the of and to in is that it for on with as are by from this be at or an a was have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur se elle il".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es".split(),
}
#: Character classes, disjoint; what is in none is the last class.
CLASSES = [r"\p{Ll}", r"\p{Lu}", r"\p{L}&&[^\p{Ll}\p{Lu}]", r"\p{N}", r"\x20\x09-\x0D", r"#*$%&|<>", r".,;:!?'\"()\-"]


def _of(text: Column, group: str) -> Column:
    """Characters of text in a regular expression's class."""
    return F.length(F.regexp_replace(text, f"[^{group}]+" if "&&" not in group else f"[^[{group}]]+", ""))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is not copied into the expressions that use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """Words in 3-word windows that the array has twice or more, each word once."""
    none = F.lit(0).cast("long")

    def of_windows(w: Column) -> Column:
        triples = F.transform(F.arrays_zip(F.slice(w, 1, F.size(w) - 2), F.slice(w, 2, F.size(w) - 2), F.slice(w, 3, F.size(w) - 2)), lambda t: F.xxhash64(t))

        def spread(h: Column) -> Column:
            def runs(s: Column) -> Column:
                n = F.size(s)
                again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])))
                return _let(F.array_sort(F.transform(again, lambda x: x["i"])), lambda p: F.aggregate(p, F.struct(none.alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]))

            return _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), runs)

        return _let(triples, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(spread(h)))

    return F.when(F.size(words) < 4, none).otherwise(of_windows(words))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and chars and common, the two histograms; a null text counts as empty."""
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("lang")
    src = docs.select("doc_id", lang.alias("lang"), text.alias("t"))
    commons = F.create_map(*[x for k, ws in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])
    every = sorted({w for ws in COMMON.values() for w in ws})

    def of_words(w: Column) -> Column:
        used = F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(every))
        listed = F.coalesce(F.element_at(commons, F.coalesce("lang", F.lit(""))), F.array().cast("array<string>"))
        hist = _let(used, lambda u: F.transform(listed, lambda x: (F.size(u) - F.size(F.array_remove(u, x))).cast("long")))
        return F.struct(F.size(w).cast("long").alias("n_words"), _covered(w).alias("n_repeat_words"), hist.alias("common"))

    lines = _let(F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    known = [_of(F.col("t"), g).cast("long") for g in CLASSES]
    src = src.withColumn("c", F.array(*known, F.length("t").cast("long")))
    chars = F.concat(F.slice("c", 1, len(CLASSES)), F.array(F.element_at("c", -1) - F.aggregate(F.slice("c", 1, len(CLASSES)), F.lit(0).cast("long"), lambda a, x: a + x)))
    out = src.withColumn("w", _let(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), of_words)).withColumn("n_dup_lines", lines)
    white, symbols = (F.col("c")[n] for n in (4, 5))
    return out.select("doc_id", "lang", "w.n_words", (F.length("t") - white).cast("long").alias("word_chars"), symbols.alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", chars.alias("chars"), "w.common")


def references(counted: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common: the histograms of each language, summed over all documents; a null lang is one too."""
    sums = [F.sum(F.col("chars")[n]) for n in range(len(CLASSES) + 1)]
    widest = max(map(len, COMMON.values()))
    words = [F.sum(F.get("common", F.lit(n))) for n in range(widest)]
    return counted.groupBy("lang").agg(F.array(*sums).alias("ref_chars"), F.array(*[F.coalesce(w, F.lit(0)) for w in words]).alias("ref_common"))


def _entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; null where either is all zero."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    share = lambda c: _let(total(c), lambda n: F.transform(c, lambda x: x / n))
    both = F.zip_with(share(p), share(q), lambda x, y: (x + y) / 2)
    d = _entropy(both) - (_entropy(share(p)) + _entropy(share(q))) / 2
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(d, F.lit(0.0))))


def quality(scratch: Scratch, docs: DataFrame, char_limit: float = 0.25, word_limit: float = 0.6, least_chars: int = 400, least_common: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_chars, js_words.

    A document is dropped that fails the base rules or stands further from its language than a limit; a histogram of
    too few characters or common words is no evidence and drops nothing. Languages without a word list, and a null
    one, are compared by characters alone.
    """
    counted = scratch.table(counts(docs), "counts")
    refs = broadcast_if_small(scratch.table(references(counted), "references").withColumnRenamed("lang", "lang_"))
    out = counted.join(refs, F.col("lang").eqNullSafe(F.col("lang_")), "left")
    out = out.withColumn("js_chars", js_distance(F.col("chars"), F.col("ref_chars")))
    out = out.withColumn("js_words", js_distance(F.col("common"), F.slice("ref_common", F.lit(1), F.size("common"))))
    hits = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    letters = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    far = ((letters >= least_chars) & (F.col("js_chars") > char_limit)) | ((hits >= least_common) & (F.col("js_words") > word_limit))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words")
