"""Quality rules: counts of a text, and its divergence from its language's profile.

Everything is a DataFrame expression: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW = 5
# Frequent function words of four languages; a parameter of the operator.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un une du que dans".split(),
    "es": "de la que el en y a los se del las un".split(),
}
CHAR_CLASSES = ["[a-z]", "[\\x20\\x09-\\x0D]", "[A-Z]", "[.,]", "[0-9]", "[!?;:'\"()-]", "[\\x00-\\x7F]", "\\p{L}"]
MIN_WORDS = 10
MIN_CHARS_CHAR = 250  # below this length a text's character classes are not judged
MIN_WORDS_WORD = 100  # below this length its common words are not
MAX_CHAR_DISTANCE = 0.16
CHAR_NOISE = 1.0  # allowed on top, divided by the root of the length: short texts stray by chance
MAX_WORD_DISTANCE = 0.24
MOST_LANGUAGES = 10_000  # references that may be broadcast, under 300 bytes each
MIN_REFERENCE = 20  # texts that a language's reference is made of, at least


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also inside the lambdas of body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more in the array, first ones included.

    Window hashes without a repeat settle most texts. Else windows are sorted by
    (36 bits of hash, 28 bits of position); equal hashes name candidates, whose
    words are then compared, so the count is exact."""
    place = (1 << 28) - 1

    def hashes(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))
        return let(each, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda k: F.xxhash64(*[F.get(h, k + i) for i in range(WINDOW)])))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, k: x.bitwiseAND(F.lit(~place)).bitwiseOR(k.cast("long"))))

    def twice(s: Column, part: Callable[[Column], Column]) -> Column:
        near = lambda x, k: part(F.get(s, k)) == part(x)
        return F.filter(s, lambda x, i: F.coalesce(near(x, i + 1), F.lit(False)) | F.coalesce((i > 0) & near(x, F.greatest(i - 1, F.lit(0))), F.lit(False)))

    def exact(w: Column, found: Column) -> Column:
        at = lambda x: x.bitwiseAND(place).cast("int")
        texts = F.sort_array(F.transform(found, lambda x: F.struct(F.concat_ws(" ", *[F.get(w, at(x) + i) for i in range(WINDOW)]).alias("t"), at(x).alias("p"))))
        return let(texts, lambda s: F.sort_array(F.transform(twice(s, lambda x: x["t"]), lambda x: x["p"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, F.greatest(i - 1, F.lit(0)))))), F.lit(0), lambda a, x: a + x)

    slow = lambda w, h: let(let(placed(h), lambda s: twice(s, lambda x: F.shiftright(x, 28))), lambda c: let(exact(w, c), covered))
    counted = let(words, lambda w: let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), slow(w, h)).otherwise(0)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0).cast("long")


def _counts(docs: DataFrame, text_col: str, lang_col: str | None, common: dict[str, list[str]], name: str) -> DataFrame:
    """docs with a struct of what is counted in each row's text."""
    lang = F.col(lang_col) if lang_col else F.lit(None)
    d = docs.select(F.struct(*map(F.col, docs.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.cast("string").alias("lang"))
    words = F.array_remove(F.split(F.regexp_replace("text", "[\\x09-\\x0D]", " "), " "), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    lists = F.create_map(*[c for k, ws in common.items() for c in (F.lit(k), F.array(*map(F.lit, ws)))])
    d = d.select("row", "lang", "text", words.alias("words"), lines.alias("lines"), F.try_element_at(lists, "lang").alias("common"))
    rest, classes = F.col("text"), []
    for pattern in CHAR_CLASSES:
        less = F.regexp_replace(rest, pattern + "+", "")
        classes.append(F.length(rest) - F.length(less))
        rest = less
    classes.append(F.length(rest))
    known = sorted({w for ws in common.values() for w in ws})
    counted = let(F.filter("words", lambda w: w.isin(known)), lambda ws: F.transform("common", lambda k: F.size(F.filter(ws, lambda w: w == k)).cast("long")))
    counts = F.struct(
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.array(*[c.cast("long") for c in classes]).alias("chars"),
        F.coalesce(counted, F.array().cast("array<long>")).alias("common"),
    )
    return d.select("row.*", counts.alias(name))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total), F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (root of the divergence, logarithms of base 2) of two equally long arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) / 2 + part(b, (a + b) / 2) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def _base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 20 * n_words)


def _histograms(q: Callable[[str], Column]) -> tuple[Column, Column]:
    """Shares of the character classes, and of the common words with one bin for all others."""
    other = q("n_words") - F.aggregate(q("common"), F.lit(0).cast("long"), lambda a, x: a + x)
    return _shares(q("chars"), q("n_chars")), _shares(F.concat(q("common"), F.array(other)), q("n_words"))


def references(found: DataFrame, name: str, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """(all, ref_lang, ref_p, ref_w): a reference for each language with texts enough, and (all = 1) one of all texts together, from counts in column `name`."""
    q = lambda c: F.col(f"{name}.{c}")
    by_char, by_word = _histograms(q)
    longest = max(map(len, common.values()), default=0) + 1
    k = len(CHAR_CLASSES) + 1
    typical = lambda c, i: F.percentile_approx(F.get(c, F.lit(i)), 0.5, 1000)
    usual = found.where(~_base_failed(q("n_words"), q("n_repeat_words")) & (q("n_chars") >= MIN_CHARS_CHAR))
    usual = usual.select(q("lang").alias("ref_lang"), by_char.alias("p"), by_word.alias("w"))
    # the bins are fixed, so a language is one small row
    profile = [F.array(*[typical("p", i) for i in range(k)]).alias("p"), F.array(*[typical("w", i) for i in range(longest)]).alias("w"), F.count("*").alias("n")]
    refs = usual.rollup("ref_lang").agg(F.grouping_id().alias("all"), *profile).where(F.col("n") >= MIN_REFERENCE)
    whole = lambda c: let(F.filter(c, lambda x: x.isNotNull()), lambda a: _shares(a, F.aggregate(a, F.lit(0.0), lambda t, x: t + x)))
    return cut(refs.select("all", "ref_lang", whole(F.col("p")).alias("ref_p"), whole(F.col("w")).alias("ref_w")))


def _judged(found: DataFrame, refs: DataFrame, name: str, max_char: float, max_word: float) -> DataFrame:
    """found, whose column `name` holds the counts, with that column replaced by the counts and the verdict."""
    q = lambda c: F.col(f"{name}.{c}")
    by_char, by_word = _histograms(q)
    pooled = refs.where("all = 1").first()
    pooled_p = F.array(*map(F.lit, pooled["ref_p"])) if pooled else F.lit(None).cast("array<double>")
    refs = refs.where("all = 0").drop("all")
    few = refs.count() <= MOST_LANGUAGES
    joined = found.join(F.broadcast(refs) if few else refs, q("lang").eqNullSafe(F.col("ref_lang")), "left")
    char_distance = F.when(q("n_chars") >= MIN_CHARS_CHAR, distance(by_char, F.coalesce("ref_p", pooled_p)))
    word_distance = F.when((q("n_words") >= MIN_WORDS_WORD) & (F.size(q("common")) > 0) & F.col("ref_w").isNotNull(), distance(by_word, F.col("ref_w")))
    rest = [F.col(c) for c in found.columns if c != name]
    counts = [q(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")]
    base = _base_failed(q("n_words"), q("n_repeat_words")).alias("base_failed")
    joined = joined.select(*rest, F.struct(*counts, base, char_distance.alias("char_distance"), word_distance.alias("word_distance")).alias(name))
    far_char = F.coalesce(q("char_distance"), F.lit(0.0)) > max_char + CHAR_NOISE / F.sqrt(q("n_chars"))
    far_word = F.coalesce(q("word_distance"), F.lit(0.0)) > max_word
    return joined.withColumn(name, F.struct(f"{name}.*", (~q("base_failed") & ~far_char & ~far_word).alias("kept")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", common: dict[str, list[str]] = COMMON_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    Base rules: fewer than 10 words, or more than a fifth of the words in repeated
    5-word windows. Then the text's histogram of character classes, and that of its
    language's common words (with one bin for all others), are held against the
    language's reference by Jensen-Shannon distance. A reference is each bin's median
    share over the language's texts that pass the base rules, so junk doesn't move
    it. A language (or null) with fewer than MIN_REFERENCE such texts has none: its
    texts are held against the characters of all languages together, and if those
    are too few too, against nothing. Texts under the minimum length are not judged
    by that histogram (distance null). A text in a language without a word list is
    judged by characters only. Null and empty texts have no words and fail the base
    rules; very long ones are counted whole. Repeated rows are judged alike and stay;
    other columns are not read; empty tables give empty results."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None)).cast("string").alias("lang"))
    found = cut(_counts(rows, "text", "lang", common, "q").select("doc_id", "q"))
    return _judged(found, references(found, "q", common), "q", max_char, max_word).select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")])


def keep_good(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs without the rows that the rules reject.

    Each row is judged on its own text, so null and repeated ids need no rule. Texts
    are counted twice, once for the references and once in place for the verdict:
    neither texts nor counts are shuffled or stored."""
    name = "counts"
    while name in docs.columns:
        name += "_"
    found = _counts(docs, "text", "lang", common, name)
    return _judged(found, references(found, name, common), name, max_char, max_word).where(f"{name}.kept").select(*docs.columns)
