"""Text scalars as column expressions: normalising, stemming, tokens, shingles, scrubbing, capping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words, then words that are frequent in feedback and carry no topic.
STOPWORDS = """
a about after all also am an and any are as at back be because been before being but by can cannot cant could did do does doing done dont
each even ever every for from get gets getting had has have having he her here him his how i if im in into is it its ive just like
me more most much my no not now of off on one only or other our out over own she so some still such than that the their them then
there these they thing things this those through to too under until up us use used using very was way we well were what when where which
while who why will with would you your
add adding need needs needed want wants wanted please pls plz thanks thank hi hello app guys feature request support able allow let make give
""".split()


def normalize(text: Column) -> Column:
    """Lower case; only a-z, 0-9 and single spaces remain."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def stem(word: Column) -> Column:
    """Plural and tense endings cut off; words of three letters or fewer stay as they are."""
    n = F.length(word)

    def undouble(base: Column) -> Column:
        return F.when(base.rlike(r"([^aeiou])\1$"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)

    short = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(short(3), F.lit("y")))
        .when(word.endswith("sses"), short(2))
        .when(word.endswith("ses") & (n > 4), short(2))
        .when((n > 4) & word.rlike("(ch|sh|x|z|s)es$"), short(2))
        .when(word.endswith("s") & ~word.endswith("ss") & ~word.endswith("us"), short(1))
        .when(word.endswith("ing") & (n > 5), undouble(short(3)))
        .when(word.endswith("ed") & (n > 4), undouble(short(2)))
        .otherwise(word)
    )


def tokenize(text: Column, *, stopwords: bool = True, stemming: bool = True, min_length: int = 3, bigrams: bool = False) -> Column:
    """Tokens in order; length is tested before stemming; bigrams follow the single tokens."""
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    if stopwords:
        listed = F.array(*[F.lit(s) for s in STOPWORDS])
        words = F.filter(words, lambda w: ~F.array_contains(listed, w))
    words = F.filter(words, lambda w: F.length(w) >= min_length)
    if stemming:
        words = F.transform(words, stem)
    if not bigrams:
        return words
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws("_", a, b)))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def shingles(text: Column, size: int = 3) -> Column:
    """Sliding character runs of the trimmed text; a text no longer than size is its own shingle."""
    t = F.trim(text)
    n = F.length(t)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= size, F.array(t))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(size))))
    )


def top_content_word(text: Column) -> Column:
    """The longest word of more than two letters that is no stopword; the first of equally long ones; '' if there is none."""
    words = tokenize(text, stemming=False)
    return F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def scrub_variable_data(text: Column) -> Column:
    """Identifiers and numbers replaced by their kind, specific shapes first, so that occurrences of one message compare equal."""
    for pattern, mark in (
        (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
        (r"(?i)\b(?=[0-9a-f]*\d)[0-9a-f]{16,}\b", "<hash>"),
        (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "<ts>"),
        (r"(?i)\b0x[0-9a-f]+\b", "<hex>"),
        (r"\b[A-Z]{1,5}-\d+\b", "<id>"),
        (r"\b\d+(?:\.\d+)?(?=(?:ms|s|kb|mb|gb|px|%)?(?:\b|$))", "<num>"),
    ):
        text = F.regexp_replace(text, pattern, mark)
    return text


def cap(text: Column, most: int) -> Column:
    """A text cut to most characters, with the number of those cut off."""
    if most <= 0:
        return F.lit("")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…[+"), (F.length(text) - most).cast("string"), F.lit("]")))
