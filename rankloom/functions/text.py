"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A few of the most frequent English words; pass a longer list as a parameter where one is at hand.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def tokens(text: Column) -> Column:
    """Lower-cased words: letters, digits, dots and apostrophes stay, a dot within a word separates."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}.']", " ")
    clean = F.regexp_replace(clean, r"\.(?=[^ ])", " ")
    return F.filter(F.split(clean, " +"), lambda t: t != "")


def keep_token(t: Column) -> Column:
    """A letter or digit; no more than four digits and no more than three equal letters at the end; under 64 characters."""
    return t.rlike(r"[\p{L}\p{Nd}]") & ~t.rlike(r"\p{Nd}{5}$") & ~t.rlike(r"(\p{L})\1{3}$") & (F.length(t) < 64)


def content_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that pass the filters, without stop words and numbers."""
    return F.filter(tokens(text), lambda t: keep_token(t) & ~t.isin(*stop_words) & t.try_cast("double").isNull())


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def query_terms(text: Column) -> Column:
    """Tags off, lower case, possessive s off, split at spaces."""
    return F.filter(F.split(F.regexp_replace(F.lower(strip_tags(text)), "'s", ""), " "), lambda t: t != "")


def query_chunks(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(F.transform(F.split(text, r"[ /,!\-:']"), lambda t: F.lower(F.trim(t))), lambda t: (t != "") & (t != "s") & ~t.isin(*stop_words))


def sparse_vector(entries: Column) -> Column:
    """`id:value` pairs of a map, by id, values rounded to 8 places, zeros left out, as %.4E."""
    pairs = F.filter(F.array_sort(F.map_entries(entries)), lambda e: F.round(e["value"], 8) != 0)
    return F.array_join(F.transform(pairs, lambda e: F.format_string("%d:%.4E", e["key"], F.round(e["value"], 8))), " ")


def term_ids(words: Column, vocabulary: Column) -> Column:
    """Distinct ids of the words that a map knows."""
    return F.array_distinct(F.filter(F.transform(words, lambda t: vocabulary[t]), lambda i: i.isNotNull()))


def topic_of_path(path: Column) -> Column:
    """The digits before a dash at the start of a file name."""
    return F.regexp_extract(path, r"([0-9]+)-[^/]*$", 1).cast("int")


def title_and_body(html: Column) -> Column:
    """Struct of title and body text, tags off and white space single; a title of one character or none is empty."""
    def plain(x: Column) -> Column:
        return F.trim(F.regexp_replace(strip_tags(x), r"\s+", " "))

    title = plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = plain(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), r"(?i)</?(p|div|li|h[1-6]|br|ul|nav|article|footer)\b[^>]*>", " "))
    return F.struct(F.when(F.length(title) > 1, title).otherwise("").alias("title"), body.alias("body"))
