"""Text expressions: cleaning, tokens, n-grams, term counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Function words left out of the retrieval vocabulary; a parameter of the operators.
STOP_WORDS = tuple("""
    about above after again against all am an and any are as at be because been before being
    below between both but by can cannot could did do does doing down during each few for from
    further had has have having he her here hers herself him himself his how if in into is it
    its itself just me more most must my myself no nor not now of off on once only or other
    ought our ours ourselves out over own same she should so some such than that the their
    theirs them themselves then there these they this those through to too under until up very
    was we were what when where which while who whom why will with would you your yours
    yourself yourselves
""".split())

WORD = r"[\p{L}\p{N}_]"


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; null becomes empty."""
    return F.regexp_replace(or_empty(text), r"(?U)^\s+|\s+$", "")


def normalize(text: Column, quotes: bool = False) -> Column:
    """Stripped and in lower case; ``quotes`` also turns the curly apostrophe straight."""
    plain = F.lower(strip(text))
    return F.translate(plain, "’", "'") if quotes else plain


def clean(text: Column) -> Column:
    """Lower case without mentions, links and repeated white space."""
    no_mentions = F.regexp_replace(F.lower(or_empty(text)), "@" + WORD + "+", " ")
    no_links = F.regexp_replace(no_mentions, r"(?U)http\S+|www\.\S+", " ")
    return F.trim(F.regexp_replace(no_links, r"(?U)\s+", " "))


def cleaned_context(context: Column, message: Column) -> Column:
    return F.concat(clean(context), F.lit(" "), clean(message))


def raw_context(context: Column, message: Column) -> Column:
    return F.concat(or_empty(context), F.lit(" "), or_empty(message))


def template_context(context: Column, message: Column) -> Column:
    return F.concat(
        F.lit("Previous context: "), or_empty(context),
        F.lit("\nCustomer message: "), or_empty(message))


def merged_context(context: Column, message: Column) -> Column:
    """Both texts stripped, with a space between them only where both have content."""
    return F.concat_ws(
        " ", F.nullif(strip(context), F.lit("")), F.nullif(strip(message), F.lit("")))


def keyword_words(text: Column) -> Column:
    """Array of plain a-z words after link removal, possibly with empty strings."""
    no_links = F.regexp_replace(F.lower(or_empty(text)), r"(?U)http\S+", " ")
    return F.split(F.regexp_replace(no_links, "[^a-z]+", " "), " ")


def word_count(text: Column) -> Column:
    words = F.split(strip(text), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: w != ""))


def tokens(text: Column, stop_words=()) -> Column:
    """Words of at least two letters or digits, stop words left out."""
    words = F.regexp_extract_all(F.lower(or_empty(text)), F.lit("(" + WORD + "{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def with_bigrams(words: Column) -> Column:
    """The words and the pairs of neighbours."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, 1, last), F.slice(words, 2, last),
        lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
