"""Text expressions: keywords, HTML stripping, OCR line filter, titles, prompts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that are no keywords.
STOPWORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "have", "been", "were", "they",
    "this", "that", "with", "from", "what", "which", "when", "where", "who", "how", "why", "will", "would", "could", "should", "there", "their",
    "about", "into", "does", "did", "get", "got", "give", "make", "just", "only", "come", "than", "like", "other", "then", "its", "also", "these",
    "more", "some", "very", "after", "most", "made", "find", "here", "many", "such", "way", "each", "she", "him", "his", "may", "any", "being",
    "use", "using",
]
# Fixed value: a word of three or more letters, digits or underscores of any script.
WORD = r"[\p{L}\p{N}_]{3,}"
MAX_KEYWORDS = 5


def keywords(question: Column) -> Column:
    """The first five words of a question that are no stop words; repeats count."""
    found = F.regexp_extract_all(F.lower(question), F.lit(WORD), 0)
    return F.slice(F.filter(found, lambda w: ~w.isin(STOPWORDS)), 1, MAX_KEYWORDS)


def keyword_candidate(content: Column, words: list[str]) -> Column:
    """ILIKE any of the words: an underscore in a word stands for any character."""
    out = F.lit(False)
    for w in words:
        out = out | content.ilike(f"%{w}%")
    return out


def keyword_score(content: Column, words: list[str]) -> Column:
    """How many of the words, repeats counted, the lower-cased content holds literally."""
    lowered = F.lower(content)
    return sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All HTML entities; Spark has no function for the named ones."""
    return text.map(html.unescape, na_action="ignore")


def strip_tags(content: Column) -> Column:
    """HTML without scripts, styles and tags, white space collapsed; entities still escaped."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?is)<script\b[^>]*>.*?</script>", ""), r"(?is)<style\b[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"(?U)\s+", " "))


def html_text(content: Column) -> Column:
    """Readable text of an HTML page; null where nothing is left."""
    stripped = strip_tags(content)
    whole = F.when(stripped.contains("&"), unescape_html(stripped)).otherwise(stripped)
    return F.when(stripped != "", whole)


def ocr_line_ok(line: Column) -> Column:
    """Whether a trimmed line of OCR output is worth keeping.

    Two characters at least, 30 % of them letters or digits, at most 30 % rules and
    bars, and of more than three words at most half of one character.
    """
    n = F.length(line)
    count = lambda pattern: n - F.length(F.regexp_replace(line, pattern, ""))
    tokens = F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")
    singles = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    wordy = (F.size(tokens) <= 3) | (singles <= F.size(tokens) * 0.5)
    return (n >= 2) & (count(r"[\p{L}\p{N}]") >= n * 0.3) & wordy & (count(r"[-=|_]") <= n * 0.3)


def clean_ocr(text: Column) -> Column:
    """The lines that ocr_line_ok keeps, trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, ocr_line_ok), "\n")


def confidence(text: Column, full: int = 200) -> Column:
    """How much of 200 characters a recognized text has, at most 1."""
    return F.least(F.lit(1.0), F.length(text) / F.lit(float(full)))


def session_title(question: Column, most: int = 50) -> Column:
    return F.concat(F.substring(question, 1, most), F.when(F.length(question) > most, "...").otherwise(""))


def context_block(position: Column, source: Column, content: Column) -> Column:
    """One numbered document of a prompt."""
    return F.concat(F.lit("[Document "), position.cast("string"), F.lit(": "), F.coalesce(source, F.lit("Unknown")), F.lit("]\n"), content)


def history_line(role: Column, content: Column, most: int = 500) -> Column:
    return F.concat(F.when(role == "user", "User: ").otherwise("Assistant: "), F.substring(content, 1, most))


def format_sources(sources: Column) -> Column:
    """Names of sources as an array of structs with a filename; none for null."""
    return F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(s.alias("filename")))


def safe_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))
