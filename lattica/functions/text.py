"""Column builders for text: all native expressions, so that scoring stays in one codegen stage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def line_count(text: Column) -> Column:
    """Line feeds, plus one for a last line without one."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def has_word(text: Column, word: str) -> Column:
    """Whether the word stands in the text between characters that are no word characters; case counts."""
    if not word:
        return F.lit(False)
    return F.regexp_like(text, F.lit(f"(^|[^A-Za-z0-9_]){re.escape(word)}($|[^A-Za-z0-9_])"))


def split_identifier(name: Column) -> Column:
    """Lower-case parts between _ - . / and where a capital follows a small letter or digit."""
    marked = F.regexp_replace(name, r"([a-z0-9])(\p{Lu})", "$1_$2")
    return F.transform(F.filter(F.split(marked, r"[_\-./]"), lambda x: x != ""), F.lower)


def bigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Dice over sets of character pairs."""
    x, y = bigrams(a), bigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.octet_length(a) < 2) | (F.octet_length(b) < 2), 0.0).otherwise(2.0 * both / F.greatest(F.size(x) + F.size(y), F.lit(1)))


def score_match(text: Column, query: str) -> Column:
    """Relevance of lower-cased text to a lower-cased query; near spellings count where nothing else does."""
    terms, parts = query.split(), split_identifier(text)
    score = F.when(F.contains(text, F.lit(query)), 10).otherwise(0) + F.when(text == query, 20).otherwise(0)
    for t in terms:
        # a part that is the term stands in the text, so most texts are never split
        part = F.contains(F.lower(text), F.lit(t)) & F.array_contains(parts, t) if t.isascii() else F.array_contains(parts, t)
        score = score + F.when(F.contains(text, F.lit(t)), 5).otherwise(0) + F.when(part, 3).otherwise(0)
    if len(query) < 4:
        return score.cast("long")
    grams = {query[i : i + 2] for i in range(len(query) - 1)}
    both = sum((F.when(F.contains(text, F.lit(g)), 1).otherwise(0) for g in sorted(grams)), F.lit(0))
    near = 2.0 * both / (F.size(bigrams(text)) + len(grams))
    # bigram_similarity; a text has as many pairs as it shares, at least: only where that leaves enough are its own made
    likely = (F.octet_length(text) >= 2) & (2.0 * both > 0.4 * (both + len(grams)))
    fuzzy = F.when(likely, F.get(F.transform(F.array(near), lambda x: F.when(x > 0.4, F.floor(8 * x)).otherwise(0)), F.lit(0))).otherwise(0)
    return F.when(score == 0, fuzzy).otherwise(score).cast("long")


def glob_regex(pattern: str) -> str:
    """* and ? stop at /, ** doesn't; [..] is a class (! or ^ first: all others), {a,b} alternatives; without / it matches
    at any depth; without a mark: the path or what is below it."""
    if not any(c in pattern for c in "*?[{"):
        return "^" + re.escape(pattern.rstrip("/")) + "(/.*)?$"
    if "/" not in pattern:
        pattern = "**/" + pattern
    return "^" + _glob(pattern) + "$"


def _glob(pattern: str) -> str:
    out, i, open_ = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif close > 0:
            inner = pattern[i + 1 : close]
            no, inner = ("^", inner[1:]) if inner[0] in "!^" else ("", inner)
            out, i = out + f"[{no}{re.sub(chr(92) * 2 + '|[&^~' + chr(92) + '[]', lambda m: chr(92) + m.group(), inner)}]", close + 1
        elif c == "{" and "}" in pattern[i:]:
            out, i, open_ = out + "(", i + 1, open_ + 1
        elif c == "}" and open_:
            out, i, open_ = out + ")", i + 1, open_ - 1
        elif c == "," and open_:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return out


def under(path: Column, prefix: str) -> Column:
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def short_doc(text: Column, most: int = 80) -> Column:
    """Texts of over `most` bytes as their first line, cut to `most` characters, without dots at the end, and dots."""
    first = F.substring(F.substring_index(text, "\n", 1), 1, most)
    return F.when(F.octet_length(text) > most, F.concat(F.regexp_replace(first, r"\.+$", ""), F.lit("..."))).otherwise(text)
