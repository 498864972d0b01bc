"""Column helpers for names, URLs and running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyser: lower-cased runs of letters and digits, in any script. No stemming.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def slug(name: Column) -> Column:
    """Lower case; every run outside ``[a-z0-9]`` becomes one ``-``; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def fold(name: Column) -> Column:
    """Case-insensitive identity of a name."""
    return F.lower(name)


def host(url: Column) -> Column:
    """Host of an absolute URL without user info, port and a leading ``www.``; else NULL.

    A space in the path is fine; a space or another forbidden sign in the host, a bad port or
    a missing scheme is not. Percent-decoding and IDNA mapping of hosts are not attempted.
    """
    raw = F.regexp_replace(F.btrim(url), "[\t\r\n]", "")
    web = raw.rlike(r"(?i)^(https?|wss?|ftp):")
    web_rest = F.regexp_extract(raw, r"(?i)^(?:https?|wss?|ftp):[/\\]*([^/\\?#]*)", 1)
    other_rest = F.regexp_extract(raw, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    authority = F.regexp_replace(F.when(web, web_rest).otherwise(other_rest), r"^.*@", "")
    name = F.regexp_extract(authority, r"^(\[[0-9a-fA-F:.]+\]|[^:]*)(?::[0-9]{0,5})?$", 1)
    name = F.when(web, F.lower(name)).otherwise(name)
    ok = ~name.rlike(r"[\s<>^|%]")
    return F.when(ok, F.nullif(F.regexp_replace(name, r"^www\.", ""), F.lit("")))


def like_pattern(term: str) -> str:
    """``%term%`` with the wildcards inside the term taken literally."""
    quoted = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{quoted}%"


def contains_ci(text: Column, term: str) -> Column:
    return text.ilike(like_pattern(term))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    trimmed = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " ")))


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` consecutive words, joined by a space."""
    last = F.size(words) - F.lit(n)
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(n))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def ngrams_upto(words: Column, n_max: int) -> Column:
    return F.concat(*[ngrams(words, n) for n in range(1, n_max + 1)])


def markers(text: Column) -> Column:
    """Distinct numbers of inline ``[n]`` markers."""
    found = F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def fingerprint(words: Column, function_words: list[str], length: int) -> Column:
    """Shape of the first ``length`` words: function words stay, all others become ``X``."""
    keep = F.array(*[F.lit(w) for w in function_words])
    head = F.slice(words, F.lit(1), F.lit(length))
    return F.concat_ws(" ", F.transform(head, lambda w: F.when(F.array_contains(keep, w), w).otherwise(F.lit("X"))))


def tail(words: Column, length: int) -> Column:
    """The last ``length`` words, or all when there are fewer."""
    return F.slice(words, F.greatest(F.size(words) - F.lit(length), F.lit(0)) + 1, F.lit(length))
