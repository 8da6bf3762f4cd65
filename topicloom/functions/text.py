"""Text expressions: tokens, n-grams, snippets, hashes, labels, tolerant JSON. JVM-side unless said."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, least: int = 2, stop: Iterable[str] | None = None) -> Column:
    """Lower-case runs of letters, digits and underscores of ``least`` characters or more, less stop words.

    ``[\\p{L}\\p{N}_]`` means the same in Java, RE2 and Python, which ``\\w`` and ``\\b`` do not.
    """
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))
    if stop:
        words = sorted(stop)
        found = F.filter(found, lambda t: ~t.isin(words))  # a hash set, where array_contains would scan
    return found


def ngrams(t: Column, least: int = 1, most: int = 2) -> Column:
    """All n-grams of an array of tokens, joined by a space.

    Pass a column that holds the tokens, not the expression that makes them, or it is evaluated again.
    """
    parts, grams = [], t
    for n in range(1, most + 1):
        if n > 1:  # the (n - 1)-gram at i and the token at i + n - 1
            left, right = F.slice(grams, 1, F.greatest(F.size(t) - (n - 1), F.lit(0))), F.slice(t, n, F.greatest(F.size(t) - (n - 1), F.lit(0)))
            grams = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= least:
            parts.append(grams)
    return F.concat(*parts)


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def first_sentence(text: Column, most: int = 240) -> Column:
    return F.substring(F.element_at(F.split(F.trim(text), r"(?<=[.!?])\s+", 2), 1), 1, most)


def strip_marker(text: Column) -> Column:
    """Without a leading list marker such as ``- ``, ``* ``, ``3. `` or ``b) ``."""
    return F.trim(F.regexp_replace(F.trim(text), r"^(?:[-*•–]|\(?(?:[0-9]{1,3}|[A-Za-z])[.)])\s+", ""))


def explode_clean(text: Column, by: str = "|") -> Column:
    """Parts between separators, trimmed, without list markers and without empty ones."""
    parts = F.transform(F.split(text, re.escape(by)), strip_marker)
    return F.filter(parts, lambda p: p != "")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def uniform_from_hash(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits, the same in any engine with sha256."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def split_for_hash(digest: Column, holdout: float = 0.2) -> Column:
    return F.when(uniform_from_hash(digest) < holdout, "holdout").otherwise("train")


def label_key(label: Column, words: int = 3) -> Column:
    """The first lower-cased words of a label: equal keys are a collision."""
    return F.array_join(F.slice(F.split(F.lower(F.trim(label)), r"\s+"), 1, words), " ")


def simple_label(keywords: Column) -> Column:
    return F.array_join(F.transform(F.slice(keywords, 1, 3), F.initcap), " & ")


def simple_description(keywords: Column) -> Column:
    return F.concat(F.lit("Documents about "), F.array_join(F.slice(keywords, 1, 6), ", "))


# ---- tolerant parsing of model replies: slice, then parse, then pick by pattern ----------------------


def json_slice(raw: Column) -> Column:
    """From the first brace to the last one."""
    return F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)


def answers(raw: Column, allowed: str = "BC", n: Column | None = None) -> Column:
    """Letters of a reply: of its JSON field ``answers``, else of any quoted or bare single letters.

    With n the array is padded with null or cut to that length; letters that are not allowed are null.
    """
    parsed = F.from_json(json_slice(raw), "answers array<string>")["answers"]
    bare = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(rf"(?:^|[^A-Za-z])([{allowed}])(?:[^A-Za-z]|$)"), F.lit(1))
    got = F.coalesce(parsed, bare)
    got = F.transform(got, lambda x: F.when(F.upper(F.trim(x)).isin(*allowed), F.upper(F.trim(x))))
    if n is not None:
        got = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i <= F.size(got), F.get(got, i - 1)))
        got = F.when(n > 0, got).otherwise(F.array().cast("array<string>"))
    return got


# ---- quotations (NFKC has no SQL function) ------------------------------------------------------------

_QUOTED = re.compile(r"(?:(?<=^)|(?<=[\s(\[—–-]))(?:\"([^\"\n]{3,200})\"|“([^”\n]{3,200})”|'([^'\n]{3,200})'|‘([^’\n]{3,200})’)(?=$|[\s.,;:!?)\]—–-])")
_FOLD = str.maketrans({"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "`": "'", "–": "-", "—": "-"})


def fold_quotes(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).translate(_FOLD).lower().split())


def quotes_of(narrative: str | None) -> list[str]:
    """Quoted phrases of 3 to 200 characters, unless they are most of the narrative."""
    text = narrative or ""
    found = [next(g for g in m.groups() if g is not None).strip() for m in _QUOTED.finditer(text)]
    return [q for q in found if len(q) >= 3 and len(q) < 0.8 * max(1, len(text.strip()))]


def unverified(narrative: str | None, sources: Iterable[str]) -> list[str]:
    """Quotations that no source contains."""
    body = [fold_quotes(s) for s in sources if s]
    return [q for q in quotes_of(narrative) if (f := fold_quotes(q).strip(" .,;:!?")) and not any(f in b for b in body)]


def extract_quotes(narratives: Column) -> Column:
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(quotes_of)

    return F.pandas_udf(run, "array<string>")(narratives)


def unverified_quotes(narratives: Column, sources: Column) -> Column:
    def run(ns: pd.Series, ss: pd.Series) -> pd.Series:
        return pd.Series([unverified(n, list(x) if x is not None else []) for n, x in zip(ns, ss, strict=True)])

    return F.pandas_udf(run, "array<string>")(narratives, sources)
