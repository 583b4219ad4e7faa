"""Text expressions: slugs, captions, word counts, number parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespan import constants as K


def lits(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def extracted(col: Column, pattern: str, group: int = 1) -> Column:
    """The regex group, NULL where the pattern does not occur."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def slug(col: Column, limit: int = 40) -> Column:
    """File-name slug: unsafe runs to ``_``, cut, then strip ``_``."""
    s = F.regexp_replace(col, r"""[/\\\s:|"'?*]+""", "_")
    s = F.btrim(F.substring(s, 1, limit), F.lit("_"))
    return F.when(s == "", F.lit("clip")).otherwise(s)


def transcript_slug(col: Column, limit: int = 48) -> Column:
    """Transcript directory slug: non-word runs to ``_``, strip, and only then cut."""
    s = F.btrim(F.regexp_replace(col, r"(?U)[^\w一-鿿]+", "_"), F.lit("_"))
    return F.substring(F.when(s == "", F.lit("asr")).otherwise(s), 1, limit)


def safe_title(col: Column, limit: int = 60) -> Column:
    s = F.btrim(F.regexp_replace(col, r"(?U)[^\w一-鿿（）()]+", " "))
    return F.substring(F.when(s == "", F.lit("live")).otherwise(s), 1, limit)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return (gone / F.length(word)).cast("long")


def emotion_count(text: Column, words: Sequence[str] = tuple(K.EMOTION_WORDS)) -> Column:
    """Exclamation words; a one-character word counts n-1 times and only from two on."""
    body = F.coalesce(text, F.lit(""))

    def add(acc: Column, w: Column) -> Column:
        n = occurrences(body, w)
        single = F.when(n >= 2, n - 1).otherwise(F.lit(0).cast("long"))
        return acc + F.when(F.length(w) == 1, single).otherwise(n)

    return F.aggregate(lits(words), F.lit(0).cast("long"), add)


def repeat_count(text: Column, chars: str = K.REPEAT_CHARS) -> Column:
    """Runs of one listed character: 1 each, 2 from four characters on."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((.)\2+)"), 1)
    listed = F.filter(runs, lambda r: F.contains(F.lit(chars), F.substring(r, 1, 1)))
    return F.aggregate(
        listed,
        F.lit(0).cast("long"),
        lambda acc, r: acc + F.when(F.length(r) >= 4, 2).otherwise(1),
    )


def dense_length(text: Column) -> Column:
    """Characters without blanks."""
    return F.length(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(lits(words), lambda w: F.contains(text, w))


def to_count(col: Column) -> Column:
    """``3``, ``三`` or ``8,926,620`` as a number, else NULL."""
    s = F.btrim(col.cast("string"))
    plain = F.replace(s, F.lit(","), F.lit(""))
    digit = F.when(F.length(s) == 1, F.instr(F.lit(K.CHINESE_DIGITS), s))
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("long")).otherwise(
        F.when(digit > 0, digit.cast("long"))
    )


def first_listed(text: Column, items: Sequence[tuple[str, int]], source: str) -> Column:
    """(price, source) of the first item in list order that the text contains."""
    hits = [
        F.when(
            F.contains(text, F.lit(name)),
            F.struct(F.lit(int(price)).cast("long").alias("price"), F.lit(source).alias("price_source")),
        )
        for name, price in items
    ]
    return F.coalesce(*hits)


def estimate_price(
    text: Column,
    prices: Sequence[tuple[str, int]] = tuple(K.PRICES),
    fallback: Sequence[tuple[str, int]] = tuple(K.QUALITY_PRICES),
) -> Column:
    """Struct (price, price_source): named items first, then the quality words, else NULL."""
    return F.coalesce(
        first_listed(text, prices, "table"), first_listed(text, fallback, "quality")
    )


def dearest_named(text: Column, prices: Sequence[tuple[str, int]] = tuple(K.PRICES)) -> Column:
    """Name of the dearest listed item in the text (list order breaks ties)."""
    ranked = sorted(prices, key=lambda kv: -kv[1])
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n, _ in ranked])


def kill_word(n: Column, default: Column | None = None) -> Column:
    out = None
    for k, word in K.KILL_WORDS.items():
        out = F.when(n == k, word) if out is None else out.when(n == k, word)
    other = F.concat(n.cast("string"), F.lit("杀")) if default is None else default
    return out.otherwise(other)


def in_wan(price: Column) -> Column:
    return F.bround(price / F.lit(10000)).cast("long")


def wan_tag(price: Column) -> Column:
    return F.concat(F.lit("+"), in_wan(price).cast("string"), F.lit("万"))


def loot_caption(price: Column) -> Column:
    p = F.coalesce(price, F.lit(0))
    return (
        F.when(p >= 3_000_000, "出大红！").when(p >= 1_000_000, "出红！").otherwise("高价值！")
    )


def cjk_count(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^一-鿿]", ""))
