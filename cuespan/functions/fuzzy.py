"""Fuzzy text matches that forgive one misread character."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.functions.text import lits


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often and in whatever lambda ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_le1(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def same_target(a: Column, b: Column) -> Column:
    """Whether two readings of a name mean the same target.

    Equal, one edit apart, one inside the other, or the same first two and last characters with
    lengths at most one apart (from three characters on). A blank name only equals a blank one.
    """
    la, lb = F.length(a), F.length(b)
    skeleton = (
        (F.least(la, lb) >= 3)
        & (F.substring(a, 1, 2) == F.substring(b, 1, 2))
        & (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))
        & (F.abs(la - lb) <= 1)
    )
    close = edit_le1(a, b) | F.contains(a, b) | F.contains(b, a) | skeleton
    return F.when(a == b, True).when((la == 0) | (lb == 0), False).otherwise(close)


def match_operator(text: Column, names: Sequence[str] | None = None) -> Column:
    """Listed name contained in the Chinese characters of the text, else one edit away."""
    table = lits(names if names is not None else [n for n, _ in K.OPERATORS])

    def named(t: Column) -> Column:
        inside = F.get(F.filter(table, lambda n: F.contains(t, n)), F.lit(0))
        near = F.get(
            F.filter(table, lambda n: (F.length(n) >= 2) & (F.length(t) >= 2) & edit_le1(n, t)), F.lit(0)
        )
        return F.when(t != "", F.coalesce(inside, near))

    return bound(F.regexp_replace(text, r"[^一-鿿]", ""), named)


_LATIN = r"^[A-Za-z0-9\-\.]+$"


def clean_weapon(text: Column, names: Sequence[str] | None = None) -> Column:
    """Weapon name behind a reading, NULL for ammunition, calibres and interface words.

    The table is turned into literals here (upper case, Latin names apart), so that only the
    comparisons are left to do per row.
    """
    names = list(names if names is not None else [n for n, _ in K.WEAPONS])
    by_upper: dict[str, str] = {}
    for n in names:
        by_upper.setdefault(n.upper(), n)
    latin = [n for n in names if re.match(_LATIN, n)]
    by_name, uppers, listed, known = F.create_map(*[F.lit(x) for kv in by_upper.items() for x in kv]), lits([n.upper() for n in latin]), lits(latin), lits(names)

    def cleaned(v: Column) -> Column:
        text, t, up = v["text"], v["t"], F.upper(v["t"])
        usable = (
            F.length(t).between(2, 14)
            & ~t.rlike(K.AMMO_TEXT)
            & ~t.rlike(K.CALIBER_TEXT)
            & ~text.rlike(K.LOADOUT_NOISE)
            & ~text.rlike(K.HUD_NOISE)
            & t.rlike(r"[A-Za-z一-鿿]")
        )
        exact = F.element_at(by_name, up)
        close = bound(up, lambda u: F.array_position(F.transform(uppers, lambda n: edit_le1(n, u)), True))
        near = F.when(t.rlike(_LATIN), bound(close, lambda c: F.when(c > 0, F.element_at(listed, c.cast("int")))))
        cut = F.filter(known, lambda n: (n != t) & (F.startswith(n, t) | F.endswith(n, t)))
        whole = bound(cut, lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0))))
        return F.when(usable, F.coalesce(exact, near, whole, t))

    both = lambda x: F.struct(x.alias("text"), F.replace(F.btrim(x), F.lit(" "), F.lit("")).alias("t"))
    return bound(text, lambda x: bound(both(x), cleaned))


def lookup(name: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Value of a small fixed table, NULL for names it does not list."""
    pairs = [F.lit(x) for kv in table for x in kv]
    return F.element_at(F.create_map(*pairs), name)
