"""Version and build ordering through struct comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILD = r"^(\d{8})-r(\d+)([a-z]*)$"


def version_struct(v: Column) -> Column:
    """Three numbers; missing pieces are 0, anything not numeric makes all of them 0."""
    pieces = F.filter(F.split(v, r"\."), lambda p: p != "")
    ok = F.forall(pieces, lambda p: p.rlike(r"^\s*[+-]?\d+\s*$"))

    def nth(i: int) -> Column:
        n = F.coalesce(F.btrim(F.get(pieces, F.lit(i))).try_cast("int"), F.lit(0))
        return F.when(ok, n).otherwise(F.lit(0))

    return F.struct(nth(0).alias("major"), nth(1).alias("minor"), nth(2).alias("patch"))


def build_struct(b: Column) -> Column:
    ok = b.rlike(_BUILD)
    return F.struct(
        F.when(ok, F.regexp_extract(b, _BUILD, 1).try_cast("int")).otherwise(0).alias("day"),
        F.when(ok, F.regexp_extract(b, _BUILD, 2).try_cast("int")).otherwise(0).alias("run"),
        F.when(ok, F.regexp_extract(b, _BUILD, 3)).otherwise("").alias("tail"),
    )


def newer_than(v_new: Column, b_new: Column, v_cur: Column, b_cur: Column) -> Column:
    vn, vc = version_struct(v_new), version_struct(v_cur)
    return F.when(vn != vc, vn > vc).otherwise(build_struct(b_new) > build_struct(b_cur))


def below_minimum(v_cur: Column, minimum: Column) -> Column:
    floor = F.btrim(F.coalesce(minimum, F.lit("")))
    return F.when(floor == "", False).otherwise(version_struct(v_cur) < version_struct(floor))
