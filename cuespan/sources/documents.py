"""Documents as files, one per session, streamed line by line.

A document is never an array: its lines are rows, dealt by session, sorted within the task (Spark spills what does
not fit) and written one after the other, so a task holds a line however long the document is. JSON documents keep
one list entry per line.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ALL = {"ignoreNullFields": "false"}
_FOLDER = "document"


def _line(section: int, place: Column, line: Column) -> list[Column]:
    return [F.lit(section).alias("section"), place.cast("long").alias("place"), line.alias("line")]


def json_lines(heads: DataFrame, lists: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Lines (session, section, place, line) of one JSON document per row of ``heads``.

    ``heads`` has the fields of the document, one row per session. Each of ``lists`` has the fields of its entries,
    the session, and the named column with the entry's place, 1 for the first. A session without entries
    gets an empty list; entries of sessions without a head, and rows without a session, are left out.
    """
    heads = heads.where(F.col("session").isNotNull())
    head = F.regexp_replace(F.to_json(F.struct(*heads.columns), _ALL), r"\}$", "")
    zero = F.lit(0)
    rows = [heads.select("session", *_line(0, zero, head))]
    for i, (name, (entries, place)) in enumerate(lists.items()):
        body = F.to_json(F.struct(*[c for c in entries.columns if c not in ("session", place)]), _ALL)
        comma = F.when(F.col(place) == 1, "").otherwise(",")
        rows.append(heads.select("session", *_line(2 * i + 1, zero, F.lit(f', "{name}": ['))))
        rows.append(
            entries.select("session", *_line(2 * i + 1, F.col(place), F.concat(comma, body))).join(
                heads.select("session"), "session", "left_semi"
            )
        )
        rows.append(heads.select("session", *_line(2 * i + 2, zero, F.lit("]"))))
    rows.append(heads.select("session", *_line(2 * len(lists) + 1, zero, F.lit("}"))))
    return reduce(DataFrame.unionByName, rows)


def text_lines(head: list[str], lines: DataFrame, place: str) -> DataFrame:
    """Lines of one text per session of ``lines`` (session, place, line): the ``head`` lines first."""
    sessions = lines.where(F.col("session").isNotNull()).select("session").distinct()
    tops = sessions.select("session", F.posexplode(F.array(*[F.lit(x) for x in head])).alias("place", "line"))
    return tops.select("session", *_line(0, F.col("place"), F.col("line"))).unionByName(
        lines.where(F.col("session").isNotNull()).select("session", *_line(1, F.col(place), F.col("line")))
    )


def write(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One file per session below ``path``, in the order of section and place."""
    # dealt by a hash of the session: Spark takes out a plain repartition where every branch of a union is dealt by
    # session already, and then still writes a file per branch
    dealt = lines.withColumn(_FOLDER, F.col("session")).repartition(F.xxhash64("session"))
    ordered = dealt.sortWithinPartitions(_FOLDER, "section", "place")
    ordered.select(_FOLDER, "line").write.mode(mode).partitionBy(_FOLDER).text(path)


def files_of(path: str) -> str:
    """Pattern of the files that ``write`` left below ``path``."""
    return f"{path}/{_FOLDER}=*/*.txt"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents as ``write`` left them, one row each."""
    return spark.read.schema(schema).option("multiLine", "true").json(files_of(path))
