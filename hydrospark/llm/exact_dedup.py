"""Exact duplicates by distributed most-significant-digit radix partitioning over the texts' own bytes.

A text is the byte string of its length followed by its normalised UTF-8 bytes. Each level splits the open groups by the
next digit: the length and the first bytes at level 0, then slices that grow by a constant factor, so that a text of
any length is done after few levels. A digit is compared as it is; no digest decides that two texts are equal. Only
groups that still hold several rows go on to the next level, with the bytes that are left of them; a group of one row, or
one whose text has ended, is settled.

A level is one aggregate (rows of a group are counted within tasks first, so that thousands of copies reach the shuffle
as one row for each task) and one join that hands each row its new group. The join's right side has one row for each
group of several rows; a group that holds a third of all rows is split over tasks by the adaptive skew join, for which
every row on the left needs that one right row alone.

Defined results: a null text counts as empty, and all empty texts are one group. Rows with a null id take part; an id
counts as smaller than a null, and a group without any id has a null `keep_id`. Of rows repeated with one id and one text
exactly one stays. An empty table gives an empty result. Ids may be of any type that can be ordered; other columns may have
any names. Texts of any length take part whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.shared import staged

WHITE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Radix:
    """Bytes of the first digit, and how many times as many bytes each further digit takes."""

    first: int = 32
    growth: int = 32


def normalised(text):
    """The UTF-8 bytes of a text with each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ").cast("binary")


def _split(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups of at least two rows by their digit: keys, node, n and keep (smallest id); nodes are numbered as written."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("keep")).filter("n > 1")
    return staged(found.withColumn("child", F.monotonically_increasing_id()), label)


def _level(rows: DataFrame, keys: list[str], done: int, label: str) -> DataFrame:
    """Each row with the group that its digit puts it in (null: alone) and the bytes after the digit, written."""
    groups = _split(rows, keys, f"{label}-groups").hint("shuffle_hash")
    kept = [c for c in rows.columns if c not in ("node", "digit", "rest")]
    open_ = F.col("child").isNotNull() & (F.col("size") > done)
    return staged(rows.join(groups, keys, "left").select(
        *kept, F.col("child").alias("node"), "n", "keep", F.when(open_, F.col("rest")).alias("rest")), label)


def _settled(docs: DataFrame, radix: Radix, text: str, doc_id: str, whole_rows: bool) -> DataFrame:
    """Every row once, when its group is final: id, sha, [row], level, node (null: no equal text), n, keep."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    rows = docs.select(F.col(doc_id).alias("id"), normalised(F.col(text)).alias("t"), *carried).select(
        "id", *(["row"] if carried else []), F.sha2("t", 256).alias("sha"), F.octet_length("t").alias("size"),
        F.substring("t", 1, radix.first).alias("digit"), F.substring("t", radix.first + 1, 2**31 - 1).alias("rest"))
    done, width, level, parts = radix.first, radix.first, 0, []
    table = _level(rows, ["size", "digit"], done, "radix-0")
    while True:
        going = F.col("node").isNotNull() & (F.col("size") > done)
        parts.append(table.filter(~going).drop("rest", "size").withColumn("level", F.lit(level)))
        rest = table.filter(going)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        width, level = width * radix.growth, level + 1
        rows = rest.drop("n", "keep").withColumns({
            "digit": F.substring("rest", 1, width), "rest": F.substring("rest", width + 1, 2**31 - 1)})
        done += width
        table = _level(rows, ["node", "digit"], done, f"radix-{level}")


def groups(docs: DataFrame, radix: Radix = Radix(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    rows = _settled(docs, radix, text, doc_id, False)
    alone = F.col("node").isNull()
    own_id = F.col("id").eqNullSafe(F.col("keep"))
    by = ["level", "node", "id", "keep", "n", "sha"]
    firsts = rows.filter(~alone & own_id).groupBy(*by).count().withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).withColumn("kept", F.col("copy") == 1)
    out = (rows.filter(alone).withColumns({"keep": F.col("id"), "n": F.lit(1).cast("long"), "kept": F.lit(True)}),
           rows.filter(~alone & ~own_id).withColumn("kept", F.lit(False)), firsts)
    return reduce(DataFrame.unionByName, [part.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.col("sha").alias("text_sha256")) for part in out])


def keep_first(docs: DataFrame, radix: Radix = Radix(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with their columns: of equal texts the one with the smallest id.

    Of rows repeated with that id the first stays by the order of the whole row written as JSON.
    """
    rows = _settled(docs, radix, text, doc_id, True)
    own = rows.filter(F.col("node").isNotNull() & F.col("id").eqNullSafe(F.col("keep")))
    one = own.groupBy("level", "node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return rows.filter(F.col("node").isNull()).select("row").unionByName(one).select("row.*")
