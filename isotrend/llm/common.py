"""What several operators share: words, scratch tables, and keeping chosen rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrend.session import scratch_path

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(text), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order, an empty array where it has none."""
    return F.array_remove(F.split(text, SPACE), "")


def id_hash(doc_id: str) -> Column:
    """Unsigned crc32 of the id as text; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def id_remainder(doc_id: str, parts: int) -> Column:
    """``id_hash`` modulo ``parts``."""
    return F.pmod(id_hash(doc_id), F.lit(parts))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a reduced table to the shared folder once and go on from the files.

    Unlike a checkpoint the files carry their real size, which the planner then uses.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs of two tables."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def keep_rows(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id and ``text_key`` are among ``chosen``, all columns unchanged.

    With ``once``, of rows that repeat both id and text one stays. Rows meet by one hash of id and
    text, so the texts shuffle once for both.
    """
    keyed = docs.withColumns({"__text_key": F.xxhash64(text), "__row_key": F.xxhash64(doc_id, F.xxhash64(text))})
    chosen = chosen.select(F.col(doc_id).alias("__chosen_id"), F.col("text_key").alias("__chosen_key"),
                           F.xxhash64(doc_id, "text_key").alias("__chosen_row"))
    # Only the hash is a join key; ids and text keys are compared on top, so that rows stay dealt by the hash.
    same_text = keyed["__text_key"] == chosen["__chosen_key"]
    alike = F.coalesce((keyed[doc_id] == chosen["__chosen_id"]) & same_text,
                       keyed[doc_id].isNull() & chosen["__chosen_id"].isNull() & same_text)
    kept = keyed.join(chosen, (keyed["__row_key"] == chosen["__chosen_row"]) & alike, "left_semi")
    if once:
        kept = kept.dropDuplicates(["__row_key", doc_id, text])
    return kept.drop("__text_key", "__row_key")
