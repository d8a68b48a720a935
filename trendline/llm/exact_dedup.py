"""Exact duplicates by progressive refinement, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendline.llm.common import ascii_lower
from trendline.workspace import written_once

Digest = Callable[[Column], Column]

HEAD_CHARACTERS = 64
BYTES, HEAD, FULL, ROW, SUSPECT = "_bytes", "_head", "_full", "_row", "_suspect"


def normalised(text: Column) -> Column:
    """NULL as empty; A-Z in lower case, which leaves the number of bytes as it is."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def suspects(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of documents that share length and beginning with another one.

    First the lengths that occur more than once, then, among those, the hash of
    the first 64 characters. Only these short signatures are stored and moved.
    What occurs more than once is stored before it is joined: a join of two plain
    shuffles is one that Spark can split where a key is hot.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    signatures = written_once(
        docs.select(
            F.col(key).alias("_key"),
            F.octet_length(content).alias(BYTES),
            F.xxhash64(normalised(F.substring(content, 1, HEAD_CHARACTERS))).alias(HEAD),
        ),
        "signatures",
    )

    def repeated(rows: DataFrame, *by: str) -> DataFrame:
        counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
        return written_once(counts.filter("_n > 1").select(*by), "repeated")

    same_length = signatures.join(repeated(signatures, BYTES), BYTES, "left_semi")
    heads = repeated(same_length, BYTES, HEAD)
    return signatures.join(heads, [BYTES, HEAD], "left_semi").select("_key").distinct()


def _marked(
    docs: DataFrame, key: str, text: str, digests: Mapping[str, Digest] | None = None
) -> DataFrame:
    """The documents with a hash of the whole text where one is needed, stored once.

    With ``digests``, these stand in place of the documents' own columns. The
    stored row number tells rows apart that agree in everything.
    """
    if digests is None:
        content = [F.struct(*[docs[name] for name in docs.columns]).alias("_doc")]
    else:
        content = [digest(docs[text]).alias(name) for name, digest in digests.items()]
    found = suspects(docs, key, text).select("_key", F.lit(True).alias(SUSPECT))
    whole = docs.select(docs[key].alias("_id"), docs[text].alias("_text"), *content)
    joined = whole.join(found, whole["_id"].eqNullSafe(found["_key"]), "left")
    marked = joined.select(
        *([] if digests is None else [whole[name] for name in digests]),
        *([whole["_doc"]] if digests is None else []),
        whole["_id"],
        F.when(found[SUSPECT], F.sha2(normalised(whole["_text"]), 256)).alias(FULL),
        F.monotonically_increasing_id().alias(ROW),
    )
    return written_once(marked, "marked")


def _classes(marked: DataFrame) -> DataFrame:
    """For each whole text that occurs more than once: its size and the row that stays; stored."""
    rows = marked.filter(F.col(FULL).isNotNull())
    sizes = rows.groupBy(FULL).agg(
        F.count("*").alias("_n"), F.max(F.struct("_id", ROW)).alias("_keep")
    )
    return written_once(sizes.filter("_n > 1"), "classes")


def exact_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digests: Mapping[str, Digest] | None = None,
) -> DataFrame:
    """The class of equal texts of every document, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty.
    Documents are told apart by length, then by their first 64 characters, and only what is
    left is hashed as a whole (SHA-256). The row with the largest key stays; of rows
    that also share the key exactly one, any of them; a NULL key is the smallest. Columns: the
    key, ``keep_id``, ``group_size``, ``kept`` and the ``digests``, functions of the
    text column. Aggregations are partial before the shuffle; the
    last join has one stored row per class on one side, so Spark can split a hot class. Documents
    without a hash of the whole text are in no class and not joined.
    """
    digests = digests or {}
    marked = _marked(docs, key, text, digests)
    hashed = marked.filter(F.col(FULL).isNotNull()).join(_classes(marked), FULL, "left")
    others = marked.filter(F.col(FULL).isNull())
    joined = hashed.unionByName(others, allowMissingColumns=True)
    alone = F.col("_n").isNull()
    return joined.select(
        F.col("_id").alias(key),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("_keep")[ROW] == F.col(ROW))).alias("kept"),
        *digests,
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of equal texts, with the columns of ``docs``."""
    marked = _marked(docs, key, text)
    classes = _classes(marked)
    copies = (
        marked.filter(F.col(FULL).isNotNull())
        .select(FULL, ROW)
        .join(classes, FULL)
        .filter(F.col("_keep")[ROW] != F.col(ROW))
        .select(ROW)
    )
    return marked.join(copies, ROW, "left_anti").select("_doc.*")
