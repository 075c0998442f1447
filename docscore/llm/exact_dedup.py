"""Exact deduplication by deterministic block naming (DataFrame functions only).

Texts are cut into fixed-size blocks. Every distinct block gets an integer: its
place in the sorted blocks of its hash partition. Adjacent names of a document
are then paired and each distinct pair is named the same way, until one name is
left. The name together with the number of blocks is equal for two documents
exactly when their texts are equal; no hash decides equality.

Texts are compared once: in the aggregation that finds the distinct blocks.
Afterwards blocks are looked up by a 64-bit hash of the block, which is only a
routing key: hashes that two distinct blocks share are found by counting, and
their blocks are looked up by content.

Names go back to their rows in joins whose other side has one row per key. That side
is written first and read from storage, not aggregated in the join's own stage: only
then does Spark split the partition of a key that a third of all rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.llm.storage import Workspace, free_name

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4096


def normalized(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _in_blocks(data: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda at: F.substring(data, at + 1, F.lit(size)))


def _routing(block: Column, bits: int) -> Column:
    return F.xxhash64(block) if bits >= 64 else F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Integer names for distinct keys: partition number, then sorted place in it."""
    return keys.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame, bits: int, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """``(route, name)`` for blocks alone on their hash, and ``(route, block, name)`` for the others."""
    named = work.write(
        _ranked(blocks.groupBy("block").agg(F.first("route").alias("route")), ["block"]).select("route", "name"), "names"
    )
    by_route = work.write(named.groupBy("route").agg(F.min("name").alias("name"), F.count("*").alias("n")), "routes")
    alone = by_route.where("n = 1").select("route", "name")
    shared = by_route.where("n > 1").select("route")
    if shared.isEmpty():
        return alone, None
    disputed = blocks.join(shared, "route", "left_semi").groupBy("route", "block").agg(F.count("*").alias("n"))
    # below zero, so that they can't meet the other names
    clash = _ranked(disputed, ["route", "block"]).select("route", "block", (-1 - F.col("name")).alias("name"))
    return alone, work.write(clash, "clashes")


def _pair_up(names: DataFrame, work: Workspace) -> DataFrame:
    """Name adjacent pairs; a row for each pair, the last of an odd number paired with nothing."""
    pairs = work.write(
        names.groupBy("row", F.shiftright("i", 1).alias("i")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("blocks").alias("blocks"),
            F.max("digest").alias("digest"),
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("right"),
            F.count("*").alias("parts"),
        ),
        "pairs",
    )
    keyed = pairs.withColumn("right", F.coalesce("right", F.lit(0)))
    named = _ranked(keyed.groupBy("left", "right", "parts").agg(F.count("*").alias("n")), ["left", "right", "parts"])
    named = work.write(named.drop("n"), "names")
    return keyed.join(named.hint("merge"), ["left", "right", "parts"]).select("row", "doc_id", "blocks", "digest", "i", "name")


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route_bits: int = 64,
    row_col: str | None = None,
    work: Workspace | None = None,
) -> DataFrame:
    """One row per input row: ``row, doc_id, digest, blocks, name``.

    Two rows have equal ``(blocks, name)`` exactly when their normalised texts are
    equal. A null text is the empty text (one empty block). ``route_bits`` narrows
    the routing hash; results do not depend on it. ``row`` is ``row_col`` or else a
    number given in reading order, so the input should then be a stored table.
    """
    work = work or Workspace(docs.sparkSession, "blocks")
    texts = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.encode(normalized(F.col(text_col)), "UTF-8").alias("data"),
    )
    blocks = texts.select(F.explode(_in_blocks(F.col("data"), block_bytes)).alias("block")).withColumn(
        "route", _routing(F.col("block"), route_bits)
    )
    alone, clash = _block_names(blocks, route_bits, work)
    cut = texts.withColumn("digest", F.sha2("data", 256)).withColumn("cut", _in_blocks(F.col("data"), block_bytes))
    if clash is None:
        # only hashes travel from here on
        cut = cut.withColumn("cut", F.transform("cut", lambda b: F.struct(_routing(b, route_bits).alias("route"))))
    else:
        cut = cut.withColumn("cut", F.transform("cut", lambda b: F.struct(_routing(b, route_bits).alias("route"), b.alias("block"))))
    cut = cut.select("row", "doc_id", "digest", F.size("cut").alias("blocks"), F.posexplode("cut").alias("i", "part"))
    placed = cut.select("row", "doc_id", F.when(F.col("i") == 0, F.col("digest")).alias("digest"), "blocks", "i", "part.*")
    keep = ["row", "doc_id", "blocks", "digest", "i", "name"]
    names = placed.join(alone.hint("merge"), "route").select(keep)
    if clash is not None:
        names = names.unionByName(placed.join(clash, ["route", "block"]).select(keep))
    names = work.write(names, "level")
    done = names.where("blocks = 1").select("row", "doc_id", "digest", "blocks", "name")
    most = names.agg(F.max("blocks")).first()[0] or 1
    rest, width = names.where("blocks > 1"), 1
    while width < most:
        before, width = rest, width * 2
        level = work.write(_pair_up(before, work), "level")
        done = done.unionByName(level.where(F.col("blocks") <= width).select("row", "doc_id", "digest", "blocks", "name"))
        rest = level.where(F.col("blocks") > width)
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Groups of equal texts, a row for each input row, dropped ones too.

    Columns ``row, doc_id, keep_id, group_size, kept, text_sha256``. Texts are equal
    when identical after lower-casing A-Z; the row with the largest id stays. Null
    text counts as empty. A null id is smaller than any other; where rows of a group
    share the largest id, exactly one of them (the first by input row) is kept. An
    empty table gives no rows; other columns of the input are never read.
    """
    work = options.pop("work", None) or Workspace(docs.sparkSession, "exact")
    mark = work.mark()
    ids = work.write(identities(docs, id_col, text_col, work=work, **options), "identities")
    work.prune(mark, ids)
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), (-F.col("row")).alias("back"))
    groups = work.write(ids.groupBy("blocks", "name").agg(F.max(first).alias("top"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups.hint("merge"), ["blocks", "name"]).select(
        "row",
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("top.back")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, without rows whose text another kept row has.

    Of equal texts (null is the empty text) the row with the largest id stays, a null
    id being smaller than any other; of rows that share it one stays. Columns of any
    name are kept. An empty table gives no rows.
    """
    work = options.pop("work", None) or Workspace(docs.sparkSession, "exact")
    # numbers depend on how files are split, so the numbered rows are written and never numbered again
    number = free_name(docs, "__row")
    marked = work.write(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    kept = exact_duplicates(marked, id_col, text_col, row_col=number, work=work, **options).where("kept").select(F.col("row").alias(number))
    return marked.join(kept, number, "left_semi").drop(number)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).drop("row")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)
"""
