"""Exact deduplication by deterministic block naming.

The normalised text (no blanks) of a document is cut into blocks of ``block_bytes``. Equal blocks get
the same integer name and different blocks different ones: the different blocks are sorted and
numbered. Then adjacent names are paired, and the different pairs are sorted and numbered in turn,
until every document has one name. A document that reaches its one name in round ``r`` has identity
``(r, name)``: two documents have the same identity exactly when they have the same blocks, so no two
texts can collide. Only DataFrame operations are used.

**What moves.** The bytes of the blocks move once, to find the different ones; copies are combined
before that shuffle. Everything else is joined and sorted by two 64-bit hashes of a block. That these
tell the blocks apart is not assumed but counted; should two different blocks ever share both, the
first round is done on the bytes themselves instead. Each round has at most half the rows of the
previous one, and documents with one name have left.

**Skew.** A block or pair that very many documents share is one row per task in the aggregates; the
joins that give the names back are inner joins, which Spark splits.

Defined cases: a null text counts as empty and all empty texts are equal; equal rows are members of
one group, of which exactly one stays; of members with equal length and id (or null ids, which come
last) any one stays; an empty table gives an empty table; only the id and the text are read from the
table, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import GAP, content_keys, pick, text_of
from tallyproof.session import delete_path, number_rows, stored

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, text_col: str, block_bytes: int, *carried: Column) -> DataFrame:
    """A row for each block of the normalised text, and one for an empty text: ``carried``, ``pos``,
    ``n`` (blocks of the text) and the bytes ``block``."""
    texts = docs.select(*carried, F.regexp_replace(text_of(text_col), GAP, "").cast("binary").alias("_bytes"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block_bytes)).cast("int")
    texts = texts.withColumn("n", n)
    cut = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    block = F.substring(F.col("_bytes"), F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    return cut.select(*[c for c in cut.columns if c != "_bytes"], block.alias("block"))


def _hashes(block: str) -> list[Column]:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit("second"), block).alias("h2")]


def _named(rows: DataFrame, different: DataFrame, keys: list[str], made: list[str]) -> DataFrame:
    """``rows`` with the position of their ``keys`` among the sorted ``different`` ones as ``name``."""
    numbered = number_rows(different.select(*keys), *keys, name="name", made=made)
    return stored(rows.join(numbered, keys).select("row", "pos", "n", "name"), "round", made)


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hashes=_hashes,
) -> DataFrame:
    """A row per row of ``docs``: ``row``, content keys, ``n_chars`` (code points of the whole
    text), ``text_sha256`` of the normalised text, and the identity ``(round, name)``."""
    made: list[str] = []
    text = text_of(text_col)
    facts = ["_k_id", "_k_a", "_k_b", "n_chars", "text_sha256"]
    whole = docs.select(
        *content_keys(id_col, text_col),
        F.char_length(text).cast("long").alias("n_chars"),
        F.sha2(F.regexp_replace(text, GAP, "").cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
        text.alias("_text"),
    )
    cut = _blocks(whole, "_text", block_bytes, F.col("row"), *map(F.col, facts))
    facts_once = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in facts]
    blocks = stored(cut.select("row", "pos", "n", *facts_once, *hashes("block")), "blocks")

    different = _blocks(docs, text_col, block_bytes).select("block").distinct()
    hashed = stored(different.select(*hashes("block")).groupBy("h1", "h2").agg(F.count("*").alias("blocks")), "hashes", made)
    if hashed.filter("blocks > 1").isEmpty():
        names = _named(blocks, hashed, ["h1", "h2"], made)
    else:  # different blocks share their hashes: name the bytes themselves
        blocks = stored(cut.select("row", "pos", "n", *facts_once, "block"), "blocks")
        names = _named(blocks, blocks.select("block").distinct(), ["block"], made)

    rounds = max((blocks.agg(F.max("n")).first()[0] or 1) - 1, 0).bit_length()
    finished = []
    for number in range(rounds + 1):
        finished.append(names.filter("n = 1").select("row", F.lit(number).alias("round"), "name"))
        if number < rounds:
            left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
            right = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
            pairs = (
                names.filter("n > 1")
                .groupBy("row", F.expr("cast(pos div 2 as int)").alias("pos"), F.expr("cast((n + 1) div 2 as int)").alias("n"))
                .agg(left.alias("left"), F.coalesce(right, F.lit(0)).alias("right"))
            )
            pairs = stored(pairs, "pairs", made)
            names = _named(pairs, pairs.select("left", "right").distinct(), ["left", "right"], made)
    identity = finished[0]
    for part in finished[1:]:
        identity = identity.unionByName(part)
    result = stored(blocks.filter("pos = 0").select("row", *facts).join(identity, "row"), "identities")
    for path in made:
        delete_path(docs.sparkSession, path)
    return result


def groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row per row of ``docs``: its content keys, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``. Of equal texts the row with the most code points, then the smallest id, stays."""
    rows = identities(docs, id_col, text_col, block_bytes)
    best = F.struct(-F.col("n_chars"), F.col("_k_id").isNull(), F.col("_k_id"), F.col("row"))
    groups = rows.groupBy("round", "name").agg(
        F.min(best).alias("_best"), F.count("*").alias("group_size")
    )
    groups = groups.select(
        "round", "name", "group_size", F.col("_best._k_id").alias("keep_id"), F.col("_best.row").alias("_kept_row")
    )
    groups = stored(groups, "groups")  # apart from the aggregate, the join can be split
    return rows.join(groups, ["round", "name"]).select(
        "_k_id", "_k_a", "_k_b", "keep_id", "group_size", (F.col("row") == F.col("_kept_row")).alias("kept"), "text_sha256"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The whole row that stays of each group of equal texts."""
    rows = groups(docs, id_col, text_col)
    chosen = rows.groupBy("_k_id", "_k_a", "_k_b").agg(F.count("*").alias("_k_n"), F.max("kept").alias("kept"))
    return pick(docs, stored(chosen.filter("kept").drop("kept"), "chosen"), id_col, text_col)
