"""Sharding by a k-d tree over document metadata; law: near-equal bytes.

Every node of a level is split at the byte-weighted median of its widest
dimension, widths measured on the scale of the whole table, until the leaves
reach the target.  Medians are found exactly and together for all nodes of a
level by a radix descent: bytes are summed by (node, 16-bit digit of the key), a
running sum picks the digit that holds half of the node's bytes, and the next
pass looks only inside it.  Equal values of a dimension are cut by a hash of the
row and of its number among equal rows, so a value, or a row, that holds a third
of all rows is split too.

Scale.  Texts are read once, to measure them; all later passes run on a narrow
table of about fifty bytes a row, written to the shared folder at each level.
Sums combine on the map side; a pass shuffles at most 65,536 rows per node and
map task.  Slots are numbered in evenly dealt buckets whose sizes give offsets.

Defined results.  A null text has size 1 (no bytes plus 1) and crc32 0.  Null
dimension values sort before all others.  Repeated rows are numbered and spread like
others.  An empty table gives no rows.  Sizes of shards differ by few documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.placing import place
from tessella.llm.registry import query, table
from tessella.session import materialize

DIGITS = ((46, 16), (30, 16), (15, 15), (0, 15))  # shift and width of the parts of a 62-bit key
TOP = (1 << 31) - 1
BUCKET_ROWS = 20_000


def _scaled(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """Dimensions on the common scale 0 .. TOP, nulls at 0."""
    names = list(dims)
    wide = docs.withColumns({f"d{i}": dims[n].cast("double") for i, n in enumerate(names)})
    lows = [F.min(f"d{i}").alias(f"lo{i}") for i in range(len(names))]
    highs = [F.max(f"d{i}").alias(f"hi{i}") for i in range(len(names))]
    got = wide.agg(*lows, *highs).first()

    def scale(i: int) -> Column:
        lo, hi = got[f"lo{i}"], got[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0)
        return F.coalesce(F.floor((F.col(f"d{i}") - lo) * (TOP / (hi - lo))), F.lit(0))

    return wide.select("doc_id", "size", "text_crc32", "tie", *[F.least(scale(i), F.lit(TOP)).cast("long").alias(f"q{i}") for i in range(len(names))])


def _split(meta: DataFrame, dims: int) -> DataFrame:
    """(node, dim, cut): keys up to the cut go left."""
    spread = [F.max(f"q{i}") - F.min(f"q{i}") for i in range(dims)]
    sizes = meta.groupBy("node").agg(F.sum("size").alias("total"), F.array(*spread).alias("spread"))
    state = sizes.select(
        "node", "total", (F.array_position("spread", F.array_max("spread")) - 1).cast("int").alias("dim"),
        F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("below"),
    )
    for shift, width in DIGITS:
        state = materialize(state, "kd-state")
        inside = meta.join(state.select("node", "total", "dim", "cut", "below"), "node").withColumn("key", _key(dims))
        if shift + width < 62:
            inside = inside.where(F.shiftright("key", shift + width) == F.shiftright("cut", shift + width))
        digit = F.shiftright("key", shift).bitwiseAND((1 << width) - 1)
        sums = inside.groupBy("node", "total", "dim", "cut", "below", digit.alias("digit")).agg(F.sum("size").alias("bytes"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit")) + F.col("below")
        reached = sums.withColumn("upto", upto).where(2 * F.col("upto") >= F.col("total"))
        state = reached.groupBy("node", "total", "dim", "cut").agg(
            F.min(F.struct("digit", (F.col("upto") - F.col("bytes")).alias("below"), "upto")).alias("s")
        ).select("node", "total", "dim", F.col("cut").bitwiseOR(F.shiftleft("s.digit", shift)).alias("cut"), "s.below", "s.upto")
    # the row on the cut goes to the side that is then nearer to half
    over = F.col("upto") + F.col("below") > F.col("total")
    return state.select("node", "dim", (F.col("cut") - over.cast("long")).alias("cut"))


def _key(dims: int) -> Column:
    value = F.element_at(F.array(*[F.col(f"q{i}") for i in range(dims)]), F.col("dim") + 1)
    return F.shiftleft(value, 31).bitwiseOR(F.col("tie"))


def assign(docs: DataFrame, dims: dict[str, Column], shards: int | None = None, target_bytes: int | None = None,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``shards`` (a power of two) or ``target_bytes`` sets the depth of the tree.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    measured = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        *[c.alias(f"in{i}") for i, c in enumerate(dims.values())],
    )
    row = ["doc_id", "text_crc32", "size"]
    measured = place(materialize(measured, "kd-measured"), row, [], idx="number", size="copies")
    tie = F.shiftrightunsigned(F.xxhash64(*row, "number"), 33)
    measured = materialize(measured.withColumn("tie", tie), "kd-meta")
    inputs = {n: F.col(f"in{i}") for i, n in enumerate(dims)}
    # written, as a join on a constant root would have no key
    meta = materialize(_scaled(measured, inputs).withColumn("node", F.lit(0).cast("long")), "kd-meta")
    rows, total = meta.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = 1 << max(0, math.ceil(math.log2(max(1.0, total / target_bytes))))
    if shards & (shards - 1):
        raise ValueError("a binary tree has a power of two of leaves")
    for _ in range(shards.bit_length() - 1):
        cuts = materialize(_split(meta, len(dims)), "kd-cuts")
        right = (_key(len(dims)) > F.col("cut")).cast("long")
        meta = materialize(
            meta.join(cuts, "node").withColumn("node", 2 * F.col("node") + right).drop("dim", "cut"), "kd-meta"
        )
    return _numbered(meta, max(1, rows // (shards * BUCKET_ROWS)))


def _numbered(meta: DataFrame, buckets: int) -> DataFrame:
    dealt = meta.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)))
    counts = dealt.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("node", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("here", here).join(offsets, ["node", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").cast("int").alias("shard"),
        (F.col("offset") + F.col("here") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def document_dims() -> dict[str, Column]:
    """Metadata of documents: place in the collection, length, language, source."""
    return {
        "doc_id": F.col("doc_id"),
        "length": F.log2(1 + F.octet_length(F.coalesce(F.col("text"), F.lit("")))),
        "lang": F.pmod(F.xxhash64("lang"), F.lit(1 << 20)),
        "source": F.pmod(F.xxhash64("source"), F.lit(1 << 20)),
    }


@query("op3_kd_shards")
def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near-equal bytes."""
    return assign(table(spark, sf_dir, "documents"), document_dims(), shards=16)
