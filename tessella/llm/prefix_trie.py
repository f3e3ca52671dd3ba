"""Prefix trie of conversations, grown by bursting containers.

Turns become ids, hashes of role and text.  Conversations with the same turns
are counted and go on as one.  All start in one container under the root.  A
container that holds more than ``CONTAINER`` turn ids of unlike conversations
bursts: its head becomes a node, and what follows moves to containers by the next
turn id.  What remains is dealt to shards by head; the suffixes of a container are
sorted and swept once, the open nodes on a stack, into its nodes.  Burst heads
add up what lies below them, deepest first.

Scale.  Texts are read once and leave hashes and lengths.  Bursting moves one row
per unlike conversation and level, and only for containers still too large, so
the rounds are as many as the turns that over ``CONTAINER`` ids have in common.  Copies
are counted with partial sums.  A container swept in a task holds at most
``CONTAINER`` ids; that of a single conversation, however long, is a path and is
laid out by columns alone.  Turns are numbered by ranges (see ``placing``), so a
conversation of any length is spread.  Ids of equal conversations are joined in
pieces and hashed as a stream.  Two turns are the same if 128 bits of hash are.

Defined results.  Null roles and texts are empty.  Turns stand by turn (null
first); equal turns by their hash, so ties and repeated rows keep a fixed order.
Rows without conv_id are in no conversation.  An empty table has no node.  Further
columns do not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.merkle import CRC32, crc_sql
from tessella.llm.placing import place
from tessella.llm.registry import query, table
from tessella.session import materialize

CONTAINER = 128
#: Burst containers that may be broadcast (a hundred bytes each); beyond, the join is salted.
FEW, SALTS = 10_000, 32
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end long"
HEAD = "up1 long, up2 long"


def hashed(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, the turn's id (a, b) and the bytes of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    return rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit("second"), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Hashed turns with their place ``idx`` in the conversation."""
    return materialize(place(rows, ["conv_id"], ["turn", "a", "b"]), "trie-turns")


def _sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: its length and a digest of all its turns."""
    return turns.groupBy("c").agg(
        F.bit_xor(F.xxhash64("idx", "a")).alias("d1"),
        F.bit_xor(F.xxhash64("b", "idx")).alias("d2"),
        F.max("size").alias("length"),
        F.sum("bytes").alias("total"),
    )


def _marked(members: DataFrame, big: DataFrame, few: bool) -> DataFrame:
    """Members with ``head`` (its smallest conversation) where their container bursts."""
    heads = big.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("conv_id").alias("head"))
    same = (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))
    if few:
        return members.join(F.broadcast(heads), same, "left").drop("b1", "b2")
    salted = heads.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = members.withColumn("own", F.pmod(F.xxhash64("c"), F.lit(SALTS)).cast("int"))
    return members.join(salted, same & (F.col("own") == F.col("s")), "left").drop("b1", "b2", "s", "own")


def _burst(members: DataFrame, turns: DataFrame, container: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Burst heads and settled members (with the conversations of their
    container), level by level."""
    heads, settled, depth = [], [], 0
    while True:
        sizes = members.groupBy("k1", "k2").agg(
            F.sum(F.col("length") - depth).alias("ids"),
            F.count(F.lit(1)).alias("unlike"),
            F.min("c").alias("conv_id"),
            F.sum("w").alias("n_convs"),
            F.min(F.when(F.col("length") == depth + 1, F.col("c"))).alias("end"),
            F.min("bytes").alias("bytes"),
            F.min("up1").alias("up1"),
            F.min("up2").alias("up2"),
            F.min("up_conv").alias("up_conv"),
        )
        big = materialize(sizes.where((F.col("ids") > container) & (F.col("unlike") > 1)), "trie-heads")
        n = big.count()
        marked = _marked(members, big, n <= FEW) if n else members.withColumn("head", F.lit(None).cast("long"))
        rest = marked.where(F.col("head").isNull()).drop("head").withColumn("depth", F.lit(depth).cast("long"))
        rest = rest.withColumn("unlike", F.count(F.lit(1)).over(Window.partitionBy("k1", "k2")))
        settled.append(materialize(rest, "trie-settled"))
        if not n:
            return heads, settled
        heads.append(big)
        depth += 1
        following = turns.where(F.col("idx") == depth).select(F.col("c").alias("c_"), "a", "b", F.col("bytes").alias("more"))
        moved = marked.where(F.col("head").isNotNull()).join(following, F.col("c") == F.col("c_"))
        members = materialize(
            moved.select(
                "c", "w", "length", "total",
                F.xxhash64("k1", "a").alias("k1"), F.xxhash64("b", "k2").alias("k2"), F.col("more").alias("bytes"),
                F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("head").alias("up_conv"),
            ),
            "trie-members",
        )


def sweep(suffixes: list[tuple[tuple, int, int, list]], depth: int) -> list[list]:
    """Nodes of one container in order of opening, from sorted suffixes
    (turn ids, conversation, copies, bytes by turn) that share their first id.

    A node is [smallest conversation, depth, parent's place in the list or -1,
    conversations, children, leaves, saved, end].
    """
    nodes, stack, before = [], [], ()
    bytes_of = []

    def close(keep: int) -> None:
        while len(stack) > keep:
            at = stack.pop()
            node = nodes[at]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * bytes_of[at]
            if stack:
                up = nodes[stack[-1]]
                up[0] = min(up[0], node[0])
                up[3] += node[3]
                up[4] += 1
                up[5] += node[5]
                up[6] += node[6]

    for ids, conv, copies, sizes in suffixes:
        shared = 0
        while shared < min(len(before), len(ids)) and before[shared] == ids[shared]:
            shared += 1
        close(shared)
        for k in range(shared, len(ids)):
            nodes.append([conv, depth + k, stack[-1] if stack else -1, 0, 0, 0, 0, None])
            bytes_of.append(sizes[k])
            stack.append(len(nodes) - 1)
        last = nodes[stack[-1]]
        last[0], last[3], last[7] = min(last[0], conv), last[3] + copies, conv
        before = ids
    close(0)
    return nodes


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by container, conversation, place."""
    names = [f.split()[0] for f in f"{NODE}, {HEAD}".split(", ")]
    out: list[tuple] = []
    suffixes: list[tuple[tuple, int, int, list]] = []
    at, conv, ids, sizes, head, copies = None, None, [], [], None, 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def finish() -> None:
        if conv is not None:
            suffixes.append((tuple(ids), conv, copies, sizes))
        if suffixes:
            suffixes.sort(key=lambda s: s[0])
            depth, up1, up2, up_conv = head
            nodes = sweep(suffixes, depth)
            for n in nodes:
                top = n[2] < 0
                parent = up_conv if top else nodes[n[2]][0]
                out.append((n[0], n[1], parent, n[3], n[4], n[5], n[6], n[7], up1 if top else None, up2 if top else None))
            suffixes.clear()

    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns]):
            key, c = r[:2], r[2]
            if key != at:
                finish()
                at, conv, head = key, None, r[8:12]
                if len(out) >= 50_000:
                    yield flush()
            if c != conv:
                if conv is not None:
                    suffixes.append((tuple(ids), conv, copies, sizes))
                conv, ids, sizes, copies = c, [], [], r[7]
            ids.append((r[4], r[5]))
            sizes.append(r[6])
    finish()
    if out:
        yield flush()


def _below(turns: DataFrame, settled: DataFrame) -> DataFrame:
    """Nodes of the containers that did not burst; heads carry their upper head."""
    s = settled.select(F.col("c").alias("c_"), "depth", "unlike", "k1", "k2", "up1", "up2", "up_conv")
    rows = turns.join(s, (F.col("c") == F.col("c_")) & (F.col("idx") >= F.col("depth")))
    top, last = F.col("idx") == F.col("depth"), F.col("idx") == F.col("length") - 1
    paths = rows.where(F.col("unlike") == 1).select(
        F.col("c").alias("conv_id"),
        F.col("idx").alias("depth"),
        F.when(top, F.col("up_conv")).otherwise(F.col("c")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("bytes_before"))).alias("saved_tokens"),
        F.when(last, F.col("c")).alias("end"),
        F.when(top, F.col("up1")).alias("up1"),
        F.when(top, F.col("up2")).alias("up2"),
    )
    shared = (
        rows.where(F.col("unlike") > 1)
        .select("k1", "k2", "c", "idx", "a", "b", "bytes", "w", "depth", "up1", "up2", "up_conv")
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "c", "idx")
        .mapInArrow(_swept, f"{NODE}, {HEAD}")
    )
    return materialize(paths.unionByName(shared), "trie-nodes")


def _above(heads: list[DataFrame], below: DataFrame) -> list[DataFrame]:
    """Burst heads as nodes, from the deepest up, with what lies below them."""
    nodes: list[DataFrame] = []
    for depth in range(len(heads) - 1, -1, -1):
        kids = below.where((F.col("depth") == depth + 1) & F.col("up1").isNotNull())
        if nodes:
            kids = kids.unionByName(nodes[-1])
        kids = kids.groupBy(F.col("up1").alias("u1"), F.col("up2").alias("u2")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
        )
        found = heads[depth].join(kids, (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2")))
        nodes.append(
            materialize(
                found.select(
                    "conv_id", F.lit(depth).cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children",
                    "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), "end", "up1", "up2",
                ),
                "trie-heads",
            )
        )
    return nodes


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes ids of equal conversations, whose pieces come in order."""
    at, first, sha, done = None, None, None, ([], [])
    for batch in batches:
        for *key, _, least, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != at:
                if sha:
                    done[0].append(first)
                    done[1].append(sha.hexdigest())
                at, first, sha = key, least, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1])], ["first", "ends_sha256"])
            done = ([], [])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([sha.hexdigest()])], ["first", "ends_sha256"])


def _ends(sequences: DataFrame) -> DataFrame:
    """Per group of equal conversations its smallest and the hash of all ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = sequences.groupBy("d1", "d2", "length", F.shiftright("c", 12).alias("piece")).agg(F.min("c").alias("least"), ids.alias("ids"))
    ordered = pieces.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "length", "piece")
    return ordered.mapInArrow(_joined_ids, "first long, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, order: list[str], container: int = CONTAINER) -> DataFrame:
    """Nodes of the trie over ``turns`` (conv_id, a, b, bytes and ``order``; ties
    by a and b).

    ``conversations`` has every conv_id, also those without turns.  A node is named
    by conv_id (its smallest conversation) and depth.
    """
    zero = F.lit(0).cast("long")
    start = conversations.select(F.col("conv_id").alias("c"), F.lit(0).alias("row"), *[F.lit(None).alias(o) for o in order],
                                 zero.alias("a"), zero.alias("b"), zero.alias("bytes"))
    rows = turns.select(F.col("conv_id").alias("c"), F.lit(1).alias("row"), *order, "a", "b", "bytes")
    placed = materialize(place(start.unionByName(rows), ["c"], ["row", *order, "a", "b"], ("bytes",)), "trie-placed")
    sequences = materialize(_sequences(placed), "trie-sequences")
    unlike = materialize(
        sequences.groupBy("d1", "d2", "length").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("w"), F.min("total").alias("total")),
        "trie-unlike",
    )
    kept = unlike.select(F.col("c").alias("c_"), "w", "length", "total")
    turns = materialize(placed.join(kept, F.col("c") == F.col("c_")).drop("c_", "row", "size", *order), "trie-suffixes")
    none = F.lit(None).cast("long")
    members = unlike.select(
        "c", "w", "length", "total", zero.alias("k1"), zero.alias("k2"), zero.alias("bytes"), none.alias("up1"), none.alias("up2"), none.alias("up_conv")
    )
    members = materialize(members, "trie-members")  # else the constant keys of the root fold joins on them away
    heads, settled = _burst(members, turns, container)
    everyone = settled[0]
    for s in settled[1:]:
        everyone = everyone.unionByName(s)
    below = _below(turns, everyone)
    nodes = below
    for level in _above(heads, below):
        nodes = nodes.unionByName(level)
    ends = _ends(sequences)
    ending = nodes.where(F.col("end").isNotNull()).join(ends, F.col("end") == F.col("first")).drop("first")
    passed = nodes.where(F.col("end").isNull()).withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return ending.unionByName(passed).drop("end", "up1", "up2")


SQL = f"""
WITH crc AS (SELECT {CRC32}),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS q, {crc_sql("c")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM t), crc),
rebuilt AS (
  SELECT c, 0 AS part, i, role, text FROM ids JOIN t ON t.conv_id = q AND i < h
  UNION ALL
  SELECT c, 1, i, role, text FROM ids JOIN t ON t.conv_id = c AND i >= h),
sequences AS (
  SELECT c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, i) FILTER (WHERE part IS NOT NULL), []) AS turns
  FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c),
members AS (SELECT c, len(turns) AS n, d, turns[1:d] AS prefix FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM sequences)),
nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends
  FROM members GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, prefix)),
subtrees AS (
  SELECT k AS d, prefix[1:k] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         CAST(sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[d].text) END) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS k FROM whole) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
       sha256(coalesce(w.ends, '')) AS ends_sha256
FROM whole w JOIN subtrees s ON s.d = w.d AND s.prefix = w.prefix
LEFT JOIN nodes p ON p.d = w.d - 1 AND p.prefix = w.prefix[1:w.d - 1]
"""


def spliced(turns: DataFrame, heads: Callable[[Column], Column], every: int = 5) -> DataFrame:
    """Numbered turns, where each conversation begins with the first
    ``heads(conv_id)`` turns of the one whose id is the next lower multiple of
    ``every``, and goes on with its own turns after as many."""
    own, donor = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % every
    kept = turns.where((own == donor) | (F.col("idx") >= heads(own))).withColumn("row_", F.lit(1))
    takers = turns.where((F.col("idx") == 0) & (own != donor)).select(own.alias("taker"), donor.alias("donor"), heads(own).alias("h"))
    given = turns.where(own == donor).join(takers, (own == F.col("donor")) & (F.col("idx") < F.col("h")))
    given = given.withColumn("conv_id", F.col("taker")).drop("taker", "donor", "h").withColumn("row_", F.lit(0))
    return kept.unionByName(given).withColumnRenamed("idx", "at").drop("size")


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over all conversations, each begun by a neighbour's turns."""
    turns = numbered(hashed(table(spark, sf_dir, "conversations")))
    rebuilt = spliced(turns, lambda c: F.crc32(c.cast("string")) % 9)
    return trie(rebuilt, turns.where(F.col("idx") == 0).select("conv_id"), ["row_", "at"])
