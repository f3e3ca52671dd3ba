"""Merkle manifest of a dataset: every few levels stored, the rest made again.

Rows are leaves of one tree per group, in order; runs of eight neighbours are
hashed into a node until one is left, and the groups' roots are the leaves of a
last tree.  Only every third level is written, as rows that hold the up to 512
nodes below one node of the next stored level, an aligned subtree.  Going up,
such a row is folded to its top.  Going down, it meets the path of its top,
makes its missing interior nodes again, emits the siblings on the way to each of
its nodes and forgets the interior.

Scale.  Texts are read once and leave only digests.  Places within a group come
from ranges (see ``placing``), so a hot group is spread.  A level shuffles one
digest a node and is a 512th of the one below; paths meet subtrees, not
leaves, so no proof is shuffled.  What one row holds does not grow with the data.

Defined results.  A null field hashes as ``-``; null groups are a group, first.
Rows of equal order stand by their digests; equal rows are leaves of their own,
each with its own place.  A null order comes first.  An empty table has no leaf
and no root.  Further columns do not count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.placing import place
from tessella.llm.registry import let, query, table
from tessella.session import materialize

ARITY, STRIDE = 8, 3
BLOCK, BITS = ARITY**STRIDE, 3 * STRIDE
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:array<string>,right:array<string>>>"


def digest(parts: Column) -> Column:
    """H of an array of strings."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in bytes."""
    written = []
    for f in fields:
        s = f.cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*written), 256)


def _up(nodes: Column) -> Column:
    """One level higher: a node for every run of neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(F.slice(nodes, i * ARITY + 1, ARITY)))


def _folds(size: Column) -> Column:
    """Levels from a subtree's nodes to its top, by the nodes in its whole level."""
    out = F.lit(0)
    for k in range(STRIDE):
        out = F.when(size > ARITY**k, k + 1).otherwise(out)
    return out


@dataclass
class Level:
    """A stored level: rows (tree, block, size, nodes) of aligned subtrees."""

    blocks: DataFrame

    def tops(self) -> DataFrame:
        """tree, idx, size and hash of the next stored level's nodes."""

        def top(nodes: Column) -> Column:
            levels = [nodes]
            for _ in range(STRIDE):
                levels.append(_up(levels[-1]))
            out = levels[0]
            for k in range(STRIDE):
                out = F.when(F.col("folds") > k, levels[k + 1]).otherwise(out)
            return out[0]

        rows = self.blocks.withColumn("folds", _folds(F.col("size")))
        return rows.select(
            "tree",
            F.col("block").alias("idx"),
            F.shiftright(F.col("size") + BLOCK - 1, BITS).alias("size"),
            let(F.col("nodes.hash"), top).alias("hash"),
        )

    def paths(self, above: DataFrame) -> DataFrame:
        """Every node of this level with its path, given those of the next stored
        level's nodes (``tree``, ``idx``, ``path`` and what else they carry)."""
        carried = [c for c in above.columns if c not in ("tree", "idx", "path")]
        above = above.select(F.col("tree").alias("tree_"), F.col("idx").alias("top"), F.col("path").alias("upper"), *carried)
        rows = self.blocks.join(above, F.col("tree").eqNullSafe(F.col("tree_")) & (F.col("block") == F.col("top")))
        rows = rows.withColumn("folds", _folds(F.col("size")))

        def step(nodes: Column, at: Column, k: int) -> Column:
            """Siblings of a node's ancestor k levels up."""
            at = F.floor(at / ARITY**k).cast("int")
            start = at - at % ARITY
            return F.struct(F.slice(nodes, start + 1, at - start).alias("left"), F.slice(nodes, at + 2, start + ARITY - 1 - at).alias("right"))

        def own(levels: Column) -> Column:
            def path(node: Column) -> Column:
                at = (node["idx"] % BLOCK).cast("int")
                steps = [F.when(F.col("folds") > k, F.array(step(levels[k], at, k))).otherwise(F.array().cast(PATH)) for k in range(STRIDE)]
                return F.struct(node.alias("node"), F.concat(*steps).alias("steps"))

            return F.transform(F.col("nodes"), path)

        def interior(nodes: Column, k: int) -> Column:
            if k == STRIDE:
                return nodes
            return let(_up(nodes[k - 1]), lambda up: interior(F.concat(nodes, F.array(up)), k + 1))

        levels = interior(F.array(F.col("nodes.hash")), 1)
        found = rows.select("tree", "upper", *carried, F.inline(let(levels, own)))
        fields = [f.name for f in self.blocks.schema["nodes"].dataType.elementType.fields]
        return found.select("tree", *[F.col("node")[f].alias(f) for f in fields], F.concat("steps", "upper").alias("path"), *carried)


def _stored(nodes: DataFrame, name: str) -> Level:
    """Write nodes (tree, idx, size, hash, ...) as aligned subtrees."""
    rest = [c for c in nodes.columns if c not in ("tree", "size")]
    blocks = (
        nodes.groupBy("tree", F.shiftright("idx", BITS).alias("block"))
        .agg(F.max("size").alias("size"), F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"])).alias("nodes"))
        .withColumn("nodes", F.array_sort("nodes"))
    )
    return Level(materialize(blocks, name))


def _grown(nodes: DataFrame, name: str) -> tuple[list[Level], DataFrame]:
    """The stored levels over ``nodes``, and each tree's root."""
    levels = [_stored(nodes, f"{name}-0")]
    most = levels[0].blocks.agg(F.max("size")).first()[0] or 1
    while most > BLOCK:
        levels.append(_stored(levels[-1].tops(), f"{name}-{len(levels)}"))
        most = -(-most // BLOCK)
    return levels, levels[-1].tops()


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over them."""

    levels: list[Level]
    over: list[Level]
    roots: DataFrame

    def proofs(self) -> DataFrame:
        """Per leaf: tree, idx, hash, what it carries, its path from the leaf to
        the root (siblings left and right of each step), subroot and root."""
        nodes = self.roots.select("tree", "idx", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
        for level in reversed(self.over):
            nodes = level.paths(nodes).drop("hash") if level is not self.over[0] else level.paths(nodes)
        nodes = nodes.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("hash").alias("subroot"), "root")
        for level in reversed(self.levels):
            nodes = level.paths(nodes).drop("hash") if level is not self.levels[0] else level.paths(nodes)
        return nodes


def build(rows: DataFrame, group: str = "lang", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, **carry: Column) -> Manifest:
    """The manifest of ``rows``; columns named in ``carry`` go with the leaves."""
    leaves = rows.select(
        F.col(group).alias("tree"), F.col(order).alias("id"), leaf([F.col(c) for c in columns]).alias("hash"), *[v.alias(k) for k, v in carry.items()]
    )
    leaves = materialize(leaves, "merkle-leaves")  # ranges are sampled: texts are read once
    levels, tops = _grown(place(leaves, ["tree"], ["id", "hash"]), "merkle")
    keys = tops.select(F.lit(0).alias("tree"), F.col("tree").alias("key"), "hash")
    over, roots = _grown(place(keys, ["tree"], ["key"]), "merkle-over")
    return Manifest(levels, over, roots)


def proof_digest(path: Column) -> Column:
    """H of all siblings on a path."""
    return digest(F.flatten(F.transform(path, lambda p: F.concat(p["left"], p["right"]))))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, p: digest(F.concat(p["left"], F.array(h), p["right"])))


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


CRC32 = """list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""


def crc_sql(value: str) -> str:
    """crc32 of an integer's decimal digits, with ``CRC32`` as a column in reach."""
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({value} AS VARCHAR), ''),"
        " lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(crc_table[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )


def _leaf_sql(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC32}),
leaves AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc_sql("doc_id")} % 3 = 0
              THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf_sql("text")} END AS start,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i
  FROM documents, crc),
grown AS (
  SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
  FROM grown WHERE n > 1 GROUP BY lang, level, i // 8),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM grown WHERE n = 1),
over_groups AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
  FROM over_groups WHERE n > 1 GROUP BY level, i // 8),
top AS (SELECT h AS root FROM over_groups WHERE n = 1),
nodes AS (
  SELECT lang, false AS above, level, i, h, n FROM grown
  UNION ALL
  SELECT NULL, true, level, i, h, n FROM over_groups),
runs AS (
  SELECT lang, above, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY lang, above, level, i // 8),
depths AS (SELECT lang, max(level) AS depth FROM grown GROUP BY lang),
walk AS (
  SELECT l.doc_id, l.lang, l.i, 0 AS level, false AS above, l.start AS h, '' AS siblings FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.lang,
         CASE WHEN r.run IS NULL THEN s.i ELSE r.run END,
         CASE WHEN r.run IS NULL THEN 0 ELSE w.level + 1 END,
         w.above OR r.run IS NULL,
         CASE WHEN r.run IS NULL THEN w.h ELSE
           sha256(array_to_string(list_concat(r.hs[1:w.i % 8], [w.h], r.hs[w.i % 8 + 2:]), '')) END,
         CASE WHEN r.run IS NULL THEN w.siblings ELSE
           w.siblings || array_to_string(list_concat(r.hs[1:w.i % 8], r.hs[w.i % 8 + 2:]), '') END
  FROM walk w
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  LEFT JOIN runs r ON r.above = w.above AND r.level = w.level AND r.run = w.i // 8 AND (w.above OR r.lang IS NOT DISTINCT FROM w.lang)
  WHERE r.run IS NOT NULL OR NOT w.above),
ends AS (
  SELECT doc_id, h, siblings FROM walk WHERE above
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(e.siblings) AS proof_sha256, e.h AS folded_root, e.h = t.root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ends e USING (doc_id), top t
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked with some texts tampered with."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    seen = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    p = build(docs, seen=seen).proofs()
    p = p.withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return p.select(
        F.col("id").alias("doc_id"),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
