"""MinHash near-duplicates: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges, links confirmed on full sets.

Documents with equal shingle sets form a class; only one document of a class is
hashed further.  One permutation of the shingles fills ``bins`` bins with their
smallest hash; an empty bin takes the value of the first filled bin of its own
random probe sequence (optimal densification).  Groups of ``rows`` bins are the
bands.  In each bucket every member is compared with the smallest member only (a
star), so candidates are linear in the bucket.  Confirmed links are joined into
components.  Where a bucket then still holds several components, ``resolved``
compares exactly what could still link across them, in blocks.  Nothing is
capped; two sets of similarity s >= 0.75 share no bucket with probability
(1 - s^4)^32, at most 6e-6, where their bins are filled apart.  In a set of a few
shingles bins copy each other: of pairs of 3 and 4 shingles about 1e-4 are missed, of
6 and more none was in 20,000.

Scale.  Signatures (32 longs) are shuffled, not shingles; full sets are made
again only for documents that share a bucket.  Copies collapse before anything
else is shuffled, with map-side combine.  Joins on bucket and document keys are
ordinary equi-joins, split at run time where skewed.

Defined results.  A null or empty text has no shingles, links with nothing and
is kept.  Texts of fewer than five words are one shingle.  Rows with the same
doc_id count as one document.  A null doc_id has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.registry import query, table, unused
from tessella.llm.vectors import batch_word_hashes, chunks, mix, shingle_set, texts_of
from tessella.session import materialize

BINS, ROWS, PROBES, SHINGLE, PERCENT = 128, 4, 64, 5, 75
BLOCK_SHINGLES = 1 << 19
_U = np.uint64
_PROBE = (mix(np.arange(BINS * PROBES, dtype=np.uint64) + _U(977)) >> _U(57)).astype(np.int64).reshape(BINS, PROBES)
_SALT = mix(np.arange(BINS, dtype=np.uint64) + _U(7919)) | _U(1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << _U(57))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bin minima of a sorted set (bin: the seven upper bits), densified."""
    first = np.searchsorted(shingles, _EDGES)
    last = np.append(first[1:], len(shingles))
    filled = first < last
    source = np.arange(BINS)
    if not filled.all():
        hit = filled[_PROBE]
        probe = _PROBE[source, hit.argmax(1)]
        missed = ~hit.any(1)
        if missed.any():  # every probe met an empty bin: walk on to the next filled one
            where = np.flatnonzero(filled)
            probe[missed] = where[np.searchsorted(where, probe[missed]) % len(where)]
        source = np.where(filled, source, probe)
    return shingles[first[source]]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key per band; the salt keeps bands apart."""
    return mix((mix(sig ^ _SALT) * _SALT).reshape(-1, ROWS).sum(1, dtype=np.uint64)).view(np.int64)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    words, at = batch_word_hashes(texts_of(batch.column("text")))
    for i in range(batch.num_rows):
        yield shingle_set(words[at[i] : at[i + 1]], SHINGLE)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        sizes, prints, keys = [], [], []
        for s in _sets(b):
            sizes.append(len(s))
            if len(s):
                prints.append(
                    int(s.sum(dtype=np.uint64)).to_bytes(8, "little")
                    + int(mix(s * _U(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)).to_bytes(8, "little")
                )
                keys.append(band_keys(signature(s)))
            else:
                prints.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "print", "keys"],
        )


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [b.column("u"), pa.array([s.tobytes() for s in _sets(b)], pa.binary())], ["u", "shingles"]
        )


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("su"), b.column("sv")):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            if 100 * len(p) < PERCENT * len(q):
                ok.append(False)
                continue
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (key, block, part) at a time, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy() for c in ("key", "block", "part")], 1)
        change = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
            here = tuple(ids[lo])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each query of a block with the block's members of other components."""
    for rows in _groups(batches):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles").combine_chunks()]
        query = rows.column("query").to_numpy(zero_copy_only=False)
        component, node = rows.column("component").to_numpy(), rows.column("u").to_numpy()
        inside = np.flatnonzero(~query)
        if not len(inside):
            continue
        sizes = np.array([len(sets[i]) for i in inside])
        known, at = np.unique(np.concatenate([sets[i] for i in inside]), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        found = []
        for q in np.flatnonzero(query):
            place = np.minimum(np.searchsorted(known, sets[q]), len(known) - 1)
            flag = np.zeros(len(known), np.int32)
            flag[place[known[place] == sets[q]]] = 1
            both = np.add.reduceat(flag[at], begin)
            near = (100 * both >= PERCENT * (sizes + len(sets[q]) - both)) & (component[inside] != component[q])
            found += [(max(node[q], node[m]), min(node[q], node[m])) for m in inside[near]]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], rows.schema.field("u").type), pa.array([f[1] for f in found], rows.schema.field("u").type)], ["u", "v"])


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets with several components: their largest one and their shingles."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.min("n").alias("least"))
    return (
        parts.groupBy("key")
        .agg(
            F.max(F.struct("n", "component"))["component"].alias("top"), F.sum("n").alias("inside"),
            (F.sum("n") - F.max("n")).alias("outside"), F.min("least").alias("least"), F.count("*").alias("parts"),
        )
        .where("parts > 1")
        .drop("parts")
    )


def resolved(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that meet in a bucket: exact, whatever its size.

    ``placed`` has (key, u, n, component), ``sets`` (u, n, shingles).  For sets x
    and y the similarity needs |x & y| >= 3/7 (|x| + |y|), and x shares only
    shingles that some other set has; documents with too few of those cannot link
    and drop out.  In what remains, all documents outside a bucket's largest
    component are queries against all its members, in blocks of bounded size.
    """
    rest = materialize(placed.join(materialize(_mixed(placed), "near-keys"), "key"), "near-mixed")
    own = rest.select("u").distinct().join(sets, "u")
    tokens = own.select("u", F.explode(F.expr("transform(sequence(1, length(shingles) - 7, 8), i -> hash(substring(shingles, i, 8)))")).alias("t"))
    alone = tokens.groupBy("t").agg(F.min("u").alias("u"), F.max("u").alias("last")).where("u = last").groupBy("u").agg(F.count("*").alias("alone"))
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    partner = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
    able = rest.join(alone, "u", "left").where(7 * shared >= 3 * (F.col("n") + partner)).select("key", "u", "n", "component")
    able = materialize(able, "near-able")
    work = able.join(materialize(_mixed(able), "near-keys"), "key")
    blocks = F.ceil(F.col("inside") / BLOCK_SHINGLES).cast("int")
    parts = F.ceil(F.col("outside") / BLOCK_SHINGLES).cast("int")
    spread = F.xxhash64("u")
    inside = work.select(
        "key", "u", "component", F.lit(False).alias("query"), F.pmod(spread, blocks).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
    )
    queries = work.where("component != top").select(
        "key", "u", "component", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        F.pmod(spread, parts).cast("int").alias("part"),
    )
    t = sets.schema["u"].dataType.simpleString()
    return (
        inside.unionByName(queries)
        .join(sets.select("u", "shingles"), "u")
        .repartition("key", "block", "part")
        .sortWithinPartitions("key", "block", "part")
        .mapInArrow(_searched, f"u {t}, v {t}")
        .distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = materialize(
        docs.mapInArrow(_sign, f"doc_id {id_type}, n_shingles bigint, print binary, keys array<bigint>"), "near-signs"
    )
    real = signed.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(
        real.groupBy("print").agg(
            F.min("doc_id").alias("u"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")
        ),
        "near-classes",
    )
    members = classes.select("u", "n", F.explode("keys").alias("key"))
    centres = (
        members.groupBy("key")
        .agg(F.min("u").alias("v"), F.max("u").alias("last"))
        .where("v < last")
        .select("key", "v")
    )
    # written: a join of two exchanges is split at run time where a bucket is hot
    centres = materialize(centres, "near-centres")
    inside = materialize(members.join(centres, "key"), "near-buckets")
    nodes = inside.select("u").distinct()
    texts = docs.withColumnRenamed("doc_id", "u").join(nodes, "u", "left_semi").dropDuplicates(["u"])
    sets = materialize(texts.mapInArrow(_full, f"u {id_type}, shingles binary"), "near-sets")

    star = inside.where("u != v").select("u", "v").distinct()
    left, right = sets.withColumnRenamed("shingles", "su"), sets.select(F.col("u").alias("v"), F.col("shingles").alias("sv"))
    links = star.join(right, "v").join(left, "u").mapInArrow(_common, f"u {id_type}, v {id_type}")
    links = materialize(links, "near-links")
    comp = materialize(connected_components(links), "near-components")

    placed = inside.select("key", "u", "n").join(comp.withColumnRenamed("node", "u"), "u", "left")
    placed = placed.select("key", "u", "n", F.coalesce("component", "u").alias("component"))
    more = materialize(resolved(placed, sets), "near-more")
    comp = connected_components(links.unionByName(more))

    of_class = classes.join(comp.withColumnRenamed("node", "u"), "u", "left").select(
        "print", F.coalesce("component", "u").alias("component")
    )
    out = signed.select("doc_id", "n_shingles", "print").join(of_class, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per component: its smallest doc_id, and of rows with
    equal doc_id the one with the smallest text.  Rows without doc_id stay.

    Ids to drop and ids that repeat are found in narrow tables and written as one
    list, whose size decides whether texts are shuffled for it or not; texts
    meet it in one join.
    """
    name, row = unused(docs, "dropped_id"), unused(docs, "row_of_id")
    gone = near_duplicates(docs, doc_id, text).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "near-gone")
    twice = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias(name)).agg(F.count("*").alias("n"))
    twice = materialize(twice.where("n > 1").select(name), "near-repeated")
    once = docs.join(gone.unionByName(twice), F.col(doc_id) == F.col(name), "left_anti")
    order = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_first()))
    again = materialize(twice.join(gone, name, "left_anti"), "near-repeated")
    first = docs.join(again, F.col(doc_id) == F.col(name), "left_semi").withColumn(row, order).where(F.col(row) == 1)
    return once.unionByName(first.drop(row))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op10_minhash_near_dedup", SQL)
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
