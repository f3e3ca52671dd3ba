"""Byte-level BPE encoding and decoding of whole texts, long ones in chunks.

A text longer than ``CHUNK`` code points is cut into chunks that overlap on both
sides.  Chunks are pre-tokenised in parallel, each from the start of its own
slice.  A chunk owns the pre-tokens from the first boundary at or after its
start up to the first boundary at or after the next chunk's start.  Where two
neighbours name the same boundary they have resynchronised: a match depends only
on what follows its start, so from there on the later chunk's pre-tokens are
those of the whole text.  Their ids are stitched in order.  A text in which any
seam disagrees (a pre-token longer than the overlap) is encoded once more in one
piece.  Shorter texts are one chunk.  Decoding concatenates the raw bytes of ids.

Scale.  Texts of one chunk are never shuffled.  Chunks of long texts are dealt
evenly; only ids return to one row per text.  Memory follows the chunk, or the
single text when its ids are put together.

Defined results.  A null or empty text has no ids.  Repeated rows each get their
row, null ids too.  The order of rows is not defined.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import query, table
from tessella.llm.token_units import Units, kept_in_worker

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Units kept per worker and kind; they outlive the task, beside whatever runs next.
KEPT_UNITS = 60_000
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file (base64 token, rank per line), no special tokens."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _digests(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, str, str]:
    decimals = b",".join([p[1] for p in parts if p[0]])
    return (
        sum(p[0] for p in parts),
        hashlib.sha256(decimals).hexdigest(),
        hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest(),
    )


def _part(enc: tiktoken.Encoding):
    def part(unit: str) -> tuple[int, bytes, bytes]:
        ids = enc.encode_ordinary(unit)
        return len(ids), ",".join(map(str, ids)).encode(), enc.decode_bytes(ids)

    return part


def encode_whole(ranks_path: str, pattern: str):
    """mapInArrow function: (doc_id, text) to (doc_id, n_tokens, both digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(("ranks", ranks_path, pattern), lambda: Units(_part(encoding(ranks_path, pattern)), KEPT_UNITS))
        for b in batches:
            rows = [_digests(encode(t or "")) for t in (x.as_py() for x in b.column("text"))]
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def owned(slice_: str, begin: int, start: int, stop: int, total: int, pattern) -> tuple[int, int, list[str]]:
    """(first boundary >= start, first boundary >= stop, pre-tokens between) of
    the slice that begins at ``begin``; -1 where the slice shows no boundary.

    A boundary counts only if a character follows the match, as the match
    before it could otherwise go on, unless the text ends there.
    """
    lo = hi = -1
    pieces: list[str] = []
    edge = begin
    if edge >= start:
        lo = edge
    end_of_slice = begin + len(slice_)
    for m in pattern.finditer(slice_):
        if lo >= 0:
            pieces.append(m.group())
        edge = begin + m.end()
        if edge + 1 >= end_of_slice and end_of_slice < total:
            break
        if lo < 0 and edge >= start:
            lo = edge
        if edge >= stop:
            hi = edge
            break
    return lo, hi, pieces if hi >= 0 else []


def encode_chunks(ranks_path: str, pattern: str):
    """mapInArrow function over chunk rows: seams and ids of what a chunk owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, match = encoding(ranks_path, pattern), regex.compile(pattern)
        cache: dict[str, list[int]] = {}

        def ids_of(piece: str) -> list[int]:
            got = cache.get(piece)
            if got is None:
                got = enc.encode_ordinary(piece)
                if len(piece) <= 48 and len(cache) < 200_000:
                    cache[piece] = got
            return got

        for b in batches:
            seams, ids = [], []
            for r in b.select(["slice", "begin", "start", "stop", "total"]).to_pylist():
                lo, hi, pieces = owned(r["slice"], r["begin"], r["start"], r["stop"], r["total"], match)
                seams.append((lo, hi))
                ids.append(np.fromiter((i for p in pieces for i in ids_of(p)), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("sha"), b.column("total"), b.column("chunk"),
                 pa.array([s[0] for s in seams], pa.int64()), pa.array([s[1] for s in seams], pa.int64()),
                 pa.array(ids, pa.binary())],
                ["doc_id", "sha", "total", "chunk", "lo", "hi", "ids"],
            )

    return run


def digest_ids(ranks_path: str, pattern: str):
    """mapInArrow function: lists of id bytes to the digests of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            rows = []
            for parts in b.column("parts"):
                n, decimals, raw, first = 0, hashlib.sha256(), hashlib.sha256(), True
                for p in parts:
                    ids = np.frombuffer(p["ids"].as_py(), np.uint32).tolist()
                    if ids:
                        decimals.update((b"" if first else b",") + ",".join(map(str, ids)).encode())
                        raw.update(enc.decode_bytes(ids))
                        first = False
                        n += len(ids)
                rows.append((n, decimals.hexdigest(), raw.hexdigest()))
            n, ids, raw = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("sha"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())],
                ["doc_id", "sha", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS,
                     pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    length = F.char_length("text")
    whole = docs.where(length <= chunk).mapInArrow(encode_whole(ranks_path, pattern), out)

    begin = F.greatest(F.col("start") - overlap, F.lit(0))
    slices = (
        docs.where(length > chunk)
        .select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), length.alias("total"))
        .select("*", F.posexplode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(chunk))).alias("chunk", "start"))
        .select(
            "doc_id", "sha", "total", "chunk", "start", begin.alias("begin"),
            F.least(F.col("start") + chunk, "total").alias("stop"),
            F.substring("text", begin + 1, F.col("start") - begin + chunk + overlap).alias("slice"),
        )
        .repartition("sha", "chunk")
    )
    done = slices.mapInArrow(
        encode_chunks(ranks_path, pattern),
        f"doc_id {id_type}, sha string, total int, chunk int, lo bigint, hi bigint, ids binary",
    )
    # equal rows of the table meet here: one set of chunks is stitched, the rows come back by their number
    by_text = done.groupBy("doc_id", "sha", "chunk").agg(
        F.first(F.struct("lo", "hi", "total", "ids")).alias("c"), F.count("*").alias("times")
    )
    texts = by_text.groupBy("doc_id", "sha").agg(
        F.max("times").alias("times"),
        F.array_sort(F.collect_list(F.struct("chunk", "c.lo", "c.hi", "c.total", "c.ids"))).alias("parts"),
    )
    smooth = F.forall(
        F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: (x["p"]["hi"] >= 0)
        & F.when(x["i"] == 0, x["p"]["lo"] == 0).otherwise(F.get("parts", x["i"] - 1)["hi"] == x["p"]["lo"])
        & ((x["i"] < F.size("parts") - 1) | (x["p"]["hi"] == x["p"]["total"])),
    )
    texts = texts.withColumn("smooth", smooth)
    stitched = (
        texts.where("smooth")
        .select("doc_id", "sha", "parts", "times")
        .mapInArrow(_with_times(digest_ids(ranks_path, pattern)), out + ", times bigint")
    )
    rows = stitched.select(F.explode(F.sequence(F.lit(1), F.col("times"))), *[c for c in stitched.columns if c != "times"]).drop("col")
    rough = texts.where(~F.col("smooth")).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"))
    again = (
        docs.where(length > chunk)
        .join(rough, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("__sha")), "left_semi")
        .mapInArrow(encode_whole(ranks_path, pattern), out)
    )
    return whole.unionByName(rows).unionByName(again)


def _with_times(run):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in run(iter([b])):
                yield pa.RecordBatch.from_arrays(
                    [r.column("doc_id"), r.column("n_tokens"), r.column("ids_sha256"), r.column("decoded_sha256"), b.column("times")],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "times"],
                )

    return keep


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, encoded and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"))
