"""Suffix-array deduplication: remove bytes of strings that occurred before.

A byte goes if some string of ``LENGTH`` bytes covering it also starts earlier in
the corpus (smaller doc_id, or same document and earlier start).

Where equal strings meet.  Among the 32-byte pieces of a string the one with the
smallest hash marks it (a minimizer), so equal strings have equal marks.  Marks
that occur once in the corpus end there.  Of the others, a region is the run of
strings with the same mark occurrence; of equal regions all but the earliest are
repeats as a whole.  Marks with several different regions are left: the bytes of
these regions are dealt by mark and gathered into shards of bounded size, and a
suffix array with permuted common prefixes is induced for each shard: suffixes
that share LENGTH bytes are equal strings, the earliest stays.  A mark with more
than ``shard_bytes`` of different regions is not gathered: its strings meet one
by one, by 128-bit hash.

Scale.  About one mark per 35 bytes is shuffled.  Before every shuffle a task
settles what repeats within it: of equal marks, regions or strings it sends one
on, and the rest go straight to their documents.  So what a group of copies sends
to one task is bounded by the number of tasks, and reduce sides are sorted
streams.  Texts are shuffled once by document; the plan uses that exchange three
times.  No step holds more than a document, a shard or a batch.

Defined results.  A null or empty text has no bytes.  Texts shorter than LENGTH
keep all.  doc_id must be an integer; null ids come before all others, rows with
equal ids are ordered by 128 bits of content hash, and of equal rows one stays.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.placing import place
from tessella.llm.registry import query, table
from tessella.llm.suffix_arrays import common_prefixes, suffix_array
from tessella.llm.vectors import chunks, mix
from tessella.session import materialize

LENGTH, PIECE, SHARD_BYTES, BLOCK = 100, 32, 1 << 21, 1 << 22
NO_ID = -(1 << 63)
_U = np.uint64
_LOW = _U(0xFFFFFF)
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)


def _pieces(data: bytes) -> np.ndarray:
    """A 64-bit hash of every PIECE bytes (PIECE is 8 times a power of two)."""

    def stir(x: np.ndarray) -> np.ndarray:
        x = x * _B
        x ^= x >> _U(29)
        x *= _U(0x94D049BB133111EB)
        return x

    h = stir(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)))
    width = 8
    while width < PIECE:
        h = stir(h[:-width] * _A + h[width:])
        width *= 2
    return h


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by doubling."""
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def regions(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, mark, first string start, number of strings) of the regions of some
    texts, in blocks; every string of LENGTH bytes lies in exactly one region."""
    data = b"".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        block = data[at : at + BLOCK + LENGTH - 1]
        h = _pieces(block)
        low = _smallest((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), LENGTH - PIECE + 1) & _LOW
        place = low.astype(np.int64)
        of, last = owner[at : at + len(place)], owner[at + LENGTH - 1 : at + LENGTH - 1 + len(place)]
        inside = of == last  # the string does not run into the next text
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]) | (inside[1:] != inside[:-1])))
        n = np.diff(np.append(first, len(place)))
        keep = inside[first]
        first, n = first[keep], n[keep]
        yield of[first], h[place[first]].view(np.int64), first + at - begin[of[first]], n


def _fingerprints(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges of a text, none longer than a region."""
    out = np.zeros(len(start), np.uint64)
    width = (int(size.max(initial=0)) + 7) // 8
    padded = text + bytes(8 * width + 8)
    words = np.ndarray((len(text) + 8 * width,), "<u8", padded, 0, (1,))
    end = start + size
    for j in range(width):
        at = start + 8 * j
        left = np.clip(end - at, 0, 8)
        w = words[np.minimum(at, len(words) - 1)]
        keep = np.where(left == 8, _U(0xFFFFFFFFFFFFFFFF), (_U(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - _U(1))
        out = np.where(left > 0, mix((out ^ (w & keep)) * _A + left.astype(np.uint64)), out)
    return out.view(np.int64)


def _raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, change)) if len(columns[0]) else np.zeros(0, np.int64)


def _marks(known: bool):
    """Marks of texts.  What occurs once in the task goes out with its document
    (seen 1), what occurs more often as one row (seen 2); with ``known``, the
    documents of the latter instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            mark, k, tk = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(mark, kind="stable")
            mark, k, tk = mark[order], k[order], tk[order]
            first = _runs(mark)
            count = np.diff(np.append(first, len(mark)))
            if known:
                many = np.repeat(count > 1, count)
                mark, k, tk = mark[many], k[many], tk[many]
                order = np.lexsort((tk, k, mark))
                mark, k, tk = mark[order], k[order], tk[order]
                once = _runs(mark, k, tk)
                return pa.RecordBatch.from_arrays([pa.array(c[once]) for c in (mark, k, tk)], ["mark", "k", "tk"])
            many = count > 1
            columns = (mark[first], np.where(many, 0, k[first]), np.where(many, 0, tk[first]).astype(np.int32), (1 + many).astype(np.int8))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mark", "k", "tk", "seen"])

        for b in chunks(batches, "text"):
            k, tk = b.column("k").to_numpy(), b.column("tk").to_numpy()
            for of, mark, _, _ in regions(_raw(b.column("text"))):
                held.append((mark, k[of], tk[of]))
                size += len(mark)
            if size >= 1 << 21:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _streamed(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = int(_runs(*[b.column(c).to_numpy() for c in key])[-1])
        same = bool(held) and all(held[-1].column(c)[-1] == b.column(c)[0] for c in key)
        if at == 0 and same:
            held.append(b)
            continue
        if at or held:
            yield pa.Table.from_batches([*held, b.slice(0, at)])
        held = [b.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, k, tk) of marks that several tasks, or one of them twice, have seen."""
    for rows in _streamed(batches, "mark"):
        mark, seen = rows.column("mark").to_numpy(), rows.column("seen").to_numpy()
        first = _runs(mark)
        if not len(first):
            continue
        total = np.repeat(np.add.reduceat(seen.astype(np.int64), first), np.diff(np.append(first, len(mark))))
        pick = pa.array((total > 1) & (seen == 1))
        yield from rows.select(["mark", "k", "tk"]).filter(pick).combine_chunks().to_batches()


def _known_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions whose mark is among the repeated ones; equal regions of a batch go
    out once with the route of the region, the later ones with that of their text."""
    names = ("mark", "print", "k", "tk", "start", "size")
    for b in chunks(batches, "text"):
        texts, known = _raw(b.column("text")), b.column("marks")
        k, tk = b.column("k").to_numpy(), b.column("tk").to_numpy()
        data, begin = b"".join(texts), np.cumsum([0] + [len(t) for t in texts])
        # a text's wanted marks as (text, mark) pairs, looked up all at once
        of_mark = np.repeat(np.arange(b.num_rows), pc.list_value_length(known).to_numpy(zero_copy_only=False))
        wanted = np.sort(mix(pc.list_flatten(known).to_numpy().view(np.uint64)) ^ mix(of_mark.astype(np.uint64)))
        held: list[tuple] = []
        for of, mark, first, n in regions(texts):
            asked = mix(mark.view(np.uint64)) ^ mix(of.astype(np.uint64))
            hit = wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked
            of, mark, first, size = of[hit], mark[hit], first[hit], n[hit] + LENGTH - 1
            if len(mark):
                held.append((mark, _fingerprints(data, begin[of] + first, size), k[of], tk[of], first, size))
        if not held:
            continue
        rows = dict(zip(names, (np.concatenate(c) for c in zip(*held))))
        order = np.lexsort((rows["start"], rows["tk"], rows["k"], rows["size"], rows["print"], rows["mark"]))
        rows = {c: v[order] for c, v in rows.items()}
        later = np.ones(len(order), bool)
        later[_runs(rows["mark"], rows["print"], rows["size"])] = False
        by_region = mix(rows["mark"].view(np.uint64) + mix(rows["print"].view(np.uint64) + rows["size"].astype(np.uint64)))
        by_text = mix(rows["k"].view(np.uint64) + rows["tk"].astype(np.uint64))
        route = np.where(later, by_text, by_region).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(later.astype(np.int8)), *[pa.array(rows[c]) for c in names]], ["route", "later", *names])


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All regions, ``later`` now for all but the corpus-wide earliest of equal ones."""
    key = ("route", "later", "mark", "print", "size")
    for rows in _streamed(batches, *key):
        later = np.ones(rows.num_rows, np.int8)
        head = _runs(*[rows.column(c).to_numpy() for c in key])
        later[head] = rows.column("later").to_numpy()[head]
        out = rows.select(["mark", "k", "tk", "start", "size"]).append_column("later", pa.array(later))
        yield from out.combine_chunks().to_batches()


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked regions of each text (kind 0, by mark); of heavy marks
    every string by hash (kind 1), and those that repeat in the batch (kind 2)."""
    for b in batches:
        texts, k, tk = _raw(b.column("text")), b.column("k").to_numpy(), b.column("tk").to_numpy()
        heavy: list[tuple] = []
        for i, asked in enumerate(b.column("asked").to_pylist()):
            light = [r for r in asked if not r["heavy"]]
            for lo in range(0, len(light), 8192):
                part = light[lo : lo + 8192]
                n, mark = len(part), pa.array([r["mark"] for r in part], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [mark, pa.array(np.zeros(n, np.int8)), mark, pa.array(np.full(n, k[i])), pa.array(np.full(n, tk[i], np.int32)),
                     pa.array([r["start"] for r in part], pa.int64()),
                     pa.array([texts[i][r["start"] : r["start"] + r["size"]] for r in part], pa.binary())],
                    ["route", "kind", "mark", "k", "tk", "start", "bytes"],
                )
            for r in asked:
                if r["heavy"]:
                    place = np.arange(r["start"], r["start"] + r["size"] - LENGTH + 1)
                    width = np.full(len(place), LENGTH)
                    piece = texts[i][r["start"] : r["start"] + r["size"]]
                    one = _fingerprints(piece, place - r["start"], width)
                    two = _fingerprints(piece[::-1], (place - r["start"])[::-1].copy(), width)
                    heavy.append((one, two, np.full(len(place), k[i]), np.full(len(place), tk[i], np.int32), place))
        if heavy:
            one, two, hk, htk, place = (np.concatenate(c) for c in zip(*heavy))
            order = np.lexsort((place, htk, hk, two, one))
            one, two, hk, htk, place = (c[order] for c in (one, two, hk, htk, place))
            kind = np.full(len(one), 2, np.int8)
            kind[_runs(one, two)] = 1
            route = np.where(kind == 1, one, mix(hk.view(np.uint64) + htk.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(route), pa.array(kind), pa.array(two), pa.array(hk), pa.array(htk), pa.array(place), pa.array([None] * len(one), pa.binary())],
                ["route", "kind", "mark", "k", "tk", "start", "bytes"],
            )


def repeated_strings(k: np.ndarray, tk: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, start, end) of byte ranges whose strings occur earlier in the shard."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()) + 1, np.int16)
    s[:-1] = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    s[:-1] += 2
    s[begin + size] = 1  # a region's end is below every byte, the end marker below that
    sa = suffix_array(s, LENGTH)
    region = np.repeat(np.arange(len(pieces)), size + 1)
    inside = np.arange(len(region)) - np.repeat(begin, size + 1)
    valid = np.append(inside <= np.repeat(size, size + 1) - LENGTH, False)
    shared = common_prefixes(s, sa, LENGTH, valid)
    order = np.lexsort((tk, k))
    fresh = np.append(True, (k[order][1:] != k[order][:-1]) | (tk[order][1:] != tk[order][:-1]))
    document = np.empty(len(k), np.int64)
    document[order] = np.cumsum(fresh) - 1
    ok = valid[sa]
    here = sa[ok]
    follows = shared[here] >= LENGTH
    place = (document[region[here]] << 40) | (start[region[here]] + inside[here])
    groups = np.flatnonzero(~follows)
    least = np.minimum.reduceat(place, groups) if len(here) else place
    number = np.cumsum(~follows) - 1
    later = np.sort(here[place != least[number]]) if len(here) else here
    run = np.flatnonzero(np.append(True, later[1:] != later[:-1] + 1)) if len(later) else later
    last = np.append(run[1:], len(later)) - 1
    of = region[later[run]] if len(later) else later
    lo = start[of] + inside[later[run]] if len(later) else later
    hi = start[of] + inside[later[last]] + LENGTH if len(later) else later
    return of, lo, hi


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of what ``_cut_out`` made, sorted by route: regions a shard
    of whole marks at a time, strings by their hash."""
    held: list[pa.Table] = []
    size = 0

    def spans(k, tk, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(tk), pa.array(lo), pa.array(hi)], ["k", "tk", "start", "end"])

    def flush() -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        held.clear()
        k, tk, start = (rows.column(c).to_numpy() for c in ("k", "tk", "start"))
        of, lo, hi = repeated_strings(k, tk, start, rows.column("bytes").to_pylist())
        return spans(k[of], tk[of], lo, hi)

    for rows in _streamed(batches, "route", "kind", "mark"):
        kind = rows.column("kind").to_numpy()
        strings = rows.filter(pa.array(kind > 0))
        if strings.num_rows:
            key = [strings.column(c).to_numpy() for c in ("route", "kind", "mark")]
            gone = np.ones(strings.num_rows, bool)
            gone[_runs(*key)] = False
            gone |= key[1] == 2
            k, tk, start = (strings.column(c).to_numpy()[gone] for c in ("k", "tk", "start"))
            yield spans(k, tk, start, start + LENGTH)
        regions_ = rows.filter(pa.array(kind == 0)).combine_chunks()
        if not regions_.num_rows:
            continue
        upto = np.append(0, np.cumsum(pc.binary_length(regions_.column("bytes")).to_numpy(), dtype=np.int64))
        at = 0
        for g in _runs(regions_.column("mark").to_numpy()).tolist():
            if size + upto[g] - upto[at] >= SHARD_BYTES:
                held.append(regions_.slice(at, g - at))
                yield flush()
                size, at = 0, g
        held.append(regions_.slice(at))
        size += int(upto[-1] - upto[at])
    if held:
        yield flush()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(_raw(b.column("text")), b.column("spans").to_pylist()):
            n, removed, count, at, keep = len(text), 0, 0, 0, hashlib.sha256()
            last = -1
            for r in sorted(spans or (), key=lambda r: r["start"]):
                lo, hi = max(r["start"], at), r["end"]
                if hi <= at:
                    continue
                if r["start"] > last:
                    count += 1
                keep.update(text[at:lo])
                removed += hi - lo
                at = last = hi
            keep.update(text[at:])
            rows.append((n, removed, count, keep.hexdigest()))
        cols = list(zip(*rows)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("k"), b.column("tk"), *[pa.array(c, t) for c, t in zip(cols, types)]],
            ["k", "tk", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _documents(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(k, tk, text): one row per different text of an id; and (k, tk, rows): how many
    rows hold it, where ids repeat.

    An id of one row has tk 0.  Rows of the other ids, all rows without id among
    them, are grouped by id and 128 bits of content hash, copies combined on the
    map side, and the texts of an id numbered in the order of their hashes, so no
    two texts are taken for one and no copy is searched.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    d = docs.select(k.alias("k"), F.lit(0).alias("tk"), content.alias("text"))
    again = d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("again"))
    again = materialize(again, "repeated-ids")
    if again.isEmpty():
        return d, None
    once = d.join(again, F.col("k") == F.col("again"), "left_anti")
    many = d.join(again, F.col("k") == F.col("again"), "left_semi")
    many = many.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    texts = many.groupBy("k", "h1", "h2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    texts = materialize(texts, "repeated-texts")
    number = place(texts.select("k", "h1", "h2"), ["k"], ["h1", "h2"])
    number = number.select(*[F.col(c).alias(f"{c}_") for c in ("k", "h1", "h2")], F.col("idx").cast("int").alias("tk"))
    texts = texts.join(number, [F.col(c) == F.col(f"{c}_") for c in ("k", "h1", "h2")])
    return once.unionByName(texts.select("k", "tk", "text")), materialize(texts.select("k", "tk", "rows"), "repeated-rows")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    key = ["k", "tk"]
    d, rows = _documents(docs, doc_id, text)
    one_by_one = d.mapInArrow(_marks(False), "mark bigint, k bigint, tk int, seen tinyint")
    often = one_by_one.repartition("mark").sortWithinPartitions("mark").mapInArrow(_often, "mark bigint, k bigint, tk int")
    known = d.mapInArrow(_marks(True), "mark bigint, k bigint, tk int")
    marks = often.unionByName(known).groupBy(key).agg(F.collect_set("mark").alias("marks"))

    found = d.join(marks, key).select("k", "tk", "text", "marks").mapInArrow(
        _known_regions,
        "route bigint, later tinyint, mark bigint, print bigint, k bigint, tk int, start bigint, size bigint",
    )
    order = ["route", "later", "mark", "print", "size", "k", "tk", "start"]
    told = found.repartition("route").sortWithinPartitions(*order).mapInArrow(
        _earliest, "mark bigint, k bigint, tk int, start bigint, size bigint, later tinyint"
    )
    again = told.where("later = 1").select("k", "tk", "start", (F.col("start") + F.col("size")).alias("end"))
    first = told.where("later = 0").drop("later")

    # only different regions of one mark can share a string that equal regions do not explain
    weight = first.groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    wanted = first.join(weight.select("mark", (F.col("bytes") > shard_bytes).alias("heavy")), "mark")
    asked = wanted.groupBy(key).agg(F.collect_list(F.struct("mark", "start", "size", "heavy")).alias("asked"))
    cut = d.join(asked, key).select("k", "tk", "text", "asked").mapInArrow(
        _cut_out, "route bigint, kind tinyint, mark bigint, k bigint, tk int, start bigint, bytes binary"
    )
    shared = cut.repartition("route").sortWithinPartitions("route", "kind", "mark", "k", "tk", "start").mapInArrow(
        _shards, "k bigint, tk int, start bigint, end bigint"
    )
    gone = again.unionByName(shared).groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kept = d.join(gone, key, "left").mapInArrow(
        _kept, "k bigint, tk int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    own = F.when(F.col("k") != NO_ID, F.col("k")).cast(id_type).alias("doc_id")
    if rows is None:
        return kept.select(own, "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # the copies of a text, which are gone as a whole where they hold a string at all
    copy = kept.join(rows, key, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("rows", F.lit(1)))))
    lost = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    return copy.select(
        own,
        "n_bytes",
        F.when(lost, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(lost, 1).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(lost, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


@query("op8_repeat_removal")
def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings that occurred before."""
    return remove_repeats(table(spark, sf_dir, "documents"))
