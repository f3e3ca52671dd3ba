"""Benchmark decontamination by q-gram lemma filtering.

A region of an item leaks into a text where a substring of the text is within its
edit budget, both lower-cased and with runs of white space as one space.  Regions
are whole items, up to ``WHOLE`` characters, with 10 percent edits, and overlapping
windows, so that a long part of an item (5 percent edits), or of one too long to
align as a whole (10 percent), is found too.  A region of length L with budget k shares at
least L + 1 - q(k + 1) character q-grams with such a substring, on diagonals (place in
text - place in region) at most k apart; q is 8, or less for short items, so that the
bound is positive at the full budget.  Shared q-grams are counted in bands of
diagonals that overlap by k; bands with too few are dropped without loss, the
rest are verified by an alignment restricted to the band.

Scale.  Texts are not shuffled.  Items are indexed in blocks of about
``block_chars`` characters; one block is broadcast at a time and the texts are
read once per block, so memory is bounded whatever the size of the benchmark.
A batch of texts is bounded too; one very long text is scanned in overlapping
pieces.

Defined results.  Null and empty texts and items match nothing.  An item shorter
than ``SHORT`` code points matches only a text that equals it as a whole.  Repeated
rows each get their results; of several regions and places of an item in a text the
longest region, then the fewest edits, then the first place, is reported.  Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.registry import query, table
from tessella.session import materialize

Q, EDIT_PERCENT, BLOCK_CHARS, BATCH_CHARS = 8, 10, 1 << 20, 1 << 21
#: Items from SHORT characters are aligned, up to WHOLE as a whole; windows have
#: three quarters of an item, WINDOW at most and LEAST_WINDOW at least.
SHORT, WHOLE, WINDOW, LEAST_WINDOW = 8, 1000, 100, 60
_GAP, _BIG, _BITS = 0x110000, 1 << 24, 22
_SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalized text and the place each one had."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    a = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(a, _SPACES) if a.size and a.max() > 127 else (a == 32) | ((a >= 9) & (a <= 13))
    keep = ~space | ~np.append(True, space[:-1])  # the first of each run, none at the start
    if a.size and space[-1]:  # nor at the end
        run = np.flatnonzero(~space)
        keep[run[-1] + 1 if run.size else 0 :] = False
    at = np.flatnonzero(keep)
    return np.where(space, np.uint32(32), a)[at], at


def grams(a: np.ndarray, q: int = Q) -> np.ndarray:
    """One 64-bit code per q-gram start."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = a[:n].astype(np.uint64)
    for i in range(1, q):
        h *= _M
        h += a[i : n + i]
    h ^= h >> np.uint64(29)
    return h * _M


def regions(n: int, edit_percent: int = EDIT_PERCENT) -> list[tuple[int, int, int]]:
    """(start, end, edits allowed) of the regions of an item of ``n`` characters: the
    item, and windows so close that a run of seven eighths of it, or of 150
    characters, holds one.  Beside a whole item windows are for quotes, with half
    the edits; of an item too long to align they are all there is, with all of them."""
    out = [(0, n, n * edit_percent // 100)] if n <= WHOLE else []
    size = min(WINDOW, 3 * n // 4)
    if size >= LEAST_WINDOW:
        step = max(1, min(WINDOW // 2, n // 8))
        budget = size * edit_percent // (200 if out else 100)
        out += [(at, at + size, budget) for at in [*range(0, n - size, step), n - size]]
    return out


class Index:
    """q-grams of the regions of a block of items."""

    def __init__(self, items: list[tuple], edit_percent: int = EDIT_PERCENT) -> None:
        rows = [(i, normalized(t)[0]) for i, t in items if t]
        rows = [(i, a) for i, a in rows if len(a)]
        self.short: dict[bytes, list] = {}
        for i, a in rows:
            if len(a) < SHORT:
                self.short.setdefault(a.tobytes(), []).append(i)
        found = {}
        for i, a in rows:
            if len(a) >= SHORT:
                for lo, hi, k in regions(len(a), edit_percent):
                    found.setdefault((i, a[lo:hi].tobytes()), (a[lo:hi], hi - lo == len(a), k))
        self.ids, self.texts = [i for i, _ in found], [a for a, _, _ in found.values()]
        self.whole = np.array([w for _, w, _ in found.values()], bool)
        n = np.array([len(a) for a in self.texts], np.int64)
        self.k = np.array([k for _, _, k in found.values()], np.int64)
        self.q = np.minimum(Q, n // (self.k + 1))
        self.need = n + 1 - self.q * (self.k + 1)
        self.step = np.maximum(self.k, 16)
        self.tables = [self._table(int(q)) for q in np.unique(self.q)]
        self.gap = int(self.k.max(initial=0)) + 1 + Q
        self.longest = int((n + self.k).max(initial=0))

    def _table(self, q: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """q-grams of the regions that use ``q``: codes with the range of their
        entries, the entries' regions and places, and which upper bits occur."""
        mine = np.flatnonzero(self.q == q)
        codes = [grams(self.texts[i], q) for i in mine]
        all_codes = np.concatenate(codes)
        order = np.argsort(all_codes, kind="stable")
        item = np.repeat(mine.astype(np.int32), [len(c) for c in codes])[order]
        place = np.concatenate([np.arange(len(c), dtype=np.int32) for c in codes])[order]
        codes, first, count = np.unique(all_codes[order], return_index=True, return_counts=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[(codes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return q, codes, first, count, item, place, seen

    def _shared(self, a: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, first diagonal of the band, shared q-grams) of promising bands."""
        q, codes, first, count, items, places, seen = table
        h = grams(a, q)
        none = np.zeros(0, np.int64)
        hit = np.flatnonzero(seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(codes, h[hit])
        same = codes[np.minimum(at, len(codes) - 1)] == h[hit]
        hit, at = hit[same], at[same]
        if not len(hit):
            return none, none, none
        times = count[at]
        entry = np.repeat(first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item = items[entry].astype(np.int64)
        diagonal = np.repeat(hit, times) - places[entry] + WHOLE  # never negative
        band = diagonal // self.step[item]
        both = diagonal - band * self.step[item] <= self.k[item]  # also in the band before
        key = np.concatenate([(item << 40) | (band + 1), (item[both] << 40) | band[both]])
        key, shared = np.unique(key, return_counts=True)
        item, band = key >> 40, (key & ((1 << 40) - 1)) - 1
        good = shared >= self.need[item]
        return item[good], (band * self.step[item] - WHOLE)[good], shared[good]

    def candidates(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self._shared(a, t) for t in self.tables] or [(np.zeros(0, np.int64),) * 3]
        return tuple(np.concatenate(c) for c in zip(*found))

    def aligned(self, a: np.ndarray, item: int, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, start, end) of the best alignment in each band of one region."""
        text = self.texts[item]
        width = int(self.step[item] + self.k[item]) + 1
        padded = np.concatenate([a, np.full(width + len(text) + 1, _GAP, np.uint32)])
        j = np.arange(width)
        cost = np.broadcast_to(j, (len(bands), width)).astype(np.int64)
        for p in range(len(text)):
            place = bands[:, None] + j + p
            other = (padded[np.maximum(place, 0)] != text[p]) | (place < 0)
            sub = cost + other * _BIG
            sub[:, :-1] = np.minimum(sub[:, :-1], cost[:, 1:] + _BIG)
            cost = np.minimum.accumulate(sub - j * _BIG, axis=1) + j * _BIG
        best = cost.argmin(1)
        value = cost[np.arange(len(bands)), best]
        return value // _BIG, bands + value % _BIG, bands + best + len(text)

    def matches(self, a: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, region, edits, start, end) wherever a region is within its edit budget
        in one of the texts that begin at ``begin``; a text that holds a whole item is
        not searched for the item's windows."""
        item, band, _ = self.candidates(a)
        held: set[tuple] = set()
        found = np.unique(item)
        for i in [*found[self.whole[found]], *found[~self.whole[found]]]:
            bands, size, name = band[item == i], len(self.texts[i]), self.ids[i]
            if not self.whole[i]:
                text = np.searchsorted(begin, bands + size // 2, "right") - 1
                bands = bands[[(t, name) not in held for t in text.tolist()]]
            for at in range(0, len(bands), 256):
                for e, s, z in zip(*self.aligned(a, int(i), bands[at : at + 256])):
                    if e <= self.k[i]:
                        t = int(np.searchsorted(begin, (s + z) // 2, "right")) - 1  # ends may reach into a gap
                        if self.whole[i]:
                            held.add((t, name))
                        yield t, int(i), int(e), int(s), int(z)


def find_leaks(index: Index, texts: list[str | None]) -> Iterator[tuple[int, object, int, int, int]]:
    """(row, item id, edits, start, end) of the best place of each item's longest
    region found per text."""
    best: dict[tuple, tuple] = {}

    def flush(parts: list[tuple]) -> None:
        if not parts:
            return
        gap = np.full(index.gap, _GAP, np.uint32)
        joined = np.concatenate([x for _, a, _ in parts for x in (a, gap)])
        begin = np.cumsum([0] + [len(a) + index.gap for _, a, _ in parts])
        for p, i, e, s, z in index.matches(joined, begin):
            row, a, at = parts[p]
            lo, hi = max(s - begin[p], 0), min(z - begin[p], len(a))
            if hi > lo:
                found = (-len(index.texts[i]), e, int(at[lo]), int(at[hi - 1]) + 1)
                key = (row, index.ids[i])
                best[key] = min(best.get(key, found), found)

    parts, size = [], 0
    for row, text in enumerate(texts):
        if not text:
            continue
        a, at = normalized(text)
        for item in index.short.get(a.tobytes(), ()) if len(a) < SHORT else ():
            yield row, item, 0, int(at[0]), int(at[-1]) + 1
        for lo in range(0, len(a), BATCH_CHARS):
            piece = slice(lo, min(len(a), lo + BATCH_CHARS + index.longest))
            parts.append((row, a[piece], at[piece]))
            size += piece.stop - piece.start
            if size >= BATCH_CHARS:
                flush(parts)
                parts, size = [], 0
    flush(parts)
    for (row, item), (_, e, s, z) in sorted(best.items(), key=lambda x: x[0][0]):
        yield row, item, e, s, z


def _search(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = list(find_leaks(index, part.column("text").to_pylist()))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(cols[0], pa.int32())), pa.array(cols[1], item_type),
                     pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                    ["doc_id", "item_id", "edits", "start", "end"],
                )

    return run


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator:
    """Broadcast lists of (id, text) of about ``block_chars`` characters each."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()  # about block_chars
        yield benchmark.sparkSession.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, start, end (code points) of every leak."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d, i = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = pa.int64() if i == "bigint" else pa.int32() if i == "int" else pa.string()
    out = None
    for shared in _blocks(benchmark, item_id, item_text, block_chars):
        found = docs.mapInArrow(_search(shared, item_type), f"doc_id {d}, item_id {i}, edits int, start bigint, end bigint")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(shared, text: str):
    """Rows whose text holds no item of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                leaking = {row for row, *_ in find_leaks(index, part.column(text).to_pylist())}
                yield part.filter(pa.array([row not in leaking for row in range(part.num_rows)], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item.

    Each row is kept or dropped where it is read, by its own text, one block of the
    benchmark after the other; nothing is joined or shuffled.
    """
    out, before = docs, False
    for shared in _blocks(benchmark, item_id, item_text, block_chars):
        if before:
            out = materialize(out, "decontaminated")
        out, before = out.mapInArrow(_clean(shared, text), docs.schema), True
    return out


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document, with its edits and place."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
