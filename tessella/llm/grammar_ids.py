"""Token ids in grammar-compressed shard files (Re-Pair).

Texts are put in ascending order, encoded, closed by an end id and gathered into
shards.  Per shard, the most frequent id pairs are replaced by nonterminals,
round after round, until no pair is frequent enough.  One row of the written
table is one shard file:

    first, part     smallest doc_id and running number in its task: shard order
    doc_ids, sizes  documents in order and their ids, the end id included
    pairs           the rules: nonterminal ``terminals + k`` is two symbols
    spans           ids that each rule stands for: seeks without expanding
    low, high       the symbols: lower 16 bits, and the bits above them

Scale.  One range shuffle by doc_id; shards have a fixed number of ids, whatever
the size of the corpus, and are written as soon as they are full.  Places of
shards come from one sum per shard.  Files are written by Spark's committer, so
a lost executor's shards are written again.

Defined results.  The query's ids are those of the tokenizers library's plain
call: an added token of the vocabulary in a text is its own id.  With
``special_as_text`` (the library's ``encode_special_tokens``, on by default in
``write_shards``) special ones are ordinary pieces.  A null or empty text is its
end id alone.  Rows with equal
doc_id are ordered by text; null doc_ids come first.  An empty table has no
shards and no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.registry import query, table
from tessella.llm.token_units import kept_in_worker, unit_begins
from tessella.session import scratch_path

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
END_ID, SHARD_IDS, MIN_COUNT, RULES_A_ROUND, SLOT_BITS = 2, 1 << 22, 16, 8192, 20
#: Units kept per worker, their characters, and bytes of text that are cut together.
KEPT_UNITS, LONGEST, SLICE_BYTES = 600_000, 48, 1 << 23
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_STOP = np.isin(np.arange(256), [ord("."), ord(",")])
_U = np.uint64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table_ = {b: chr(b) for b in shown}
    rest = (b for b in range(256) if b not in table_)
    return table_ | {b: chr(256 + i) for i, b in enumerate(rest)}


def unit_encoder(vocabulary: str, pattern: str, keep: int = KEPT_UNITS):
    """Ids of a unit (uint32 bytes): pre-tokens go to the vocabulary's BPE model."""
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenize, split, letters = tokenizer.model.tokenize, regex.compile(pattern), byte_letters()
    space = letters[32]
    units: dict[str, bytes] = {}
    parts: dict[str, bytes] = {}  # pre-tokens of units that have several

    def piece(p: str) -> bytes:
        if p.isascii() and p[1:].isalpha():  # letters stand for themselves
            spelled = space + p[1:] if p[0] == " " else p
        else:
            spelled = p.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(spelled)]).tobytes()

    def known(cache: dict[str, bytes], size: int, key: str, make) -> bytes:
        got = cache.get(key)
        if got is None:
            got = make(key)
            if len(key) <= LONGEST and len(cache) < size:
                cache[key] = got
        return got

    def whole(unit: str) -> bytes:
        if unit[:1] == " " and unit[1:].isalpha():  # a space and letters are one pre-token
            return piece(unit)
        pieces = split.findall(unit)
        return piece(unit) if pieces == [unit] else b"".join([known(parts, keep // 6, p, piece) for p in pieces])

    return lambda unit: known(units, keep, unit, whole)


def added_tokens(vocabulary: str, special_as_text: bool = False):
    """(pattern, ids by content) of the tokens that are found before pre-tokens."""
    found = Tokenizer.from_file(vocabulary).get_added_tokens_decoder().items()
    found = {t.content: (i, t) for i, t in found if t.content and not (special_as_text and t.special)}
    if not found:
        return None, {}

    def one(t) -> str:
        alone = (r"(?<!\w)", r"(?!\w)") if t.single_word else ("", "")
        return r"\s*" * t.lstrip + alone[0] + f"({regex.escape(t.content)})" + alone[1] + r"\s*" * t.rstrip

    longest_first = sorted(found, key=len, reverse=True)
    return regex.compile("|".join(one(found[c][1]) for c in longest_first)), {c: i for c, (i, _) in found.items()}


def texts_encoder(vocabulary: str, pattern: str, special_as_text: bool = False):
    """Function from texts and a closing id to all their ids and the number of ids of each.

    Added tokens are found first, units in what lies between.  All texts of a call
    are cut together, and each distinct unit of them is looked up once.  As a stop
    never goes on with a match of letters, nor letters with a line feed, units are
    cut there too: most are one pre-token then.
    """
    unit_ids = unit_encoder(vocabulary, pattern)
    added, number = added_tokens(vocabulary, special_as_text)

    def closed(texts: pa.LargeStringArray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each closed by its own id."""
        _, edges, data = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        text = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        begins, letter = unit_begins(text, edges[:-1]), _LETTER[text]
        begins[1:] |= (letter[:-1] & _STOP[text[1:]]) | (begins[:-1] & (text[:-1] == 10) & letter[1:])
        starts = np.flatnonzero(begins)
        units = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(text))), pa.py_buffer(text)
        ).dictionary_encode()
        ends, of = np.unique(closing, return_inverse=True)
        ids = list(map(unit_ids, units.dictionary.to_numpy(zero_copy_only=False)))
        ids += [e.tobytes() for e in ends.astype("<u4")]
        after = np.searchsorted(starts, edges[1:])
        codes = np.insert(units.indices.to_numpy(), after, len(units.dictionary) + of)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(codes))
        places = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] // 4
        row_ends = places[after + np.arange(1, len(texts) + 1)]
        return np.frombuffer(taken.buffers()[2], "<u4")[: places[-1]], np.diff(row_ends, prepend=0)

    def texts_ids(texts: pa.Array, closing: int) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not any(pc.any(pc.match_substring(texts, c)).as_py() for c in number):
            return closed(texts, np.full(len(texts), closing))
        parts, ends, first = [], [], []
        for text in texts.to_pylist():
            at = 0
            first.append(len(parts))
            for m in added.finditer(text):
                parts.append(text[at : m.start()])
                ends.append(number[m[m.lastindex]])
                at = m.end()
            parts.append(text[at:])
            ends.append(closing)
        ids, sizes = closed(pa.array(parts, pa.large_string()), np.array(ends))
        return ids, np.add.reduceat(sizes, first)

    return texts_ids


def text_encoder(vocabulary: str, pattern: str, special_as_text: bool = False):
    """Ids of a text (uint32 bytes)."""
    texts_ids = texts_encoder(vocabulary, pattern, special_as_text)
    return lambda text: texts_ids(pa.array([text], pa.large_string()), 0)[0][:-1].tobytes()


def slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``size`` bytes of text; a longer text is alone or last."""
    bytes_ = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(bytes_) - bytes_) // size
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, z - a) for a, z in zip(edges, edges[1:]) if z > a)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    slot = keys * _U(0x9E3779B97F4A7C15)
    slot >>= _U(64 - bits)
    return slot.view(np.int64)


def re_pair(ids: np.ndarray, terminals: int, min_count: int = MIN_COUNT,
            per_round: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules as pairs, expansion lengths) of a sequence of ids.

    A round takes the most frequent pairs at once; where two of them overlap the
    more frequent one is replaced, the left one of equals.  Rounds go on until no
    pair occurs ``min_count`` times.  New places of a pair come up only beside the
    symbols of the round before, so a pair that is rare once stays rare and its
    places are not counted again.
    """
    s, rules, lengths = ids.astype(np.uint32), [], []
    live = np.arange(len(s) - 1)  # places of pairs that may be frequent
    while len(live):
        every = len(live) == len(s) - 1
        keys = (s[:-1] if every else s[live]).astype(np.uint64)
        keys <<= _U(32)
        keys |= s[1:] if every else s[live + 1]
        # pairs are counted by hash first; only those of full enough slots are sorted
        slot = _slot(keys, SLOT_BITS)
        full = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= min_count)[slot])
        live, keys, slot = live[full], keys[full], slot[full]
        ordered = np.sort(keys)
        new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        counts = np.diff(np.append(new, len(ordered)))
        frequent = np.flatnonzero(counts >= min_count)
        if not len(frequent):
            break
        best = frequent[np.lexsort((ordered[new[frequent]], -counts[frequent]))][:per_round]
        chosen = ordered[new[best]]
        slots, at = np.unique(_slot(chosen, SLOT_BITS), return_index=True)
        place = np.full(1 << SLOT_BITS, -1, np.int32)
        place[slots] = at  # of pairs that share a slot the most frequent stays
        rank = place[slot]
        at = np.flatnonzero(rank >= 0)
        at = at[chosen[rank[at]] == keys[at]]
        r, where = rank[at], live[at]
        near = where[1:] == where[:-1] + 1
        wins, right_better = np.ones(len(r), bool), np.append(near & (r[1:] < r[:-1]), False)
        wins[1:] = ~(near & (r[:-1] <= r[1:]))
        wins &= ~right_better
        equal = np.flatnonzero(near & (r[1:] == r[:-1])) + 1
        if len(equal):  # equal neighbours (aaaa): every second place of the run
            head = np.flatnonzero(np.append(True, equal[1:] != equal[:-1] + 1))
            run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(equal))))
            start = equal[head] - 1
            turn = (equal - start[run] + (~wins[start])[run]) % 2 == 0
            wins[equal] = turn & ~right_better[equal]
        hits, used = where[wins], r[wins]  # the most frequent pair always has some
        some = np.bincount(used, minlength=len(chosen)) > 0
        kept, number = np.flatnonzero(some), (np.cumsum(some) - 1)[used]
        base = terminals + sum(map(len, rules))
        made = chosen[kept]
        rules.append(np.stack([made >> _U(32), made & _U(0xFFFFFFFF)], 1).astype(np.uint32))
        s[hits] = (base + number).astype(np.uint32)
        stay, open_ = np.ones(len(s), bool), np.zeros(len(s), bool)
        stay[hits + 1] = False
        open_[live] = open_[hits] = True
        s, open_ = s[stay], open_[stay]
        made_at = hits - np.arange(len(hits))  # one symbol went for each hit before
        open_[made_at[made_at > 0] - 1] = True
        live = np.flatnonzero(open_[:-1])
        size = symbol_lengths(np.concatenate(lengths) if lengths else np.zeros(0, np.uint32), terminals)
        lengths.append((size(rules[-1][:, 0]) + size(rules[-1][:, 1])).astype(np.uint32))
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return s, pairs, np.concatenate(lengths) if lengths else np.zeros(0, np.uint32)


def symbol_lengths(spans: np.ndarray, terminals: int):
    """Function from symbols to the number of ids they stand for."""

    def of(symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= terminals
        out[rule] = spans[symbols[rule] - terminals]
        return out

    return of


def expand(symbols: np.ndarray, pairs: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of symbols; every pass opens the outermost rules."""
    s = symbols.astype(np.uint32)
    while (rule := s >= terminals).any():
        at = np.cumsum(1 + rule) - 1 - rule
        out = np.empty(len(s) + int(rule.sum()), np.uint32)
        out[at] = s
        two = pairs[s[rule] - terminals]
        out[at[rule]], out[at[rule] + 1] = two[:, 0], two[:, 1]
        s = out
    return s


def expand_whole(symbols: np.ndarray, pairs: np.ndarray, spans: np.ndarray, terminals: int) -> np.ndarray:
    """The ids of a whole shard: every rule is opened once, then copied to its places."""
    opened = expand(np.arange(terminals, terminals + len(pairs), dtype=np.uint32), pairs, terminals)
    known = np.concatenate([np.arange(terminals, dtype=np.uint32), opened])
    first = np.concatenate([np.arange(terminals), terminals + np.cumsum(spans, dtype=np.int64) - spans])
    size = symbol_lengths(spans, terminals)(symbols)
    begin = np.cumsum(size) - size
    return known[np.repeat(first[symbols] - begin, size) + np.arange(size.sum())]


def read_span(shard: dict, start: int, stop: int, terminals: int) -> np.ndarray:
    """Ids [start, stop) of a shard; only the symbols that cover them are expanded."""
    symbols, pairs, spans = symbols_of(shard)
    ends = np.cumsum(symbol_lengths(spans, terminals)(symbols))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(symbols[a:b], pairs, terminals)[skip : skip + stop - start]


def symbols_of(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.frombuffer(shard["low"], "<u2"), np.frombuffer(shard["high"], "<u2")
    pairs = np.frombuffer(shard["pairs"], "<u4").reshape(-1, 2)
    return low.astype(np.uint32) | (high.astype(np.uint32) << 16), pairs, np.frombuffer(shard["spans"], "<u4")


def _file(first, part: int, doc_ids: list, sizes: list[int], ids: np.ndarray, terminals: int, schema: pa.Schema) -> pa.RecordBatch:
    s, pairs, spans = re_pair(ids, terminals)
    row = {
        "first": first, "part": part, "terminals": terminals, "doc_ids": doc_ids, "sizes": sizes,
        "pairs": pairs.astype("<u4").tobytes(), "spans": spans.astype("<u4").tobytes(),
        "low": s.astype("<u2").tobytes(), "high": (s >> 16).astype("<u2").tobytes(),
    }
    return pa.RecordBatch.from_pylist([row], schema)


def pack(vocabulary: str, pattern: str, end_id: int, shard_ids: int, special_as_text: bool = False):
    """mapInArrow function: ordered (doc_id, text) to shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = ("ids", vocabulary, pattern, special_as_text)
        encode = kept_in_worker(name, lambda: texts_encoder(vocabulary, pattern, special_as_text))
        terminals = max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1)
        part, doc_ids, sizes, held, total, schema = 0, [], [], [], 0, None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            schema = pa.schema([
                ("first", id_type), ("part", pa.int32()), ("terminals", pa.int32()), ("doc_ids", pa.list_(id_type)),
                ("sizes", pa.list_(pa.int64())), ("pairs", pa.binary()), ("spans", pa.binary()), ("low", pa.binary()), ("high", pa.binary()),
            ])
            for some in slices(b, "text", SLICE_BYTES):
                ids, counts = encode(some.column("text"), end_id)
                at = 0
                for doc, n in zip(some.column("doc_id").to_pylist(), counts.tolist()):
                    doc_ids.append(doc)
                    sizes.append(n)
                    held.append(ids[at : at + n])
                    at, total = at + n, total + n
                    if total >= shard_ids:
                        yield _file(doc_ids[0], part, doc_ids, sizes, np.concatenate(held), terminals, schema)
                        part, doc_ids, sizes, held, total = part + 1, [], [], [], 0
        if doc_ids:
            yield _file(doc_ids[0], part, doc_ids, sizes, np.concatenate(held), terminals, schema)

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard files to (shard, doc_id, place in shard, n_tokens, crc32 of the ids)."""
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in ("first", "part", "terminals", "sizes", "pairs", "spans", "low", "high")}
            ids = expand_whole(*symbols_of(r), r["terminals"]).astype("<u4").tobytes()
            ends = np.cumsum(r["sizes"], dtype=np.int64)
            starts = ends - np.array(r["sizes"], np.int64)
            crcs = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(starts.tolist(), ends.tolist())]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [b.column("first").take(pa.array([i] * n, pa.int32())), pa.array([r["part"]] * n, pa.int32()),
                 b.column("doc_ids")[i].values, pa.array(starts, pa.int64()),
                 pa.array(r["sizes"], pa.int64()), pa.array(crcs, pa.int64())],
                ["first", "part", "doc_id", "place", "n_tokens", "ids_crc32"],
            )


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                 pattern: str = PATTERN, end_id: int = END_ID, shard_ids: int = SHARD_IDS, special_as_text: bool = True) -> None:
    """Write the shard files of ``docs`` below ``path``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    t = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        pack(vocabulary, pattern, end_id, shard_ids, special_as_text),
        f"first {t}, part int, terminals int, doc_ids array<{t}>, sizes array<bigint>, pairs binary, spans binary, low binary, high binary",
    ).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    files = spark.read.parquet(path)
    t = files.schema["first"].dataType.simpleString()
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("first", "part", total.alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = files.mapInArrow(unpack, f"first {t}, part int, doc_id {t}, place bigint, n_tokens bigint, ids_crc32 bigint")
    base = shards.select(F.col("first").alias("f"), F.col("part").alias("p"), "base")
    joined = rows.join(base, F.col("first").eqNullSafe(F.col("f")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_grammar_ids")
def op9_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as compressed shards and read back."""
    path = scratch_path(spark, "grammar-ids")
    write_shards(table(spark, sf_dir, "documents"), path, special_as_text=False)
    return read_documents(spark, path)
