"""Exact set-similarity join of word shingle sets, in a way that no group is paired with itself.

Shingles are ordered rare first. The order comes from a table of counts over all texts with a
fixed number of slots, so its size does not grow; it may be coarse, since any order that is the
same everywhere gives the same result. Two sets of similarity ``num/den`` share a shingle among
the first ``n - ceil(n * num / den) + 1`` of each (prefix filter).

1. ``digests``: one row per text (or line) with the size of its set, a 128-bit key of the whole
   set and the prefix. Equal sets are one class from here on.
2. ``star_edges``: for every prefix shingle, its classes are compared with one leader only,
   first within a task if it has more than two there, then between tasks, so a shingle that a
   third of all rows hold reaches a reducer at most twice per flush of a task. Length and
   positional filters apply.
3. Edges that pass the filters are verified on the texts, once per pair.
4. What that leaves open (classes that share a shingle but are not settled) is in
   ``cross_pairs``: a join on the open shingles only, with length, positional and suffix filters.

The suffix filter compares a 256-bit parity sketch: each shingle flips one bit, so differing
bits never exceed the number of shingles that only one set has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from kerbside.llm import words as W
from kerbside.llm.common import sized, small_batches, stored, tasks

#: Slots of the count table, as a power of two: 4 MB.
SKETCH_BITS = 20
_CHUNK = 1 << 14
_TOKEN_BITS = 44
_SET_BITS = 52
#: Postings that a task holds before it sends them on, and that a bucket has on average.
_FLUSH = 1 << 18
_POSTINGS = 1 << 17
#: Sets that a task remembers to have given tokens to.
_LED = 1 << 16
_LEAD = np.dtype([("key", "u8"), ("tie", "u8"), ("row", "i8"), ("part", "i4"), ("line", "i4")])
_BUCKETS_PER_TASK = 4


class Join(NamedTuple):
    """``k`` words to a shingle; linked when ``den * intersection >= num * union``. Without
    ``positions`` a token's place among the tokens of its set bounds nothing."""

    k: int
    num: int
    den: int
    lines: bool = False
    positions: bool = True


def _numpy(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def base(docs: DataFrame) -> DataFrame:
    """What the joins read: ``row`` (the ``doc_id``), the text and its ``hash``, which tells rows of
    one ``doc_id``, or without one, apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("row"), F.xxhash64(text).alias("hash"), text.alias("text"))


def part() -> Column:
    """The half of the hash that orders the texts of one row, in postings too."""
    return F.shiftright("hash", 32).cast("int")


def place() -> Column:
    """The order of lines: by row (null first), then text, then line."""
    return F.struct("row", part().alias("part"), "line", "hash")


class Tally:
    """Occurrences by slot. Slots are kept and counted together, as each count goes over the whole table."""

    def __init__(self) -> None:
        self.total = np.zeros(1 << SKETCH_BITS, np.uint32)
        self._kept: list[np.ndarray] = []
        self._n = 0

    def add(self, slots: np.ndarray) -> None:
        self._kept.append(slots)
        self._n += len(slots)
        if self._n >= len(self.total) // 4:
            self.flush()

    def flush(self) -> np.ndarray:
        if self._n:
            self.total += np.bincount(np.concatenate(self._kept), minlength=len(self.total)).astype(np.uint32)
        self._kept, self._n = [], 0
        return self.total


def shingle_counts(docs: DataFrame, join: Join) -> np.ndarray:
    """Occurrences of shingles by slot, over all texts. ``docs`` has ``text``."""
    kinds = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, texts in W.slices(batch.column(0), W.SMALL):
                h, _ = W.shingles(W.words(texts, lines=join.lines), join.k)
                tally.add(_slot(h))
        total = tally.flush()
        for c in range(0, len(total), _CHUNK):
            part = total[c : c + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [c], "counts": [part.tobytes()]}, kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(part, np.uint32).astype(np.int64)
                sums[c] = sums[c] + part if c in sums else part
        for c, part in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": [c], "counts": [part.tobytes()]}, kinds)

    schema = "chunk int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    parts = parts.repartition((1 << SKETCH_BITS) // _CHUNK, "chunk").mapInArrow(add, schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    with small_batches(docs.sparkSession):
        found = parts.collect()
    for row in found:
        out[row["chunk"] : row["chunk"] + _CHUNK] += np.frombuffer(row["counts"], np.int64)
    return out


class Sets(NamedTuple):
    """The distinct shingles of each unit of a slice, by unit."""

    n: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    unit: np.ndarray


def distinct(w: W.Words, k: int) -> Iterator[tuple[int, Sets]]:
    """Sets of at most 4096 units at a time, with the first unit's number. A shingle is known
    by the upper 52 bits of its hash (in the upper bits of ``hash``)."""
    h, unit = W.shingles(w, k)
    units, shift = len(w.unit_start), np.uint64(_SET_BITS)
    for low in range(0, units, 1 << (64 - _SET_BITS)):
        high = min(units, low + (1 << (64 - _SET_BITS)))
        inside = slice(None) if high - low == units else (unit >= low) & (unit < high)
        keys = (unit[inside] - low).astype(np.uint64) << shift
        keys |= h[inside] >> np.uint64(64 - _SET_BITS)
        keys.sort()
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        of = (keys >> shift).astype(np.int64)
        n = np.bincount(of, minlength=high - low)
        yield low, Sets(n, np.cumsum(n) - n, keys << np.uint64(64 - _SET_BITS), of)


def _sums(values: np.ndarray, sets: Sets) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[sets.first + sets.n] - total[sets.first]


def set_keys(sets: Sets) -> np.ndarray:
    """128 bits that are equal for equal sets, as two columns."""
    a = _sums(W.mix(sets.hash + np.uint64(0x51ED270B)), sets)
    b = _sums(W.mix(sets.hash ^ np.uint64(0xA0761D6478BD642F)), sets)
    return np.stack([W.mix(a + sets.n.astype(np.uint64)), b], axis=1)


def _prefix_size(n: np.ndarray, join: Join) -> np.ndarray:
    return np.where(n > 0, n - -(-n * join.num // join.den) + 1, 0)


def _parity(sets: Sets) -> np.ndarray:
    bit = sets.hash >> np.uint64(20)
    lane, flip = (bit >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (bit & np.uint64(63))
    out = np.zeros((len(sets.n), 4), np.uint64)
    some = np.flatnonzero(sets.n)
    for i in range(4 if len(some) else 0):
        out[some, i] = np.bitwise_xor.reduceat(np.where(lane == np.uint64(i), flip, np.uint64(0)), sets.first[some])
    return out.view(np.int64)


DIGEST = (
    "row long, hash long, line int, n int, key binary, id long, "
    "s0 long, s1 long, s2 long, s3 long, prefix array<long>"
)


def digests(docs: DataFrame, join: Join, name: str) -> DataFrame:
    """``digested`` by the prefixes of the sets, rare shingles first."""
    counts = shingle_counts(docs, join)
    levels = np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    levels = docs.sparkSession.sparkContext.broadcast(levels)

    def prefix(sets: Sets, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # a second sort, by unit, rarity and token: the upper 20 bits of a token give its rarity
        token = sets.hash >> np.uint64(64 - _TOKEN_BITS)
        order = sets.unit.astype(np.uint64) << np.uint64(_SET_BITS)
        order |= levels.value[_slot(sets.hash)].astype(np.uint64) << np.uint64(_TOKEN_BITS)
        order = np.sort(order | token)
        size = np.where(leads, _prefix_size(sets.n, join), 0)
        place = np.arange(len(order)) - sets.first[sets.unit]
        return order[place < size[sets.unit]] & np.uint64((1 << _TOKEN_BITS) - 1), size

    return digested(docs, join, prefix, name)


def digested(docs: DataFrame, join: Join, tokens: Callable, name: str) -> DataFrame:
    """One row per text, or per line that has words, stored: ``row`` and ``hash`` (of ``base``), line
    number, size and key of the set; and, for one of the equal sets of a batch, sketch and, as
    ``prefix``, the tokens by which sets meet. ``tokens`` gets sets and a mark for the units that
    need tokens, and returns the tokens in order of units and how many each unit has."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led = Led()
        for batch in batches:
            for at, texts in W.slices(batch.column(2), W.SMALL):
                w = W.words(texts, lines=join.lines)
                row_start = np.searchsorted(w.unit_row, w.unit_row)
                for low, sets in distinct(w, join.k):
                    yield _digest(batch.column(0), batch.column(1), at, w, row_start, low, sets, tokens, join, led)

    out = docs.select("row", "hash", "text").mapInArrow(digest, DIGEST)
    with small_batches(docs.sparkSession):
        return stored(out, name)


class Led:
    """Sets that a task gave tokens to, the last ``_LED`` or so, and the place of each: a later equal
    set needs none. Only what is spared depends on how many are kept."""

    def __init__(self) -> None:
        self._sets = np.empty(0, _LEAD)

    def fresh(self, new: np.ndarray) -> np.ndarray:
        """Marks those of ``new`` (distinct sets, in order of key) without an equal, earlier one; keeps them."""
        at = np.searchsorted(self._sets["key"], new["key"])
        known = np.zeros(len(new), bool)
        if len(self._sets):
            old = self._sets[np.minimum(at, len(self._sets) - 1)]
            known = (old["key"] == new["key"]) & (old["tie"] == new["tie"])
            earlier = old["row"] < new["row"]
            for upper, name in (("row", "part"), ("part", "line")):
                same = old[upper] == new[upper] if upper == "row" else same & (old[upper] == new[upper])
                earlier |= same & (old[name] < new[name])
            known &= earlier
        kept = np.concatenate([self._sets, new[~known]]) if len(self._sets) < _LED else new[~known]
        self._sets = kept[np.argsort(kept["key"], kind="stable")]
        return ~known


def _digest(rows, hashes, at, w, row_start, low, sets, tokens, join, led) -> pa.RecordBatch:
    keys, parity = set_keys(sets), _parity(sets)
    # the first of equal sets in order of place, however the rows of the batch are dealt
    of = at + w.unit_row[low : low + len(sets.n)]
    unit = np.arange(len(sets.n)) + low
    line = (unit - row_start[unit]).astype(np.int32)
    row = _numpy(rows.fill_null(np.iinfo(np.int64).min))[of]
    part = _numpy(hashes)[of] >> 32
    order = np.lexsort((part, row))
    _, one = np.unique(keys[order, 0], return_index=True)
    first = order[one]
    new = np.empty(len(first), _LEAD)
    new["key"], new["tie"] = keys[first, 0], keys[first, 1]
    new["row"], new["part"], new["line"] = row[first], part[first], line[first]
    leads = np.zeros(len(sets.n), bool)
    leads[first[led.fresh(new)]] = True
    leads &= sets.n > 0
    prefix, size = tokens(sets, leads)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(
        pa.array(offsets, mask=np.append(~leads, False)), pa.array(prefix.view(np.int64))
    )
    body = pa.py_buffer(np.ascontiguousarray(keys).tobytes())
    key = pa.Array.from_buffers(pa.binary(16), len(keys), [None, body]).cast(pa.binary())
    out = {"row": rows.take(pa.array(of)), "hash": hashes.take(pa.array(of))}
    out |= {"line": pa.array(line)}
    out |= {"n": pa.array(sets.n.astype(np.int32)), "key": key, "id": keys[:, 0].view(np.int64)}
    out |= {f"s{i}": pa.array(parity[:, i], mask=~leads) for i in range(4)}
    out = pa.RecordBatch.from_pydict(out | {"prefix": lists})
    return out.filter(pa.array(sets.n > 0)) if join.lines else out


EDGE = "token long, a long, b long, passes boolean, size int"
_POSTING = np.dtype(
    [("token", "u8"), ("row", "i8"), ("part", "i4"), ("line", "i4"), ("id", "i8"), ("n", "u2"), ("at", "u2"),
     ("held", "u4")]
)


def _passes(n_a, n_b, at_a, at_b, join: Join) -> np.ndarray:
    """Length and positional filter. Numbers of 65535 stand for any larger one and pass."""
    n_a, n_b, at_a, at_b = (x.astype(np.int64) for x in (n_a, n_b, at_a, at_b))
    length = join.den * np.minimum(n_a, n_b) >= join.num * np.maximum(n_a, n_b)
    most = np.minimum(n_a - at_a, n_b - at_b)
    place = most * (join.num + join.den) >= join.num * (n_a + n_b)
    return (length & place) | (np.maximum(n_a, n_b) == 65535)


def _leaders(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of postings in order of token: where each token starts, the number of each posting's token,
    and each token's leader, which has the smallest row, then text, then line, then id."""
    new = np.concatenate([[True], p["token"][1:] != p["token"][:-1]])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    first = np.ones(len(p), bool)
    for name in ("row", "part", "line", "id"):
        if np.count_nonzero(first) == len(start):
            break
        value = np.where(first, p[name], np.iinfo(p[name].dtype).max)
        first &= value == np.minimum.reduceat(value, start)[group]
    at = np.flatnonzero(first)
    return start, group, p[at[np.concatenate([[True], group[at][1:] != group[at][:-1]])]]


def _stars(p: np.ndarray, join: Join, last: bool) -> tuple[np.ndarray, pa.RecordBatch]:
    """Postings to send on and edges. A token with more than two classes sends its leader, which
    holds how many postings it speaks for, and has edges to it. With one or two it has edges only
    if these are all the postings there are (``last``); otherwise it sends both classes, since
    others may come from elsewhere and each must then meet their leader."""
    p = p[np.argsort(p["token"])]
    start, group, lead = _leaders(p)
    other = p["id"] != lead["id"][group]
    ends = np.iinfo(np.int64)
    low = np.minimum.reduceat(np.where(other, p["id"], ends.max), start)
    high = np.maximum.reduceat(np.where(other, p["id"], ends.min), start)
    few = (low >= high) & (np.maximum.reduceat(p["held"], start) == 1)
    total = np.where(few, 1 + (low == high), np.add.reduceat(p["held"], start)).astype(np.int32)
    lead["held"] = np.where(few, 1, total)
    send = lead
    if not last:
        second = p[other & few[group]]
        if len(second):
            send = np.concatenate([lead, _leaders(second)[2]])
    m = np.flatnonzero(other if last else other & ~few[group])
    a, b, size = lead[group[m]], p[m], total[group[m]]
    passes = _passes(a["n"], b["n"], a["at"], b["at"], join)
    keep = passes | (size != 2)
    a, b = a[keep], b[keep]
    edges = {"token": a["token"].view(np.int64), "a": a["id"], "b": b["id"]}
    edges |= {"passes": passes[keep], "size": size[keep]}
    return send, pa.RecordBatch.from_pydict({k: np.ascontiguousarray(v) for k, v in edges.items()})


def _pack(p: np.ndarray) -> bytes:
    return b"".join(p[name].tobytes() for name in _POSTING.names)


def _unpack(blob: bytes) -> np.ndarray:
    n, at = len(blob) // _POSTING.itemsize, 0
    out = np.empty(n, _POSTING)
    for name in _POSTING.names:
        kind = _POSTING[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def star_edges(digest: DataFrame, join: Join, name: str) -> DataFrame:
    """Edges from the leader of each prefix token to its other classes, stored.

    A leader is the class with the smallest ``place``. ``passes``: the pair may be similar.
    Pairs that do not pass are kept if their token has more than two classes. ``size`` is 2 only if
    the token has no more than two classes in the whole table.
    """
    digest = digest.where("prefix is not null")
    held = digest.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(_BUCKETS_PER_TASK * tasks(digest.sparkSession), -(-held // _POSTINGS))
    schema = EDGE + ", bucket int, blob binary"
    kinds = pa.schema(
        [("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("passes", pa.bool_()),
         ("size", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())]
    )

    def with_edges(edges: pa.RecordBatch, bucket: int) -> pa.RecordBatch:
        n = len(edges)
        more = [pa.array(np.full(n, bucket, np.int32)), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays([*edges.columns, *more], schema=kinds)

    def emptied(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lead, edges = _stars(np.concatenate(parts), join, last=False)
        to = (lead["token"] % np.uint64(buckets)).astype(np.int64)
        lead = lead[np.argsort(to, kind="stable")]
        ends = np.cumsum(np.bincount(to, minlength=buckets))
        used = np.flatnonzero(np.diff(ends, prepend=0))
        if len(edges):
            yield with_edges(edges, int(used[len(edges) % len(used)]))
        blobs = [_pack(lead[(ends[i - 1] if i else 0) : ends[i]]) for i in used]
        n = len(used)
        columns = [pa.nulls(n, f.type) for f in list(kinds)[:5]]
        columns += [pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, to in W.cuts(_numpy(batch.column("prefix").offsets), _FLUSH // 4):
            yield batch.slice(at, to - at)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for batch in (part for whole in batches for part in cut(whole)):
            lists = batch.column("prefix")
            size = np.diff(_numpy(lists.offsets))
            tokens = _numpy(lists.flatten())
            of = np.repeat(np.arange(len(size)), size)
            p = np.empty(len(tokens), _POSTING)
            p["token"] = tokens.view(np.uint64)
            p["row"] = _numpy(batch.column("row").fill_null(np.iinfo(np.int64).min))[of]
            p["part"] = (_numpy(batch.column("hash")) >> 32)[of]
            p["line"], p["id"] = _numpy(batch.column("line"))[of], _numpy(batch.column("id"))[of]
            p["n"] = np.minimum(_numpy(batch.column("n")), 65535)[of]
            place = np.arange(len(tokens)) - (np.cumsum(size) - size)[of]
            p["at"] = np.minimum(place, 65535) if join.positions else 0
            p["held"] = 1
            parts.append(p)
            total += len(p)
            if total >= _FLUSH:
                yield from emptied(parts)
                parts, total = [], 0
        if total:
            yield from emptied(parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            edges = batch.filter(batch.column("token").is_valid())
            if len(edges):
                yield edges.select(["token", "a", "b", "passes", "size"])
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if blob is not None:
                    parts.setdefault(bucket, []).append(blob)
        while parts:  # a bucket at a time; a token is in one bucket
            blobs = parts.popitem()[1]
            yield _stars(np.concatenate([_unpack(x) for x in blobs]), join, last=True)[1]

    scattered = digest.select("row", "hash", "line", "id", "n", "prefix").mapInArrow(scatter, schema)
    return stored(scattered.repartition(-(-buckets // _BUCKETS_PER_TASK), "bucket").mapInArrow(gather, EDGE), name)


def classes(digest: DataFrame, name: str, *more: Column) -> DataFrame:
    """One row per distinct set that is not empty, with its first ``place`` and ``more``, named
    aggregates of its rows. Stored."""
    first = F.min(place()).alias("first")
    rows = digest.where("n > 0").groupBy("key", "id", "n").agg(first, *more)
    added = rows.columns[4:]
    return stored(rows.select("key", "id", "n", "first.row", "first.hash", "first.line", *added), name)


def picked_lines(texts: DataFrame) -> DataFrame:
    """``id``, ``key`` and ``text`` of the lines that ``picks`` (structs of ``line``, ``id``, ``key``) of
    each row wants. The text is split once a row: its lines are taken in an array function, before
    anything is exploded."""
    lines = texts.select("picks", F.split("text", "\n", -1).alias("lines"))
    taken = F.transform(
        "picks", lambda p: F.struct(p["id"].alias("id"), p["key"].alias("key"), F.get("lines", p["line"]).alias("text"))
    )
    return lines.select(F.inline(taken))


def verified(
    pairs: DataFrame, klass: DataFrame, docs: DataFrame, join: Join, name: str
) -> DataFrame:
    """Of candidate pairs of ids (``a``, ``b``) those that are similar, with the keys ``a_key``
    and ``b_key`` of their sets; stored. Sets are made anew from the whole texts."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name + "-ids")
    n = ids.count()
    wanted = stored(klass.join(sized(ids, 16, n), "id"), name + "-classes")
    held = wanted.count()
    if join.lines:  # a text is cut into lines once, however many of them are wanted
        picks = F.collect_list(F.struct("line", "id", "key")).alias("picks")
        wanted = stored(wanted.groupBy("row", "hash").agg(picks), name + "-wanted")
    wanted = sized(wanted.withColumnsRenamed({"row": "wanted", "hash": "of"}), 72, held)
    same = F.col("row").eqNullSafe(F.col("wanted")) & (F.col("hash") == F.col("of"))
    texts = docs.join(wanted, same)
    if join.lines:
        texts = picked_lines(texts)
    texts = stored(texts.select("id", "key", "text"), name + "-texts")
    if texts.count() > held:  # rows that repeat: one text per class
        texts = stored(texts.dropDuplicates(["id", "key"]), name + "-once")
    # texts go to ``a`` of each pair, where its own text is: each is shuffled once per pair and for ``a`` once
    of_a = pairs.select("a").distinct()
    a = texts.select(F.col("id").alias("a"), F.col("key").alias("a_key"), F.col("text").alias("a_text"))
    b = texts.select(F.col("id").alias("b"), F.col("key").alias("b_key"), F.col("text").alias("b_text"))
    a, b = a.join(sized(of_a, 16, n), "a", "left_semi"), b.join(sized(pairs, 24), "b")
    both = b.join(a, "a").select("a_key", "a_text", "b_key", "b_text")

    def sets(texts: pa.Array, keys: list[bytes]) -> list[np.ndarray | None]:
        out = []
        for at, part in W.slices(texts, W.SMALL):
            w = W.words(part)
            for low, s in distinct(w, join.k):
                found = set_keys(s)
                for i in range(len(s.n)):
                    same = found[i].tobytes() == keys[at + low + i]
                    out.append(s.hash[s.first[i] : s.first[i] + s.n[i]] if same else None)
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = [np.diff(W.ends(whole.column(i).cast(pa.large_string()))) for i in (1, 3)]
            for at, to in W.cuts(np.concatenate([[0], np.cumsum(sizes[0] + sizes[1] + 64)]), W.SMALL):
                batch = whole.slice(at, to - at)
                a_key, b_key = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                x, y = sets(batch.column(1), a_key), sets(batch.column(3), b_key)
                keep = []
                for p, q in zip(x, y):
                    if p is None or q is None:
                        keep.append(False)
                        continue
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    union = len(p) + len(q) - shared
                    keep.append(join.den * shared >= join.num * union)
                yield batch.select(["a_key", "b_key"]).filter(pa.array(keep, pa.bool_()))

    links = both.mapInArrow(check, "a_key binary, b_key binary")
    with small_batches(docs.sparkSession):
        return stored(links.where("a_key != b_key").distinct(), name)


def sketches_differ(a: str, b: str) -> Column:
    """Bits that differ between the parity sketches of two rows."""
    return sum(
        (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(4)),
        F.lit(0),
    )


def may_match(a: str, b: str, join: Join) -> Column:
    """Suffix filter on the whole set: too many differing bits rule a pair out."""
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    # linked: (num + den) * shared >= num * both, and shared = (both - differing) / 2
    return (both - sketches_differ(a, b)) * (join.num + join.den) >= 2 * join.num * both


def by_id(digest: DataFrame) -> DataFrame:
    """Size and sketch of each id."""
    return digest.where("prefix is not null").dropDuplicates(["id"]).select(
        "id", "n", "s0", "s1", "s2", "s3"
    )


def likely_pairs(edges: DataFrame, digest: DataFrame, join: Join, name: str = "likely") -> DataFrame:
    """Distinct pairs of ids whose edges pass all filters. Only the sketches of their ids are looked up."""
    pairs = stored(edges.where("passes").select("a", "b").distinct(), name + "-passing")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), name + "-sketched")
    n = ids.count()
    sketch = stored(by_id(digest.join(sized(ids, 16, n), "id", "left_semi")), name + "-sketches")
    x, y = sized(sketch.alias("x"), 64, n), sized(sketch.alias("y"), 64, n)
    both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    return both.where(may_match("x", "y", join)).select("a", "b")


def open_postings(digest: DataFrame, open_tokens: DataFrame, name: str) -> DataFrame:
    """Postings of the open tokens, once per id: place in the prefix, and up to eight open
    tokens of the id that come earlier; stored."""
    some = digest.where("prefix is not null")
    posts = some.select("id", "n", "s0", "s1", "s2", "s3", F.posexplode("prefix").alias("at", "token"))
    posts = posts.join(sized(open_tokens, 16), "token")
    # equal sets have equal postings: an id's come together once, and give what is earlier too
    one = posts.groupBy("id").agg(
        *[F.first(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")],
        F.sort_array(F.collect_set(F.struct("at", "token"))).alias("held"),
    )
    one = one.withColumn("early", F.slice("held.token", 1, 8))
    each = one.select("id", "n", "s0", "s1", "s2", "s3", "early", F.posexplode("held").alias("nth", "post"))
    before = F.slice("early", F.lit(1), F.least(F.col("nth"), F.lit(8))).alias("before")
    return stored(each.select("post.token", "id", "n", "s0", "s1", "s2", "s3", "post.at", before), name)


def cross_pairs(left: DataFrame, right: DataFrame, differ: Column, join: Join) -> DataFrame:
    """Distinct pairs (``a`` from ``left``, ``b`` from ``right``) of postings that share a token,
    satisfy ``differ`` (on aliases x and y) and pass the filters.

    A pair meets at its first shared open token, or a few times if that is not among the first
    eight of either."""
    x, y = left.alias("x"), right.alias("y")
    low, high = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) if join.positions else low
    both = F.col("x.n") + F.col("y.n")
    on = (F.col("x.token") == F.col("y.token")) & differ
    on &= low * join.den >= high * join.num
    on &= most * (join.num + join.den) >= both * join.num
    on &= may_match("x", "y", join) & ~F.arrays_overlap("x.before", "y.before")
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
