"""Removal of every byte that a repeated 200-byte string covers, by merging Burrows-Wheeler transforms.

1. Each text's windows of ``LENGTH`` bytes are grouped into runs by content-defined anchors (see anchors.py); equal windows meet under one anchor. Equal runs
   of a batch collapse into one of weight two before anything is shuffled; their texts' bytes are covered.
2. By anchor, equal runs collapse again, into strings. An anchor of one string alone has nothing else that is repeated.
3. The other anchors' strings are sharded by their texts. Each shard gets its own Burrows-Wheeler transform, with the common prefixes of neighbouring
   suffixes (``Transform``). The transforms are merged by iterative interleave refinement (``merge_transforms``): the suffixes of all shards stand in one
   sequence, each shard's in its own order, cut into intervals of equal prefixes. A step takes the symbols that precede the suffixes from the transforms' columns and
   partitions each interval stably by them (one of a single symbol stays as it stands), which moves every suffix back by one symbol; so after h steps an interval holds the
   suffixes with a common prefix of h symbols. An interval of one shard needs no more steps, as the shard's own common prefixes tell the rest. No suffix is sorted again.
4. The repeated intervals at ``LENGTH`` bytes, of the merged transforms and inside the shards, give byte ranges, which are joined up and cut out.

An anchor with more than ``HEAVY`` strings is not merged at once: its strings are grouped anew by anchors of another order, up to ``LEVELS`` times.

A transform of the whole corpus would need a shuffle of all suffixes for each step; so the merge runs side by side for sets of anchors, which share no window.

Defined results: a null or empty text has nothing to remove; matches never cross texts; repeated rows are copies, so texts of 200 bytes or more
vanish from all of them; a text is judged on the input; an empty table gives an empty result; extra columns are ignored by the report. Runs count as equal if their
anchors, lengths, anchors' places and two unlike 64-bit hashes of their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.llm.anchors import LENGTH, Runs, Tables, find_runs
from korpusmill.llm.arrow import slices, utf8
from korpusmill.llm.common import batches_of, drop, free_name, listed, quoted, stored, with_row
from korpusmill.llm.hashing import mix
from korpusmill.llm.jaccard import whole_groups

SYMBOL = 2  # bytes
ARROW_BATCH = "8m"
#: Bytes of strings that are merged together, about; an anchor's stay together. Shards into which their texts are dealt.
MERGED_BYTES, SHARDS = 200_000, 4
#: Strings of an anchor that are merged at once, and how often the strings of one with more are grouped anew.
HEAVY, LEVELS = 4000, 4


# ---- runs ----


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before in all columns."""
    out = np.ones(len(columns[0]), bool)
    out[:1] = False
    for c in columns:
        out[1:] &= c[1:] == c[:-1]
    return out


def joined(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges, sorted by text and start, with those of one text joined up where they touch."""
    if not len(text):
        return text, start, end
    far = 1 + int(end.max())
    reach = np.maximum.accumulate(text * far + end) - text * far
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] > reach[:-1])]
    return text[new], start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(text) - 1]]


def collapse(r: Runs, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run of each kind of equal ones and its weight (up to 2); and the places of all runs that weigh 2 together but not alone."""
    order = np.lexsort((r.content, r.check, r.anchor))
    new = ~same_as_before(r.anchor[order], r.check[order], r.content[order])
    kind = np.cumsum(new) - 1
    total = np.bincount(kind, weights=weight[order])
    return order[new], np.minimum(total, 2).astype(np.int32), order[(total[kind] >= 2) & (weight[order] < 2)]


RUN = "anchor bigint, content bigint, check bigint, row {row}, start bigint, windows int, place int, weight int"


def as_runs(r: Runs, rows: pa.Array, start: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """The runs of a batch as rows of RUN, equal ones collapsed. Place -1 marks ranges of covered bytes, with start and windows as their begin and length."""
    one, total, known = collapse(r, weight)
    order = known[np.lexsort((start[known], r.text[known]))]
    text, begin, end = joined(r.text[order], start[order], start[order] + r.windows[order] + LENGTH - 1)
    spread = mix(begin.astype(np.uint64) + text.astype(np.uint64) * np.uint64(LENGTH))  # anywhere: covered ranges need no meeting
    none = np.zeros(len(text), np.int64)
    columns = [np.concatenate(c) for c in ((r.anchor[one].view(np.int64), spread.view(np.int64)), (r.content[one].view(np.int64), none), (r.check[one].view(np.int64), none), (r.text[one], text), (start[one], begin), (r.windows[one], end - begin), (r.place[one], none - 1), (total, none + 2))]
    kinds = [np.int64, np.int64, np.int64, None, np.int64, np.int32, np.int32, np.int32]
    return pa.RecordBatch.from_arrays([rows.take(pa.array(c)) if k is None else pa.array(c.astype(k)) for c, k in zip(columns, kinds)], names=["anchor", "content", "check", "row", "start", "windows", "place", "weight"])


def runs(texts: DataFrame) -> DataFrame:
    """RUN rows of texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables()
        for whole in batches:
            for b in slices(whole, "text", 1 << 19):
                for r in find_runs(*utf8(b.column("text")), tables):
                    yield as_runs(r, b.column("row"), r.start, np.ones(len(r.start), np.int64))

    return texts.mapInArrow(run, RUN.format(row=texts.schema["row"].dataType.simpleString()))


def regrouped(strings: DataFrame, level: int) -> DataFrame:
    """RUN rows of strings (anchor, row, start, windows, place, weight, bytes), by anchors of another order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(level)
        for whole in batches:
            for b in slices(whole, "bytes", 1 << 19):
                begin, weight, above = (b.column(c).to_numpy() for c in ("start", "weight", "anchor"))
                for r in find_runs(*utf8(b.column("bytes")), tables):
                    r.anchor = mix(r.anchor + above[r.text].view(np.uint64))  # windows of two anchors stay apart
                    yield as_runs(r, b.column("row"), begin[r.text] + r.start, weight[r.text].astype(np.int64))

    return strings.mapInArrow(run, RUN.format(row=strings.schema["row"].dataType.simpleString()))


def strings_of(found: DataFrame) -> DataFrame:
    """Covered ranges (place -1), and one run for each string of the anchors that have several, with its weight (up to 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["anchor"]):
            place = t.column("place").to_numpy()
            known = np.flatnonzero(place < 0)
            at = np.flatnonzero(place >= 0)
            c = {k: t.column(k).to_numpy()[at] for k in t.column_names if k != "row"}
            new = ~same_as_before(c["anchor"])
            other = ~same_as_before(c["anchor"], c["check"], c["content"])
            group, string = np.cumsum(new) - 1, np.cumsum(other) - 1
            total = np.bincount(string, weights=c["weight"])
            sure = np.flatnonzero((total[string] >= 2) & (c["weight"] < 2))
            mixed = np.flatnonzero((np.bincount(group[other]) >= 2)[group] & other) if len(at) else at
            take = np.concatenate([known, at[sure], at[mixed]])
            out = t.select(["anchor", "row", "start", "windows", "place", "weight"]).take(pa.array(take)).combine_chunks()
            n, m = len(known), len(sure)
            size, place = out.column("windows").to_numpy().copy(), out.column("place").to_numpy().copy()
            weight = np.concatenate([np.full(n + m, 2), np.minimum(total[string[mixed]], 2)])
            size[n : n + m] += LENGTH - 1
            place[n : n + m] = -1
            yield from pa.table([out.column("anchor"), out.column("row"), out.column("start"), pa.array(size), pa.array(place), pa.array(weight.astype(np.int32))], names=["anchor", "row", "start", "windows", "place", "weight"]).to_batches()

    kind = found.schema["row"].dataType.simpleString()
    return found.repartition("anchor").sortWithinPartitions("anchor", "check", "content").mapInArrow(run, f"anchor bigint, row {kind}, start bigint, windows int, place int, weight int")


# ---- transforms ----


def radix_order(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 to 2**32 - 1, by 16 bits at a time."""
    low = np.argsort(x.astype(np.uint16), kind="stable")
    return low if not len(x) or x.max() < 1 << 16 else low[np.argsort((x[low] >> 16).astype(np.uint16), kind="stable")]


def numbered(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the distinct rows of the columns, of which order is the order."""
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(~same_as_before(*(c[order] for c in columns)))
    return out


@dataclass
class Transform:
    """The Burrows-Wheeler transform of one shard's strings. Parallel arrays by rank, for the suffixes in order of their first 2 * DEPTH symbols (a string's end sorts
    before all bytes): order, where the suffix starts; column, the SYMBOL bytes before it; back, the rank of the suffix that starts there;
    common, the length of the prefix that it shares with the suffix before it (an end is a symbol too), 2 * DEPTH - 1 at most. rank is the inverse of order."""

    order: np.ndarray
    rank: np.ndarray
    column: np.ndarray
    back: np.ndarray
    common: np.ndarray

    DEPTH = 128

    @classmethod
    def of(cls, data: np.ndarray, ends: np.ndarray) -> Transform:
        """data: the strings one after the other; ends: where each ends. A string's end is a suffix too, so positions count one more for each string before."""
        text = np.ones(len(data) + len(ends), np.int64)
        mark = np.zeros(len(text), bool)
        mark[ends + np.arange(len(ends))] = True
        text[~mark] = data.astype(np.int64) + 2
        n, code = len(text), np.cumsum(np.bincount(text, minlength=258) > 0)
        now = code[text]
        key = now * (code[-1] + 1) + np.append(now[1:], 0)
        order, tables, d = radix_order(key), [(1, now)], 2
        now = numbered(order, key)
        while True:
            tables.append((d, now))
            later = order - d  # these suffixes stand in order of what follows their first d symbols; for the last d nothing follows
            later = np.concatenate([np.arange(max(n - d, 0), n), later[later >= 0]])
            order = later[radix_order(now[later])]
            if d == cls.DEPTH:
                break
            now, d = numbered(order, now, np.append(now[d:], np.zeros(min(d, n), now.dtype))), 2 * d
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        common = np.zeros(n, np.int64)
        for depth, table in reversed(tables):
            wide = np.append(table, np.zeros(2 * cls.DEPTH, table.dtype))
            a, b = wide[order[1:] + common[1:]], wide[order[:-1] + common[1:]]
            common[1:] += depth * ((a == b) & (a > 0))
        before = order - SYMBOL
        wide = np.concatenate([text, np.zeros(SYMBOL, np.int64)])
        column = (np.maximum(wide[before], 2) - 2) << 8 | (np.maximum(wide[before + 1], 2) - 2)
        return cls(order, rank, column.astype(np.uint16), rank[before], common)

    def repeated(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Which of the suffixes at starts have a prefix of this length in common with another of them."""
        chosen = np.zeros(len(self.order), bool)
        chosen[self.rank[starts]] = True
        interval = np.cumsum(self.common < length) - 1
        many = np.bincount(interval, weights=chosen) >= 2
        return many[interval[self.rank[starts]]]


def merge_transforms(shards: list[Transform], rank: np.ndarray, shard: np.ndarray, interval: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Interleave refinement. Elements are windows: rank and shard of the suffix at each one's end, and the interval outside which it has no equal. Returns
    which windows have equals in another shard, that is, whose intervals after all steps hold several shards."""
    base = np.cumsum([0] + [len(s.order) for s in shards])
    column = np.concatenate([s.column for s in shards])
    back = np.concatenate([s.back + b for s, b in zip(shards, base)])
    out = np.zeros(len(rank), bool)
    left = radix_order(rank)
    for by in (shard, interval):  # the shards one after the other, each in its own order
        left = left[radix_order(by[left])]
    now, of, cut = rank[left] + base[shard[left]], shard[left], ~same_as_before(interval[left])
    number, at = np.cumsum(cut) - 1, np.arange(len(left))
    for step in range(length // SYMBOL + 1):
        if step:
            symbol, now = column[now], back[now]
            parted = np.flatnonzero((symbol[1:] != symbol[:-1]) & ~cut[1:])
            if not len(parted):
                continue
            several = np.zeros(number[-1] + 1, bool)
            several[number[parted]] = True
            at = np.flatnonzero(several[number])  # an interval of one symbol stays as it is
            key = number[at] << 16 | symbol[at]
            order = np.argsort(key, kind="stable")
            left[at], now[at], of[at] = left[at][order], now[at][order], of[at][order]
            cut[at] = ~same_as_before(key[order])
        first = np.flatnonzero(cut[at])
        mixed = np.minimum.reduceat(of[at], first) != np.maximum.reduceat(of[at], first) if len(first) else np.zeros(0, bool)
        keep = np.ones(len(left), bool)
        keep[at] = np.repeat(mixed, np.diff(np.append(first, len(at))))
        left, now, of, cut = left[keep], now[keep], of[keep], cut[keep]
        if not len(left):
            break
        number = np.cumsum(cut) - 1
    out[left] = True
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray, windows: np.ndarray, shard: np.ndarray, interval: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows have an equal one. windows[i] start at each string's first bytes; shard is by string, interval by window, in order of string and start."""
    string = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = np.zeros(len(string), bool)
    numbers, of = np.unique(shard, return_inverse=True)
    transforms, rank = [], np.zeros(len(string), np.int64)
    for k in range(len(numbers)):
        mine = np.flatnonzero(of == k)
        size = np.diff(offsets)[mine]
        own = Transform.of(np.concatenate([data[offsets[s] : offsets[s + 1]] for s in mine]), np.cumsum(size))
        begin = np.zeros(len(windows), np.int64)
        begin[mine] = np.cumsum(size) - size + np.arange(len(mine))
        at = np.flatnonzero(of[string] == k)
        start = begin[string[at]] + nth[at]
        hit[at] = own.repeated(start, length)
        rank[at] = own.rank[start + length]
        transforms.append(own)
    if len(transforms) > 1:
        hit |= merge_transforms(transforms, rank, of[string], interval, length)
    return hit


def merged_together(anchor: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the stretches of strings, sorted by anchor, that are merged at once: MERGED_BYTES at most, or one anchor."""
    edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    upto = np.r_[0, np.cumsum(size)][edges]
    at = 0
    while at < len(edges) - 1:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + MERGED_BYTES, "right")) - 1)
        yield int(edges[at]), int(edges[to])
        at = to


def merge(strings: DataFrame) -> DataFrame:
    """row, start, length of the byte ranges that repeated windows cover, of strings (anchor, row, start, windows, place, weight, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, ["anchor"]):
            size = whole.column("windows").to_numpy().astype(np.int64) + LENGTH  # with the string's end
            for begin, end in merged_together(whole.column("anchor").to_numpy(), size):
                yield part(whole.slice(begin, end - begin))

    def part(t: pa.Table) -> pa.RecordBatch:
        c = {k: t.column(k).to_numpy().astype(np.int64) for k in ("anchor", "start", "windows", "place", "weight", "shard")}
        data, offsets = utf8(t.column("bytes"))
        string = np.repeat(np.arange(len(c["start"])), c["windows"])
        nth = np.arange(len(string)) - np.repeat(np.cumsum(c["windows"]) - c["windows"], c["windows"])
        group = np.cumsum(~same_as_before(c["anchor"])) - 1
        interval = group[string] * LENGTH + c["place"][string] - nth  # equal windows have their anchor at one place
        hit = np.flatnonzero(repeated_windows(data, offsets, c["windows"], c["shard"], interval) & (c["weight"][string] < 2))  # the others are known already
        text, begin, end = joined(string[hit], nth[hit], nth[hit] + LENGTH)
        return pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(pa.array(text)), pa.array(c["start"][text] + begin), pa.array(end - begin)], names=["row", "start", "length"])

    kind = strings.schema["row"].dataType.simpleString()
    sharded = strings.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(SHARDS)).cast("int"))
    return sharded.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, f"row {kind}, start bigint, length bigint")


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """row and ranges (sorted array of start, end) of the covered bytes of texts (row, text binary), stored."""
    with batches_of(texts.sparkSession, ARROW_BATCH):
        found, tables, covered = runs(texts), [], []
        for level in range(1, LEVELS + 2):
            known = stored(strings_of(found))
            tables.append(known)
            covered.append(known.where("place < 0").select("row", "start", F.col("windows").cast("bigint").alias("length")))
            open_runs = known.where("place >= 0")
            rows = stored(open_runs.select("row").distinct())
            with_text = texts.join(listed(rows), "row", "left_semi").join(open_runs, "row")
            strings = with_text.select("anchor", "row", "start", "windows", "place", "weight", F.expr(f"substring(text, cast(start + 1 as int), windows + {LENGTH - 1})").alias("bytes"))
            heavy = open_runs.groupBy("anchor").count().where(F.col("count") > HEAVY).select("anchor")
            tables.append(rows)
            if level > LEVELS or heavy.isEmpty():
                covered.append(merge(strings))
                break
            heavy = stored(heavy)
            tables.append(heavy)
            covered.append(merge(strings.join(heavy, "anchor", "left_anti")))
            found = regrouped(strings.join(heavy, "anchor", "left_semi"), level)
        every = covered[0]
        for c in covered[1:]:
            every = every.unionByName(c)
        out = stored(every.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("ranges")))
        drop(*tables)
        return out


def cut_out(text: bytes, ranges: list[dict]) -> tuple[bytes, int, int]:
    """What remains of the text, the bytes removed and the removed stretches; ranges ascend by start and may overlap."""
    start = np.array([r["start"] for r in ranges], np.int64)
    end = np.maximum.accumulate(np.array([r["end"] for r in ranges], np.int64))
    new = np.r_[True, start[1:] > end[:-1]]
    a, b = start[new], np.r_[end[:-1][new[1:]], end[-1]]
    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
    return kept, len(text) - len(kept), len(a)


def strip_repeats(docs: DataFrame, valid: bool = False) -> DataFrame:
    """doc (a struct of the columns of docs other than text: c0, c1, ...), n_bytes, n_removed, n_spans, kept (binary): each text without its repeated bytes.
    valid drops from kept the bytes of a character that was cut apart."""
    name, text = free_name(docs, "row"), F.coalesce("text", F.lit("")).cast("binary")
    keyed = with_row(docs, name)
    ranges = repeated_ranges(keyed.select(F.col(name).alias("row"), text.alias("text")))
    others = [F.col(q).alias(f"c{i}") for i, q in enumerate(quoted([c for c in docs.columns if c != "text"]))]
    packed = keyed.select(F.col(name).alias("row"), F.struct(*others, F.lit(0).alias("none")).alias("doc"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                found = [cut_out(t.as_buffer().to_pybytes(), r.as_py()) for t, r in zip(b.column("text"), b.column("ranges"))]
                if valid:
                    found = [(k.decode("utf-8", "ignore").encode(), *counts) for k, *counts in found]
                yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.diff(utf8(b.column("text"))[1])), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = listed(stored(ranges.select("row")))
    hit = packed.join(rows, "row", "left_semi").join(ranges, "row").select("doc", "text", "ranges")
    schema = T.StructType([packed.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    none = F.lit(0).cast("bigint")
    rest = packed.join(rows, "row", "left_anti").select("doc", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").alias("kept"))
    return hit.mapInArrow(run, schema).unionByName(rest)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    return strip_repeats(docs.select("doc_id", "text")).select(F.col("doc.c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with the kept bytes as their text (a character that is cut apart goes) and n_chars to match."""
    text = F.col("kept").cast("string")
    swap = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    others = [c for c in docs.columns if c != "text"]
    return strip_repeats(docs, valid=True).select(*[(swap[c] if c in swap else F.col("doc")[f"c{others.index(c)}"]).alias(c) for c in docs.columns])
