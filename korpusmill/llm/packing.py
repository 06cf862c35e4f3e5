"""Best-fit packing of tokenised documents into fixed-length sequences, by linear grouping.

1. Tokenise (byte-level BPE, end id appended). Only a document above the capacity is cut, its first piece taking the remainder.
2. Count pieces per length: the packing problem is that histogram, at most ``CAPACITY`` rows, whatever the corpus's size.
3. Plan on the driver. The large lengths, in descending order, form groups of equal cardinality and are rounded up to their group's
   longest. Column generation optimises how often each configuration of these few sizes is used. Actual lengths are then substituted into
   the configurations, and whatever is left, the small ones above all, goes by best fit into the space that remains. The plan is a
   list of runs: ``n`` pieces of one length, from rank ``first`` on, go to the sequences ``base, base + 1, ...`` at one offset.
4. Rank each piece among those of its length (counts per bucket, then ranks in a bucket) and look its place up in the plan.

Defined results: a null or empty text is one piece, the end id; repeated rows are packed each; equal pieces are interchangeable;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.common import stored

CAPACITY = 2048
END_ID = 0
#: Shares of the capacity from which on a length counts as large, and numbers of groups; the plan with the fewest sequences is taken.
LARGE = (0.25, 0.35, 0.45)
GROUPS = (64, 128)
#: Rows of one length that are ranked together, about.
ROWS_PER_BUCKET = 1_000


# ---- tokens ----


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def encoder(path: str):
    """An encoder with the vocabulary file's ids. Ids of a byte-level BPE vocabulary are its merge ranks, so tiktoken gives the ids that
    the tokenizers library gives, several times as fast; a probe is compared whenever a worker loads it. Special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"] for t in model.get("added_tokens", ())}
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    probe = "It's 12 o'clock,\n\n  größer  ñandú — 日本語 <|endoftext|>\t!?"
    if fast.encode_ordinary(probe) != slow.encode(probe, add_special_tokens=False).ids:
        raise RuntimeError(f"{path} is not a byte-level BPE vocabulary whose ids are ranks")
    return fast


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                ids = np.append(enc.encode_to_numpy(t.as_py(), disallowed_special=()), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, s in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[s : first if k == 0 else s + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---- plan ----


@dataclass
class Run:
    """count sequences from base on; each has used places and the lengths in them don't matter any more."""

    base: int
    count: int
    used: int


@dataclass
class Plan:
    """Parallel arrays, ordered by (length, first): pieces of a length with ranks from first on go to sequences from base on, at offset."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.first, (length << 44) + rank, "right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


class Packer:
    """Hands out ranks of each length and sequence numbers, and notes the runs."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.given = dict(counts), defaultdict(int)
        self.capacity, self.sequences, self.notes = capacity, 0, []

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, base: int, offset: int) -> None:
        self.notes.append((length, self.given[length], base, offset))
        self.given[length] += n
        self.left[length] -= n

    def plan(self) -> Plan:
        rows = np.array(sorted(self.notes), np.int64).reshape(-1, 4)
        return Plan(*rows.T, self.sequences)


def grouped(counts: dict[int, int], large: list[int], groups: int) -> list[list[tuple[int, int]]]:
    """Groups of equal cardinality of the large pieces in descending order, each a list of (length, how many)."""
    total = sum(counts[x] for x in large)
    size = max(1, -(-total // groups))
    out, room = [[]], size
    for x in large:
        n = counts[x]
        while n:
            if not room:
                out.append([])
                room = size
            k = min(n, room)
            out[-1].append((x, k))
            n, room = n - k, room - k
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of the rounded sizes and how often to use each (rounded down): Gilmore and Gomory's column generation."""
    g = len(sizes)
    fits = capacity // sizes
    basis, x = np.diag(fits.astype(float)), demand / fits
    most = int(capacity // sizes.min())
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(g))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            options = np.full((g, capacity + 1), -1.0)
            for i, s in enumerate(sizes):
                options[i, s:] = price[i] + best[: capacity + 1 - s]
            pick = options.argmax(axis=0)
            value = options[pick, np.arange(capacity + 1)]
            pick[value <= best + 1e-12] = -1
            best = np.maximum(best, value)
            picks.append(pick)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(g), capacity
        for pick in reversed(picks):
            if pick[room] >= 0:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        d = np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    return [(basis[:, k].astype(int), int(x[k] + 1e-9)) for k in range(g) if x[k] >= 1]


def substitute(packer: Packer, groups: list[list[tuple[int, int]]], used: list[tuple[np.ndarray, int]]) -> list[Run]:
    """Actual lengths for the rounded ones: each place of a configuration takes the next pieces of its group."""
    stock = [[list(x) for x in reversed(g)] for g in groups]  # the longest are at the end
    runs = []
    for config, times in used:
        slots = [k for k in np.argsort(-config, kind="stable") for _ in range(config[k])]
        while times:
            if any(sum(n for _, n in stock[k]) < slots.count(k) for k in set(slots)):
                break
            tops = defaultdict(list)
            for k in slots:
                tops[k].append(None)
            # one piece each, from the longest on; how often that can be repeated follows from the shortest stock
            take: dict[tuple[int, int], int] = defaultdict(int)
            for k, places in tops.items():
                need, at = len(places), len(stock[k]) - 1
                while need:
                    n = min(need, stock[k][at][1])
                    take[k, at] += n
                    need, at = need - n, at - 1
            repeat = min(times, *(stock[k][at][1] // n for (k, at), n in take.items()))
            base, offset = packer.open(repeat), 0
            for (k, at), n in take.items():
                length = stock[k][at][0]
                stock[k][at][1] -= n * repeat
                for _ in range(n):
                    packer.put(length, repeat, base, offset)
                    offset += length
            for k in tops:
                stock[k] = [s for s in stock[k] if s[1]]
            runs.append(Run(base, repeat, offset))
            times -= repeat
    return runs


def best_fit(packer: Packer, runs: list[Run]) -> None:
    """The remaining pieces, longest first, into the fullest sequences that have room; then into new ones."""
    by_room = defaultdict(list)
    for r in runs:
        by_room[packer.capacity - r.used].append(r)
    for length in sorted((x for x, n in packer.left.items() if n), reverse=True):
        for room in sorted(x for x in by_room if x >= length):
            each = room // length
            waiting, by_room[room] = by_room[room], []
            for r in waiting:
                while r and packer.left[length]:
                    k = min(each, packer.left[length])
                    n = min(r.count, packer.left[length] // k)
                    for j in range(k):
                        packer.put(length, n, r.base, r.used + j * length)
                    by_room[room - k * length].append(Run(r.base, n, r.used + k * length))
                    r = Run(r.base + n, r.count - n, r.used) if r.count > n else None
                if r:
                    by_room[room].append(r)
            if not packer.left[length]:
                break
        while packer.left[length]:
            k = min(packer.capacity // length, packer.left[length])
            n = packer.left[length] // k
            base = packer.open(n)
            for j in range(k):
                packer.put(length, n, base, j * length)
            by_room[packer.capacity - k * length].append(Run(base, n, k * length))


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, share: float = 0.45, groups: int = 128) -> Plan:
    packer = Packer(counts, capacity)
    if counts.get(capacity):
        packer.put(capacity, counts[capacity], packer.open(counts[capacity]), 0)
    large = sorted((x for x, n in counts.items() if n and capacity * share <= x < capacity), reverse=True)
    runs: list[Run] = []
    if large:
        parts = grouped(counts, large, groups)
        top = [g[0][0] for g in parts]
        sizes = sorted(set(top), reverse=True)
        merged = [[p for g, t in zip(parts, top) if t == s for p in g] for s in sizes]  # groups that round to one size are one
        demand = np.array([sum(n for _, n in g) for g in merged], float)
        runs = substitute(packer, merged, configurations(np.array(sizes), demand, capacity))
    best_fit(packer, runs)
    return packer.plan()


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    return min((make_plan(counts, capacity, s, g) for s in LARGE for g in GROUPS), key=lambda p: p.sequences)


# ---- placing ----


def place(pieces: DataFrame, plan: Plan, most: int) -> DataFrame:
    """The pieces with sequence_id and offset; the most frequent length has most pieces."""
    buckets = most // ROWS_PER_BUCKET + 1
    cell = ["length", "_bucket"]
    p = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = p.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    order = ["doc_id", "piece", "ids_crc32", "start"]
    ranked = p.join(before, cell).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, offset = plan.place(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ranked.select(*names, "_rank").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    pieces = stored(token_pieces(docs, vocabulary, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(pieces, best_plan(counts, capacity), max(counts.values(), default=0))
