"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

1. Each whole text becomes a sorted array of shingle hashes. Equal sets form a class; only classes are compared.
2. Two sets that link share a shingle among the first quarter (plus one) of each, in any one order of all shingles. The order puts the shingles that
   many documents share last (counted over all documents, per batch; it decides speed, not results), then goes by hash. A tile is the classes that share such
   a shingle; only sizes within 0.75 of one another meet.
3. A tile of up to ``SMALL`` classes gives all its pairs, and how many tiles each pair shares: what two sets have in common beyond their prefixes is
   at most the rest of the larger, so a pair that shares too few tiles is out before anything else of it is read.
4. Larger tiles are cut into size bands (a factor of 4/3 each; two sets that link are in one band or in neighbours) and carry hashed bitmaps of parities. The pairs
   of a tile (key, band) are bounded from above inside its task: a bit that differs is a shingle, at least, that one of the two lacks. Blocks of a tile meet
   two by two, in tasks of their own. Of the tiles that two classes share, only the first one asked gives their pair, so that a group that shares many
   shingles gives its pairs once and not once for each. Of each class ``LIMIT`` pairs with classes before it come first, from the first of its tiles, then from all tiles that
   still hold several components; those that held more pairs give ``MORE`` times as many each time, until none is left over.
5. Pairs within the bound are decided by exact intersection of the sorted arrays: first one of each class, then those that still join two components.
6. Connected components of the links give each document the smallest doc_id that it reaches. Once two classes are in one component, further
   links between them change nothing, so none is lost by leaving them out.

Keys of the shingles that go last are salted before the first shuffle, and a tile that grows beyond ``SMALL`` is passed on as it is read, so that no task holds a
tile. Consumed tables are deleted on the way.

Defined results: a null or empty text, or one without words, has no shingles and is alone; a null doc_id is never a component's id
unless all are null; repeated rows are copies; an empty table gives an empty result; extra columns are ignored. Classes are
told apart by 64 bits of a hash of their set, shingles by 64 bits of theirs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from korpusmill.llm.arrow import give_back, slices, utf8
from korpusmill.llm.common import batches_of, drop, free_name, listed, quoted, release, stored, with_row
from korpusmill.llm.components import connected
from korpusmill.llm.hashing import Powers
from korpusmill.llm.shingles import shingle_sets

#: Similarity in hundredths.
ALIKE = 75
SMALL = 32
#: Pairs of a class that a tile gives at first, and by how much more each time.
LIMIT, MORE = 2, 64
#: Members of a block, and bytes of its bitmaps, at most about.
BLOCK, BLOCK_BYTES = 2000, 16 << 20
#: Bitmaps that are compared with one at a time.
AT_ONCE = 512
#: Shingles that go last in the order, at most (400 KB for each worker). The rows of those that this many documents share are dealt into so many parts.
HOT, WIDELY, SALTS = 50_000, 1000, 64
BATCH_BYTES, ARROW_BATCH = 2 << 20, "8m"


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The smallest intersection at which sets of these sizes link."""
    return -(-ALIKE * (na + nb) // (100 + ALIKE))


def words_of(n: int) -> int:
    """64-bit words of the bitmap of n shingles, four at least."""
    return 1 << max(2, int(n - 1).bit_length() + 1 - 6)


def bitmap(shingles: np.ndarray) -> bytes:
    """2 to 4 bits for each shingle, at a power of two of 64-bit words: whether the shingles hashed there are an odd number. Those that two sets share cancel out between their
    bitmaps, so that few bits tell more than marks of what is there would. Folding halves gives the bitmap of half the size. Compressed where that is shorter."""
    words = words_of(len(shingles))
    at = (shingles >> np.uint64(20)).astype(np.int64) & (words * 64 - 1)
    plain = np.packbits((np.bincount(at, minlength=words * 64) & 1).astype(np.uint8), bitorder="little").tobytes()
    return min(plain, pa.compress(plain, codec="zstd", asbytes=True), key=len)


def unpacked(bits: pa.Buffer, n: int) -> np.ndarray:
    """bitmap() of n shingles as a row of words."""
    size = 8 * words_of(n)
    return np.frombuffer(bits if len(bits) == size else pa.decompress(bits, size, codec="zstd"), np.uint64)[None]


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, more words) as bitmaps of fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def within_bound(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether bitmaps a and b (rows of equally many words) leave room for enough common shingles."""
    unlike = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return na + nb - unlike >= 2 * needed(na, nb)


# ---- sets ----


def sets_of(batch: pa.RecordBatch, tables: Powers) -> list[np.ndarray]:
    return shingle_sets(*utf8(batch.column("text")), tables)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def describe(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n, class) of each row of keyed (row, doc_id, text), stored; and (key, times) of the shingles that documents of one batch share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                found = sets_of(b, tables)
                every = np.sort(np.concatenate(found))
                same = every[1:] == every[:-1]
                key, times = np.unique(every[1:][same], return_counts=True)
                none = lambda kind: pa.nulls(len(key), kind)  # noqa: B023,E731
                mine = [b.column("row"), b.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([class_of(s) if len(s) else None for s in found], pa.int64())]
                shared = [pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(x)]) for x in (key.view(np.int64), times + 1)]
                yield pa.RecordBatch.from_arrays([*(pa.concat_arrays([x, none(x.type)]) for x in mine), *shared], names=["row", "doc_id", "n", "class", "key", "times"])

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    both = stored(keyed.select("row", "doc_id", "text").mapInArrow(run, f"row {kinds['row']}, doc_id {kinds['doc_id']}, n bigint, class bigint, key bigint, times bigint"))
    described = both.where("row is not null").drop("key", "times")
    described._stored_at = both._stored_at
    return described, both.where("row is null").select("key", "times")


def bitmaps(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """class, n, bits of the listed rows of keyed, stored. Only these are made: most classes are in no tile, and the bitmaps of all would lie beside the shuffled prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                found = sets_of(b, tables)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([bitmap(s) for s in found], pa.binary())], names=["class", "n", "bits"])

    return stored(keyed.join(listed(rows), "row", "left_semi").select("text").mapInArrow(run, "class bigint, n bigint, bits binary"))


def hot_shingles(shared: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most widely shared shingles, sorted, and which of them WIDELY documents share: of whole count buckets of 10 % width, so nothing has to be sorted on the way."""
    total = stored(shared.groupBy("key").agg(F.sum("times").alias("times")).where("times >= 8"))
    bucket = F.floor(F.log(F.col("times").cast("double")) / float(np.log(1.1)))
    room, least = most, None
    for b, n in sorted(((r["b"], r["n"]) for r in total.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, b
    rows = total.where(bucket >= least).collect() if least is not None else []
    drop(total)
    key, times = np.array([r["key"] for r in rows], np.int64).view(np.uint64), np.array([r["times"] for r in rows], np.int64)
    order = np.argsort(key)
    return key[order], times[order] >= WIDELY


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def prefixes(keyed: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, class, n, salt: for each class the shingles of which a linked class shares one. A task gives a class once. Widely shared ones have a salt above 0."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, (last, widely), seen = Powers(), shared.value, set()
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                found = []
                for s in sets_of(b, tables):
                    if len(s) and (c := class_of(s)) not in seen:
                        seen.add(c)
                        found.append((s, c))
                if len(seen) > 1_000_000:
                    seen.clear()
                if not found:
                    continue
                late = is_in(np.concatenate([s for s, _ in found]), last)
                edges = np.cumsum([0] + [len(s) for s, _ in found])
                keys, salts = [], []
                for (s, c), x, y in zip(found, edges[:-1].tolist(), edges[1:].tolist()):
                    p, mask = len(s) // 4 + 1, late[x:y]
                    if mask[:p].any():
                        cold, warm = s[~mask][:p], s[mask]
                        warm = warm[: p - len(cold)]
                        s = np.concatenate([cold, warm])
                        salts.append(np.concatenate([np.zeros(len(cold), np.int64), np.where(widely[np.searchsorted(last, warm)], 1 + c % SALTS, 0)]))
                    else:
                        s = s[:p]
                        salts.append(np.zeros(p, np.int64))
                    keys.append(s)
                n = [len(k) for k in keys]
                columns = (np.concatenate(keys).view(np.int64), np.repeat(np.array([c for _, c in found], np.int64), n), np.repeat(np.diff(edges).astype(np.int32), n), np.concatenate(salts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "class", "n", "salt"])

    return keyed.select("text").mapInArrow(run, "key bigint, class bigint, n int, salt int")  # the many zeros side by side, at the end: an eighth less is shuffled


# ---- tiles ----


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Batches of sorted rows, dealt anew so that no group is split."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        change = np.zeros(b.num_rows, bool)
        for c in by:
            x = t.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= x[0] != held[-1].column(c)[-1].as_py()
        at = np.flatnonzero(change)
        if not len(at):
            held.append(t)
            continue
        done = [*held, t.slice(0, at[-1])]
        if any(x.num_rows for x in done):
            yield pa.concat_tables(done).combine_chunks()
        held = [t.slice(at[-1])]
    if held:
        yield pa.concat_tables(held).combine_chunks()
        held.clear()
    give_back()


def distinct_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, where each occurs first, and how often."""
    x, y = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)])
    return x[first], y[first], order[first], np.diff(np.r_[first, len(x)])


def tile_pairs(rows: DataFrame) -> DataFrame:
    """a, b, na, nb, times (key null): pairs of tiles of up to SMALL classes, a < b, and in how many of a batch's tiles they are; and key, a, na (b null): the members of
    the larger tiles. Of a tile that goes on in the next batch no more than SMALL rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = [np.zeros(0, np.int64)] * 4, None
        for b in chain(batches, [None]):
            t = held if b is None else [np.concatenate([h, b.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("key", "salt", "class", "n"))]
            if large:  # what is known of the last tile stays true of its further rows
                again = (t[0] == large[0]) & (t[1] == large[1]) & (t[2] == large[2])
                t = [x[~again] for x in t]
            if not len(t[0]):
                continue
            new = np.r_[True, (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1])]
            once = new | np.r_[True, t[2][1:] != t[2][:-1]]
            new, (key, salt, cls, n) = new[once], [x[once] for x in t]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(key)])
            big = (size > SMALL) | (salt[begin] > 0)
            if large and (key[0], salt[0]) == large[:2]:
                big[0] = True
            held, large = [np.zeros(0, np.int64)] * 4, None
            big = np.repeat(big, size)
            if b is not None:
                if big[-1]:
                    large = (key[-1], salt[-1], cls[-1])
                else:
                    held = [x[begin[-1] :] for x in (key, salt, cls, n)]
                    key, salt, cls, n, big = (x[: begin[-1]] for x in (key, salt, cls, n, big))
            left, right, least, most = [], [], [], []
            k, c, m = key[~big], cls[~big], n[~big]
            for d in range(1, SMALL):
                same = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else []
                if not len(same):
                    break
                x, y = m[same], m[same + d]
                fit = same[100 * np.minimum(x, y) >= ALIKE * np.maximum(x, y)]
                for out, of in ((left, c[fit]), (right, c[fit + d]), (least, m[fit]), (most, m[fit + d])):
                    out.append(of)
            x, y, at, times = distinct_pairs(left, right)
            na, nb = (np.concatenate([np.zeros(0, np.int64), *z])[at] for z in (least, most))
            none = lambda q: pa.nulls(q, pa.int64())
            p, q = len(x), int(big.sum())
            columns = [pa.concat_arrays([none(p), pa.array(key[big])]), *(pa.concat_arrays([pa.array(v), pa.array(w) if w is not None else none(q)]) for v, w in ((x, cls[big]), (y, None), (na, n[big]), (nb, None), (times.astype(np.int64), None)))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "na", "nb", "times"])
        give_back()

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "class").mapInArrow(run, "key bigint, a bigint, b bigint, na bigint, nb bigint, times bigint")


def least_common(na: Column, nb: Column) -> Column:
    """needed() of columns."""
    return F.ceil(ALIKE * (na + nb) / (100 + ALIKE))


def often_enough(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) that share enough tiles, of pairs (a, b, na, nb, times): beyond the tiles of up to SMALL classes, two classes may share the larger
    ones of the one that has fewer, and beyond the prefixes the longer of the two rests."""
    each = pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("times").alias("times"))
    rest = lambda n: F.col(n) - F.floor(F.col(n) / 4) - 1
    room = F.col("times") + F.greatest(rest("na"), rest("nb"), F.lit(0))
    more = members.groupBy("class").agg(F.count("*").alias("more"))
    at = lambda c: more.select(F.col("class").alias(c), F.col("more").alias(f"more_{c}"))
    both = each.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.where(room + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) >= least_common(F.col("na"), F.col("nb"))).select("a", "b")


def dealt_tiles(members: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The members (key, class, n, label, probe) by tile (key, band), of all tiles or those among (key, band), a class in its own band and, as high, in the one below; and there
    by blocks i, j. before: the keys under this one by which the class is a probe in the band. Tiles of one component, or without a class of their own band, have nothing to compare."""
    own_band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / ALIKE))).cast("int")
    each = members.withColumn("_band", own_band).withColumn("band", F.explode(F.array(F.col("_band"), F.col("_band") - 1))).withColumn("high", F.col("band") < F.col("_band")).drop("_band")
    sizes = each.groupBy("key", "band").agg(F.count("*").alias("_m"), F.max("n").alias("_n"), F.min("high").alias("_high"), F.min("label").alias("_least"), F.max("label").alias("_most"))
    blocks = F.ceil(F.greatest(F.col("_m") / BLOCK, F.col("_m") * F.col("_n") / BLOCK_BYTES)).cast("int")
    sizes = sizes.where("not _high and _least <> _most").select("key", "band", blocks.alias("_blocks"))
    if among is not None:
        sizes = sizes.join(among, ["key", "band"], "left_semi")
    sooner = Window.partitionBy("class", "band").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    dealt = each.join(sizes, ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("before", F.filter(F.collect_list(F.when(F.col("probe"), F.col("key"))).over(sooner), lambda x: x < F.col("key")))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select("key", "band", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "high", "class", F.col("n").cast("bigint").alias("n"), "label", "probe", "before")


def bounded_in_tiles(dealt: DataFrame, bits: DataFrame, limit: int) -> DataFrame:
    """a, b: of each class that is a probe the first pairs with classes before it that are within the bitmap bound and don't meet in a tile of a smaller key;
    and key, band (a null) of the tiles that hold more."""
    by = ["key", "band", "i", "j"]

    def block(x: int, y: int, c: dict[str, np.ndarray], bits: pa.Array, keys: np.ndarray, starts: np.ndarray) -> tuple[list, list, bool]:
        cls, n, label, high, own = (c[k][x:y] for k in ("class", "n", "label", "high", "own"))
        words = words_of(int(n.min()))
        maps = np.concatenate([fold(unpacked(bits[x + r].as_buffer(), int(n[r])), words) for r in range(y - x)])
        (different, code), at_code = np.unique(keys[starts[x] : starts[y]], return_inverse=True), starts[x : y + 1] - starts[x]
        left, right, cut = [], [], False
        for r in np.flatnonzero(c["probe"][x:y]).tolist():
            ok = (label[:r] != label[r]) & (100 * np.minimum(n[:r], n[r]) >= ALIKE * np.maximum(n[:r], n[r]))
            if high[r]:
                ok &= ~high[:r]
            if c["i"][x] != c["j"][x]:
                ok &= own[:r] != own[r]
            if (mine := code[at_code[r] : at_code[r + 1]]).size:
                met = np.zeros(len(different), bool)
                met[mine] = True
                upto = np.concatenate([[0], np.cumsum(met[code[: at_code[r]]])])
                ok &= upto[at_code[1 : r + 1]] == upto[at_code[:r]]
            at, got = np.flatnonzero(ok), 0
            for k in range(0, len(at), AT_ONCE):
                some = at[k : k + AT_ONCE]
                fit = some[within_bound(n[some], np.full(len(some), n[r]), maps[some], np.broadcast_to(maps[r], (len(some), words)))]
                take = fit[: limit - got]
                left.append(cls[take])
                right.append(np.full(len(take), cls[r]))
                got += len(fit)
                if got > limit or got == limit and k + AT_ONCE < len(at):
                    cut = True
                    break
        return left, right, cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by):
            c = {k: t.column(k).to_numpy() for k in t.column_names if k not in ("bits", "before")}
            edge = np.flatnonzero(np.r_[True, np.any([c[k][1:] != c[k][:-1] for k in by], axis=0), True])
            bits, before = (t.column(k).combine_chunks() for k in ("bits", "before"))
            keys, starts = before.flatten().to_numpy(), np.r_[0, np.cumsum(before.value_lengths().to_numpy())]
            left, right, more = [], [], []
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                a, b, cut = block(x, y, c, bits, keys, starts)
                left += a
                right += b
                if cut:
                    more.append(x)
            a, b, _, _ = distinct_pairs(left, right)
            none = lambda q: pa.nulls(q, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([none(len(a)), pa.array(c["key"][more])]), pa.concat_arrays([none(len(a)), pa.array(c["band"][more].astype(np.int64))]), pa.concat_arrays([pa.array(a), none(len(more))]), pa.concat_arrays([pa.array(b), none(len(more))])], names=["key", "band", "a", "b"])

    return dealt.join(bits, "class").select(*by, "own", "high", "class", "n", "label", "probe", "before", "bits").repartition(*by).sortWithinPartitions(*by, "class").mapInArrow(run, "key bigint, band bigint, a bigint, b bigint")


# ---- decisions ----


def bounded(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link."""
    side = lambda c: bits.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for r, (x, y) in enumerate(zip(b.column("bitsa"), b.column("bitsb"))):
                x, y = unpacked(x.as_buffer(), int(na[r])), unpacked(y.as_buffer(), int(nb[r]))
                least = min(x.shape[1], y.shape[1])
                keep[r] = within_bound(na[r : r + 1], nb[r : r + 1], fold(x, least), fold(y, least))[0]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a bigint, b bigint")


def links(keyed: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that link, by exact intersection of their shingle arrays, stored."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Powers()
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                found = sets_of(b, tables)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "shingles"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(int(np.count_nonzero(both[1:] == both[:-1])) >= -(-ALIKE * (len(x) + len(y)) // (100 + ALIKE)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = stored(rows_of(pairs, classes))
    sets = stored(keyed.join(listed(rows), "row", "left_semi").select("text").mapInArrow(arrays, "class bigint, shingles binary"))
    side = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s{c}"))
    out = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(decide, "a bigint, b bigint"))
    drop(rows, sets)
    return out


def rows_of(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """row: one of each class in the pairs (a, b)."""
    return classes.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi").select("row")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").where("not coalesce(_a, a) <=> coalesce(_b, b)").select("a", "b")


def joined_up(keyed: DataFrame, pairs: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Labels (node, label) after the pairs' decision: of each class the pair with the first class, then the pairs whose ends are still apart."""
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    for wave in (lambda: first, lambda: apart(pairs.join(first, ["a", "b"], "left_anti"), labels)):
        todo = stored(wave())
        if not todo.isEmpty():
            found = links(keyed, todo, classes)
            before = [labels.select(F.col("node").alias("a"), F.col("label").alias("b"))] if labels is not None else []
            now = connected(functools.reduce(DataFrame.union, before, found))
            drop(found, *([labels] if labels is not None else []))
            labels = now
        drop(todo)
        if labels is None:
            break
    drop(first)
    return labels


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n, class) of each document, class null without shingles; and (class, best: the least (doc_id is null, doc_id, row) of its component). row is with_row()'s."""
    with batches_of(docs.sparkSession, ARROW_BATCH):
        return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    row = free_name(docs, "row")
    keyed = with_row(docs, row).select(F.col(row).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described, shared = describe(keyed)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = stored(described.where("class is not null").groupBy("class").agg(F.min("row").alias("row"), F.min(order).alias("best")))
    tiles = stored(tile_pairs(prefixes(keyed, hot_shingles(shared))))
    release(docs.sparkSession)  # the prefixes, the most that is ever shuffled, before the pairs are
    members = stored(tiles.where("b is null").select("key", F.col("a").alias("class"), F.col("na").alias("n")))
    pairs = stored(often_enough(tiles.where("b is not null"), members))
    drop(tiles)
    release(docs.sparkSession)
    ends = pairs.unionByName(members.select(F.col("class").alias("a"), F.col("class").alias("b")))
    rows = stored(rows_of(ends, classes))
    bits = bitmaps(keyed, rows)
    drop(rows)
    small = stored(bounded(pairs, bits))
    drop(pairs)
    first = stored(members.groupBy("class").agg(F.min("key").alias("first")))
    labels, limit, open_tiles = None, LIMIT, None
    for turn in count():
        marked = members.withColumn("probe", F.lit(True))
        if not turn:  # only tiles that are the first one of some class
            marked = members.join(first.select(F.col("first").alias("key")).distinct(), "key", "left_semi").join(first, "class").withColumn("probe", F.col("key") == F.col("first")).drop("first")
        if open_tiles is not None:
            marked = marked.join(open_tiles.select("key").distinct(), "key", "left_semi")
        if labels is not None:
            marked = marked.join(labels.withColumnRenamed("node", "class"), "class", "left")
        marked = marked.withColumn("label", F.col("class") if labels is None else F.coalesce("label", "class"))
        dealt = stored(dealt_tiles(marked, open_tiles))
        asked = stored(dealt.select("class").distinct())
        found = stored(bounded_in_tiles(dealt, bits.select("class", "bits").join(listed(asked), "class", "left_semi"), limit))
        drop(dealt, asked)
        pairs = found.where("a is not null").select("a", "b")
        new = stored((pairs if turn else pairs.union(small)).distinct())
        labels = joined_up(keyed, new, classes, labels)
        drop(new, *([open_tiles] if open_tiles is not None else [] if turn else [small, first]))
        open_tiles = None
        if turn:
            open_tiles, limit = stored(found.where("a is null").select("key", F.col("band").cast("int").alias("band")).distinct()), limit * MORE
        drop(found)
        release(docs.sparkSession)
        if turn and open_tiles.isEmpty():
            break
    drop(open_tiles, bits, members)
    if labels is None:
        return described, classes.select("class", "best")
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "best", F.coalesce("label", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("best").alias("best"))
    out = stored(named.drop("best").join(least, "component").select("class", "best"))
    drop(labels, classes)
    return described, out


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    described, components = near_duplicates(docs)
    named = described.join(components, "class", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id; documents without shingles all stay."""
    described, components = near_duplicates(docs)
    row = free_name(docs, "row")
    gone = stored(described.join(components, "class").where("row <> best.row").select(F.col("row").alias(row)))
    return with_row(docs, row).join(listed(gone), row, "left_anti").select(*quoted(docs.columns))
