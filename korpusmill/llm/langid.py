"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter keeps its maximum, and a softmax layer
gives the languages' probabilities. A text is cut into windows over its whole length; its probabilities are the windows' mean,
weighted by their bytes. Training takes a bounded sample of labelled rows: up to ``SAMPLE_PER_LANG`` documents of each language
(fewer, but no less than ``LEAST_PER_LANG``, where the languages are so many that this came to more than ``SAMPLE``), chosen by a hash of the row's place, and of
each a slice of ``SLICE`` characters at a hashed place. Every language that a learning row has can be predicted.

Defined results: a null text, an empty one or one without any letter is ``und`` with score 0, and so is every text if no
row is labelled; ties go to the language first in code-point order; a null doc_id is neither held out nor learned from; repeated rows are predicted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.llm.arrow import slices, utf8
from korpusmill.llm.common import free_name, quoted, with_row

SAMPLE_PER_LANG, LEAST_PER_LANG, SAMPLE, SLICE = 800, 20, 160_000, 768
WINDOW = 256
WIDTHS, PER_WIDTH, DIM = (2, 3, 4, 5), 8, 8
UNKNOWN = "und"
#: Below this mean probability the pipeline rejects a document; with many languages, below so many times an even share.
MIN_SCORE, TIMES_EVEN = 0.3, 1.5
REACH = max(WIDTHS)


class ByteConvNet:
    def __init__(self, langs: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs, k, f = langs, REACH * DIM, len(WIDTHS) * PER_WIDTH
        self.emb = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.emb[0] = 0  # byte 0 pads
        self.mask = np.repeat(np.concatenate([np.arange(REACH)[:, None] < w * np.ones((1, PER_WIDTH)) for w in WIDTHS], axis=1), DIM, axis=0).astype(np.float32)
        self.conv = (r.normal(0, 1 / np.sqrt(k), (k, f)).astype(np.float32)) * self.mask
        self.bias = np.zeros(f, np.float32)
        self.out = r.normal(0, 0.1, (f, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW, REACH * DIM) from bytes (windows, WINDOW + REACH - 1)."""
        e = self.emb[x]
        return np.concatenate([e[:, j : j + WINDOW] for j in range(REACH)], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        p = self.patches(x)
        z = p.reshape(-1, p.shape[2]) @ self.conv
        return np.maximum(z.reshape(len(x), WINDOW, -1).max(axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.pooled(x) @ self.out + self.out_bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        p = self.patches(x)
        z = (p.reshape(-1, p.shape[2]) @ self.conv).reshape(n, WINDOW, -1)
        top = z.argmax(axis=1)
        rows = np.arange(n)[:, None]
        high = np.take_along_axis(z, top[:, None], 1)[:, 0] + self.bias
        a = np.maximum(high, 0)
        s = a @ self.out + self.out_bias
        s = np.exp(s - s.max(axis=1, keepdims=True))
        d = s / s.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = (d @ self.out.T) * (high > 0)
        seen = p[rows, top]  # (n, filters, REACH * DIM)
        into = (g[:, :, None] * self.conv.T[None]).reshape(n, -1, REACH, DIM)
        emb = np.zeros_like(self.emb)
        where = x[rows[:, :, None], top[:, :, None] + np.arange(REACH)]
        np.add.at(emb, where.ravel(), into.reshape(-1, DIM))
        emb[0] = 0
        return {"emb": emb, "conv": np.einsum("nfk,nf->kf", seen, g) * self.mask, "bias": g.sum(0), "out": a.T @ d, "out_bias": d.sum(0)}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam; languages are drawn evenly."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        names = ("emb", "conv", "bias", "out", "out_bias")
        m, v = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for t in range(1, steps + 1):
            pick = np.array([r.choice(by[k]) for k in r.integers(0, len(by), batch)])
            now = rate * (1 - (t - 1) / steps)
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                getattr(self, k)[...] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def window_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the windows at starts; from ends on they are 0."""
    at = starts[:, None] + np.arange(WINDOW + REACH - 1)
    out = data[np.minimum(at, len(data) - 1)]
    out[at >= ends[:, None]] = 0
    return out


def cut(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each window; an empty text has none."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    start = offsets[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    return doc, start, offsets[doc + 1]


def score_texts(net: ByteConvNet, data: np.ndarray, offsets: np.ndarray, at_once: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language and its mean probability, of each text."""
    doc, start, end = cut(offsets)
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    for i in range(0, len(doc), at_once):
        s, e = start[i : i + at_once], end[i : i + at_once]
        p = net.probabilities(window_bytes(data, s, e)) * np.minimum(e - s, WINDOW)[:, None]
        np.add.at(total, doc[i : i + at_once], p)
    total /= np.maximum(np.diff(offsets), 1)[:, None]
    return total.argmax(axis=1), np.minimum(total.max(axis=1), 1.0)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id's text is divisible by parts; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def train(docs: DataFrame) -> ByteConvNet | None:
    """A network from the labelled rows that are not held out; None if there is none."""
    row = free_name(docs, "row")
    fit = with_row(docs, row).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    most = min(SAMPLE_PER_LANG, max(LEAST_PER_LANG, SAMPLE // len(counts)))
    u = F.pmod(F.xxhash64(row), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * most / n)))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - SLICE, F.lit(1))).cast("int") + 1
    drawn = fit.where(u < share).select(F.xxhash64(F.col(row), F.lit(2)).alias("o"), F.col(row).alias("row"), "lang", F.substr("text", place, F.lit(SLICE)).alias("t"))
    best = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("o", "row"))).where(F.col("nth") <= most)
    rows = sorted(best.collect(), key=lambda r: (r["o"], r["row"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    texts = [r["t"].encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    doc, start, end = cut(offsets)
    x = window_bytes(data, start, end)
    y = np.array([langs.index(r["lang"]) for r in rows])[doc]
    long = (end - start >= 32) | (end - offsets[doc] < WINDOW)
    return ByteConvNet(langs).fit(x[long], y[long])


def identify(docs: DataFrame, net: ByteConvNet | None, keep: list[str]) -> DataFrame:
    """The columns keep of docs, lang_pred and score."""
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    fields = [docs.schema[c] for c in keep]
    need = docs.select(F.struct(*keep).alias("kept"), F.coalesce("text", F.lit("")).alias("text"), letter.alias("letter"))
    kind = T.StructType([T.StructField("kept", T.StructType(fields)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                letters = b.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                if net is None:
                    best, score, langs = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.array([UNKNOWN])
                else:
                    best, score = score_texts(net, *utf8(b.column("text")))
                    langs = np.array([*net.langs])
                names = np.where(letters, langs[best], UNKNOWN)
                yield pa.RecordBatch.from_arrays([b.column("kept"), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters & (net is not None), score, 0.0))], names=["kept", "lang_pred", "score"])

    return need.mapInArrow(run, kind).select("kept.*", "lang_pred", "score")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """The documents whose language is known well enough. Without labelled rows nothing is known of any language, and all documents stay."""
    net = train(docs)
    if net is None:
        return docs
    held = F.struct(*[F.col(q).alias(f"c{i}") for i, q in enumerate(quoted(docs.columns))])
    found = identify(docs.select(held.alias("doc"), "text"), net, ["doc"])
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min(MIN_SCORE, TIMES_EVEN / len(net.langs)))
    return found.where(known).select(*[F.col("doc")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
