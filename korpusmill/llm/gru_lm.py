"""Scoring of texts by a gated recurrent language model, in numpy.

Token counts come from all learning documents. The ``VOCABULARY`` most frequent tokens are the model's own, in frequency classes;
every other token belongs to one further class, inside which it has its share of the corpus's counts. The output
is factored: softmax over classes, then over the words of one class. A gated recurrent unit is trained by truncated backpropagation
on every whole learning document: the driver makes a first model from a few slices (``FIRST_DOCS``), the documents are dealt by a hash into parts of
about ``PART_TOKENS`` tokens, every part trains that model over all of its documents, and the parts' weights are averaged by tokens. The
number of parts and steps grows with the input. Scoring walks every whole
document in windows of ``WINDOW`` steps and carries the state from one to the next, many documents side by side.

The ``COMMON`` most frequent tokens' counts travel to the workers; for the other, rare tokens each document sends its words
through one join with the full count table. No rare word is frequent enough to make that join uneven.

Defined results: a null or empty text is one end token; without learning documents V and N are 0 and both scores are 0; a null doc_id is neither held
out nor learned from; repeated rows are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.arrow import slices
from korpusmill.llm.common import ascii_lower, stored, words

#: The end token's name; no word contains white space.
END = "\n"
VOCABULARY, CLASSES, HIDDEN = 2048, 32, 16
COMMON = 100_000
FIRST_DOCS, SLICE = 600, 6000
STEPS, LANES, WINDOW = 500, 48, 32
PART_TOKENS, PART_LANES, PART_RATE = 1 << 20, 256, 0.003
SCORE_LANES, SCORE_TOKENS, SCORE_BYTES = 512, 1 << 15, 24 << 20


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_softmax_at(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log softmax of each row of the logits x, which it overwrites, at the row's target."""
    np.minimum(x, 60, out=x)  # far above any trained logit; the sums stay finite without a maximum by row
    own = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    return own - np.log(x @ np.ones(x.shape[1], x.dtype))


def softmax_gradient(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the cross entropy to the logits x, which it overwrites, and the summed loss."""
    rows, one = np.arange(len(x)), np.ones((x.shape[1], 1), x.dtype)
    np.minimum(x, 60, out=x)  # far above any trained logit; the sums stay finite without a maximum by row
    own = x[rows, target].sum(dtype=np.float64)
    np.exp(x, out=x)
    total = x @ one
    x *= 1 / total
    x[rows, target] -= 1
    return x, float(np.log(total).sum(dtype=np.float64) - own)


class GruLM:
    """Ids 0..v-1 are words in order of frequency, v is any other word; class k has the words k * per .. (k + 1) * per - 1 below v, and a class of its own the others."""

    def __init__(self, v: int, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 3):
        r = np.random.default_rng(seed)
        self.v, self.hidden = v, hidden
        self.per = max(1, -(-v // classes))
        self.classes = -(-v // self.per) if v else 0
        small = lambda *s: r.normal(0, 0.1, s).astype(np.float32)
        self.p = {"wx": small(v + 1, 3 * hidden), "wh": small(hidden, 3 * hidden) * 3, "b": np.zeros(3 * hidden, np.float32), "wc": small(hidden, self.classes + 1), "bc": np.zeros(self.classes + 1, np.float32), "ww": small(self.classes, hidden, self.per), "bw": np.zeros((self.classes, self.per), np.float32)}
        for k in range(self.classes):
            self.p["bw"][k, max(0, v - k * self.per) :] = -1e4  # places of the last class that no word has

    def start_from(self, counts: np.ndarray, others: int) -> None:
        """Biases that give the unigram distribution."""
        for k in range(self.classes):
            c = counts[k * self.per : (k + 1) * self.per] + 1.0
            self.p["bw"][k, : len(c)] = np.log(c / c.sum())
        total = [counts[k * self.per : (k + 1) * self.per].sum() + 1.0 for k in range(self.classes)] + [others + 1.0]
        self.p["bc"][:] = np.log(np.array(total) / np.sum(total))

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.v, self.classes, ids // self.per)

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        return self.move(self.p["wx"][ids] + self.p["b"], h)

    def move(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The next state, from the words' inputs x (biases included) and the state; and what backpropagation needs."""
        d = self.hidden
        u = h @ self.p["wh"]
        g = sigmoid(x[:, : 2 * d] + u[:, : 2 * d])
        z, r, un = g[:, :d], g[:, d:], u[:, 2 * d :]
        n = r * un
        n += x[:, 2 * d :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, (z, r, n, un)

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P (natural) of each id given its state; for other words, of their class."""
        cls = self.class_of(ids)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=self.classes + 1))])
        out = log_softmax_at(h @ self.p["wc"] + self.p["bc"], cls)
        states, words = h[order], ids[order]
        for k in range(self.classes):
            at = slice(edges[k], edges[k + 1])
            if at.start < at.stop:
                out[order[at]] += log_softmax_at(states[at] @ self.p["ww"][k] + self.p["bw"][k], words[at] - k * self.per)
        return out

    def output_gradients(self, h: np.ndarray, ids: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
        """Gradient to the states, loss; adds to g."""
        n, cls = len(ids), self.class_of(ids)
        d, loss = softmax_gradient(h @ self.p["wc"] + self.p["bc"], cls)
        g["wc"] += h.T @ d
        g["bc"] += np.ones(n, d.dtype) @ d
        dh = d @ self.p["wc"].T
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=self.classes + 1))])
        states, words, back = h[order], ids[order], np.zeros_like(h)
        for k in range(self.classes):
            at = slice(edges[k], edges[k + 1])
            if at.start == at.stop:
                continue
            d, more = softmax_gradient(states[at] @ self.p["ww"][k] + self.p["bw"][k], words[at] - k * self.per)
            loss += more
            g["ww"][k] += states[at].T @ d
            g["bw"][k] += np.ones(len(d), d.dtype) @ d
            back[at] = d @ self.p["ww"][k].T
        dh[order] += back
        return dh, loss

    def window_gradients(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """ids, fresh: (lanes, steps); where fresh, a document begins and the state is 0. Backpropagation stays inside the window."""
        lanes, steps = ids.shape
        d, kind = self.hidden, self.p["wh"].dtype
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        stays = (~fresh.T[:, :, None]).astype(kind)
        x = (self.p["wx"] + self.p["b"])[ids.T]
        states, z, r, n, un = (np.empty((steps, lanes, d), kind) for _ in range(5))
        for t in range(steps):
            states[t] = h = h * stays[t]
            h, (z[t], r[t], n[t], un[t]) = self.move(x[t], h)
        dh, loss = self.output_gradients(states.reshape(-1, d), ids.T.ravel(), g)
        dh = dh.reshape(steps, lanes, d)
        to_n, to_z, to_r = (1 - z) * (1 - n * n), (states - n) * z * (1 - z), un * r * (1 - r)
        back = np.zeros_like(h)
        dx = np.empty((steps, lanes, 3 * d), h.dtype)
        du = np.empty_like(dx)
        wh = np.ascontiguousarray(self.p["wh"].T)
        for t in range(steps - 1, -1, -1):
            dn = np.multiply(back, to_n[t], out=dx[t, :, 2 * d :])
            np.multiply(back, to_z[t], out=du[t, :, :d])
            np.multiply(dn, to_r[t], out=du[t, :, d : 2 * d])
            np.multiply(dn, r[t], out=du[t, :, 2 * d :])
            back *= z[t]
            back += du[t] @ wh
            back += dh[t]
            back *= stays[t]
        dx[:, :, : 2 * d] = du[:, :, : 2 * d]
        dx, du, word = dx.reshape(-1, 3 * d), du.reshape(-1, 3 * d), ids.T.ravel()
        g["b"] += dx.sum(0)
        g["wh"] += states.reshape(-1, d).T @ du
        order = np.argsort(word.astype(np.uint16), kind="stable")
        seen, at = np.unique(word[order], return_index=True)
        g["wx"][seen] = np.add.reduceat(dx[order], at)
        count = lanes * steps
        return {k: x / count for k, x in g.items()}, h, loss / count

    def fit(self, docs: list[np.ndarray], steps: int | None = STEPS, lanes: int = LANES, window: int = WINDOW, rate: float = 0.01) -> list[float]:
        """Adam over windows of lanes that read the documents one after the other; returns the losses. Without steps, one pass over all documents."""
        whole = np.concatenate(docs)
        first = np.zeros(len(whole), bool)
        first[np.cumsum([0] + [len(x) for x in docs[:-1]])] = True
        n = lanes * window
        cols = max(window, -(-len(whole) // n) * window)
        ids, fresh = np.resize(whole, lanes * cols).reshape(lanes, cols), np.resize(first, lanes * cols).reshape(lanes, cols)
        fresh[:, 0] = True
        steps = steps or cols // window
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        h, losses = np.zeros((lanes, self.hidden), np.float32), []
        for t in range(1, steps + 1):
            at = (t - 1) * window % cols
            g, h, loss = self.window_gradients(ids[:, at : at + window], fresh[:, at : at + window], h)
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * (1 - 0.9 * (t - 1) / steps)
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return losses

    def score(self, docs: list[np.ndarray], lanes: int = SCORE_LANES, window: int | None = None) -> np.ndarray:
        """Natural log-likelihood of each whole document; its state passes from window to window.

        Lanes read documents one after the other: as many lanes as the longest document leaves work for, filled longest document first.
        """
        size = np.array([len(x) for x in docs], np.int64)
        total = np.zeros(len(docs))
        if not size.sum():
            return total
        lanes = int(min(lanes, -(-size.sum() // size.max())))
        window = window or max(WINDOW, SCORE_TOKENS // lanes)
        free, holds = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for k in np.argsort(-size, kind="stable"):
            if size[k]:
                load, lane = free[0]
                holds[lane].append(int(k))
                heapq.heapreplace(free, (load + int(size[k]), lane))
        holds.sort(key=lambda ks: -int(size[ks].sum()))
        order = [k for ks in holds for k in ks]
        ids = np.concatenate([docs[k] for k in order])
        load = np.array([size[ks].sum() for ks in holds])
        begin = np.cumsum(load) - load  # of each lane in ids
        starts = np.cumsum(size[order]) - size[order]  # of each document in ids
        lane_of = np.repeat(np.arange(lanes), [len(ks) for ks in holds])
        by_time = np.argsort(starts - begin[lane_of], kind="stable")
        opens, opening = (starts - begin[lane_of])[by_time], lane_of[by_time]
        x, h, out = self.p["wx"] + self.p["b"], np.zeros((lanes, self.hidden), np.float32), np.empty(len(ids))
        for at in range(0, int(load[0]), window):
            now = np.arange(at, min(at + window, int(load[0])))
            live = np.searchsorted(-load, -now, "left")  # loads descend: these lanes have a token t
            to = np.cumsum(live)
            place = begin[np.arange(to[-1]) - np.repeat(to - live, live)] + np.repeat(now, live)
            words = ids[place]
            inputs, states = x[words], np.empty((len(words), self.hidden), np.float32)
            edges = np.searchsorted(opens, [*now, now[-1] + 1]).tolist()
            for t, (n, end) in enumerate(zip(live.tolist(), to.tolist())):
                state = states[end - n : end]
                state[:] = h[:n]
                if edges[t] < edges[t + 1]:
                    state[opening[edges[t] : edges[t + 1]]] = 0
                h = self.move(inputs[end - n : end], state)[0]
            out[place] = self.log_probs(states, words)
        total[order] = np.add.reduceat(out, starts)
        return total


@dataclass
class Scorer:
    """What the workers need: counts of the common words, the model, and the corpus's totals."""

    counts: dict[bytes, int]
    ids: dict[bytes, int]
    model: GruLM
    tokens: int
    distinct: int
    other_tokens: int
    other_distinct: int


def tokens(text: Column) -> Column:
    """Lower-cased words and the end token."""
    return F.concat(words(ascii_lower(F.coalesce(text, F.lit("")))), F.array(F.lit(END)))


def places(ws: list[bytes], place: dict[bytes, int], other: int) -> np.ndarray:
    """Each word's place, or other."""
    return np.fromiter(map(place.get, ws, repeat(other)), np.int64, len(ws))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def learners(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))


def count_tokens(docs: DataFrame) -> DataFrame:
    """word, c over all learning documents, written to the shared folder; the words of some megabytes of texts are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SCORE_BYTES):
                seen = Counter({END.encode(): b.num_rows})
                for t in b.column("text"):
                    seen.update(t.as_buffer().to_pybytes().lower().split())
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "c"])

    texts = learners(docs).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stored(texts.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The most frequent words, at most so many, by descending count: whole count buckets of 2 % width, so nothing has to be sorted, and of
    the first bucket that is too large the words whose hashes fall into a share that fits."""
    bucket = F.ceil(F.log(F.col("c").cast("double")) / float(np.log(1.02)))
    n = sorted(((r["b"], r["n"]) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, wanted = most, F.lit(False)
    for b, k in n:
        if k > room:
            share = int(0.9 * room / k * (1 << 30))  # a tenth less, as hashes fall unevenly
            wanted = wanted | (bucket == b) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share)
            break
        room, wanted = room - k, bucket >= b
    rows = counts.where(wanted).collect()
    return sorted(((r["word"], r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))[:most]


def train_parts(docs: DataFrame, ids: dict[bytes, int], model: GruLM, parts: int) -> GruLM:
    """The model, trained on over all learning documents in so many parts: the mean of the parts' weights by their tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, model))
    names, end = sorted(model.p), END.encode()
    size = sum(x.size for x in model.p.values())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, v = shared.value[0], len(shared.value[0])
        for whole in batches:
            for b in slices(whole, "text", SCORE_BYTES):
                out = [places([*t.as_buffer().to_pybytes().lower().split(), end], place, v).astype("<u2").tobytes() for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([b.column("part"), b.column("o"), pa.array(out, pa.binary())], names=["part", "o", "ids"])

    def fit(part: pa.Table) -> pa.Table:
        own = GruLM(model_size)
        own.p = {k: x.copy() for k, x in shared.value[1].p.items()}
        read = sorted(zip(part.column("o").to_pylist(), part.column("ids").to_pylist()))
        texts = [np.frombuffer(x, "<u2").astype(np.int64) for _, x in read]
        n = sum(len(x) for x in texts)
        own.fit(texts, None, max(1, min(PART_LANES, n // (128 * WINDOW))), rate=PART_RATE)
        flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64)
        return pa.table({"part": part.column("part")[:1], "n": [n], "sums": pa.array([(flat * n).tobytes()], pa.binary())})

    def add(some: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for _, x in sorted(zip(some.column("part").to_pylist(), some.column("sums"))):
            total += np.frombuffer(x.as_buffer(), np.float64)
        return pa.table({"n": [sum(some.column("n").to_pylist())], "sums": pa.array([total.tobytes()], pa.binary())})

    model_size = model.v
    dealt = learners(docs).select(F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(parts)).cast("int").alias("part"), F.xxhash64("doc_id", "text").alias("o"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    fitted = dealt.mapInArrow(encode, "part int, o bigint, ids binary").groupBy("part").applyInArrow(fit, "part int, n bigint, sums binary")
    rows = fitted.groupBy((F.col("part") % int(np.ceil(np.sqrt(parts)))).alias("some")).applyInArrow(add, "n bigint, sums binary").collect()
    mean = sum(np.frombuffer(r["sums"], np.float64) for r in rows) / sum(r["n"] for r in rows)
    out, at = GruLM(model.v), 0
    for k in names:
        out.p[k] = mean[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
        at += model.p[k].size
    return out


def train(docs: DataFrame, counts: DataFrame) -> Scorer | None:
    """None if there is nothing to learn from."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    if not total["n"]:
        return None
    common = frequent(counts, COMMON)
    own = common[:VOCABULARY]
    ids = {w.encode(): i for i, (w, _) in enumerate(own)}
    inside = np.array([c for _, c in own], float)
    model = GruLM(len(own))
    others = int(total["n"] - inside.sum())
    model.start_from(inside, others)
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - SLICE, F.lit(1))).cast("int") + 1
    own_share = min(1.0, 1.3 * FIRST_DOCS / max(1, learners(docs).count()))
    some = learners(docs).where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) < own_share * (1 << 20))
    pick = lambda df: df.select(F.xxhash64("doc_id").alias("o"), "doc_id", F.substr(F.coalesce("text", F.lit("")), place, F.lit(SLICE)).alias("t"))
    rows = pick(some).orderBy("o", "doc_id", "t").limit(FIRST_DOCS).collect() or pick(learners(docs)).limit(FIRST_DOCS).collect()
    model.fit([np.array([ids.get(w, len(own)) for w in [*r["t"].encode().lower().split(), END.encode()]], np.int64) for r in rows])
    model = train_parts(docs, ids, model, max(1, round(total["n"] / PART_TOKENS)))
    return Scorer({w.encode(): c for w, c in common}, ids, model, int(total["n"]), int(total["v"]), others, int(total["v"]) - len(own))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark = docs.sparkSession
    counts = count_tokens(docs)
    scorer = train(docs, counts)
    held = is_held_out(F.col("doc_id")).alias("held_out")
    if scorer is None:
        zero = F.lit(0).cast("bigint")
        return docs.select("doc_id", held, F.size(tokens(F.col("text"))).cast("bigint").alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = shared.value
        v, end = len(s.ids), END.encode()
        base_floor, other_floor = np.log10(s.tokens + s.distinct + 1), np.log10(s.other_tokens + s.other_distinct + 1)
        place, count_of = {w: i for i, w in enumerate(s.counts)}, np.array([*s.counts.values(), 0], np.float64)
        log_of = np.log10(count_of + 1)
        for whole in batches:
            for b in slices(whole, "text", SCORE_BYTES):
                encoded, n_tokens, known, logs, own_logs, n_other = [], [], [], [], [], []
                row_of, word, times = [], [], []
                for i, t in enumerate(b.column("text")):
                    ws = t.as_buffer().to_pybytes().lower().split()
                    ws.append(end)
                    at = places(ws, place, len(place))  # the words with ids come first
                    own = np.minimum(at, v)
                    unlisted = np.flatnonzero(at == len(place)).tolist()
                    rare = Counter([ws[k] for k in unlisted])
                    lc = log_of[at]
                    encoded.append(own)
                    n_tokens.append(len(ws))
                    known.append(len(ws) - len(unlisted))
                    logs.append(float(lc.sum()) - len(ws) * base_floor)
                    other = own == v
                    own_logs.append(float(lc[other].sum()) - np.count_nonzero(other) * other_floor)
                    row_of += [i] * len(rare)
                    word += rare.keys()
                    times += rare.values()
                model = s.model.score(encoded) / np.log(10.0) + np.array(own_logs)
                n = b.num_rows
                rows = b.column("row")
                nulls = lambda kind, k=len(word): pa.nulls(k, kind)
                names = pa.array([f"\n{r}".encode() for r in rows.to_pylist()] + word, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([rows, rows.take(pa.array(row_of, pa.int64()))]),
                        names,
                        pa.array([0] * n + times, pa.int64()),
                        pa.concat_arrays([b.column("doc_id"), nulls(b.column("doc_id").type)]),
                        pa.concat_arrays([pa.array(n_tokens, pa.int64()), nulls(pa.int64())]),
                        pa.concat_arrays([pa.array(known, pa.int64()), nulls(pa.int64())]),
                        pa.concat_arrays([pa.array(logs, pa.float64()), nulls(pa.float64())]),
                        pa.concat_arrays([pa.array(model, pa.float64()), nulls(pa.float64())]),
                    ],
                    names=["row", "word", "times", "doc_id", "n_tokens", "known", "base", "model"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    flat = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"row bigint, word string, times bigint, doc_id {kind}, n_tokens bigint, known bigint, base double, model double")
    met = flat.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    part = F.col("times") * F.log10(F.col("c") + 1.0)
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.sum(part)).alias("base_score"),
        (F.max("model") + F.sum(part)).alias("score"),
    )
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(scorer.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
