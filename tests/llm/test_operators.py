"""The training-data operators on odd rows, on empty tables, and against brute force."""

import hashlib
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korpusmill.llm import anchors, chat, common, gru_lm, jaccard, langid, matroska, mixing, packing, quality, suffix_dedup, url_filter
from korpusmill.llm.common import values

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


#: Names of extra columns that operators use inside, or that select() would read as something else.
CLASHES = ["row", "size", "copies", "score", "lang_pred", "held", "doc", "none", "kept", "n_bytes", "class", "label", "_", "c0", "a.b", "col", "position", "_metadata", "text 2"]


def with_odd(odd_docs, spark):
    """Odd rows and plain ones, with clashing extra columns that are null at times."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 100)
    both = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(plain)
    extra = [F.when(F.col("doc_id") % 2 == 0, F.lit(c)).alias(c) for c in CLASHES]
    return both.select("*", *extra)


@pytest.fixture
def written(spark, odd_docs, tmp_path):
    with_odd(odd_docs, spark).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def test_jaccard_equals_brute_force(written):
    docs = written.collect()
    sets = []
    for d in docs:
        w = WORD.findall(low(d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), d["doc_id"]), d["doc_id"])
    want = Counter((d["doc_id"], len(sets[i]), least.get(find(i))) for i, d in enumerate(docs))
    assert Counter(tuple(r) for r in jaccard.component_report(written).collect()) == want
    kept = jaccard.keep_one_each(written)
    assert kept.columns == written.columns
    assert kept.count() == len({find(i) for i in range(len(docs))})


def test_suffix_dedup_equals_brute_force(written):
    docs = [(d["doc_id"], (d["text"] or "").encode()) for d in written.collect()]
    seen = Counter(b[i : i + 200] for _, b in docs for i in range(len(b) - 199))
    want = Counter()
    for k, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[k, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    assert Counter(tuple(r) for r in suffix_dedup.repeats_report(written).collect()) == want
    assert suffix_dedup.without_repeats(written).columns == written.columns


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_transforms_find_equal_windows(shards):
    r = np.random.default_rng(1)
    strings = [bytes(r.integers(97, 99, n).astype(np.uint8)) for n in (300, 12, 8, 90, 40)]
    strings.append(strings[0][17:80])
    windows = np.array([len(s) - 7 for s in strings])
    offsets = np.cumsum([0] + [len(s) for s in strings])
    got = suffix_dedup.repeated_windows(np.frombuffer(b"".join(strings), np.uint8), offsets, windows, np.arange(6) % shards, np.zeros(windows.sum(), int), 8)
    every = [s[i : i + 8] for s in strings for i in range(len(s) - 7)]
    assert got.tolist() == [Counter(every)[x] > 1 for x in every]


def test_a_transform_is_sorted_and_knows_common_prefixes():
    strings = [b"abracadabra", b"", b"abra" * 100, b"cad"]
    t = suffix_dedup.Transform.of(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings]))
    text = [x for s in strings for x in (*(c + 2 for c in s), 1)]
    suffix = [text[i : i + 256] for i in t.order]
    assert suffix == sorted(suffix)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert t.common[1:].tolist() == [min(shared(a, b), 255) for a, b in zip(suffix, suffix[1:])]
    assert all(t.column[r] == (text[p - 2] - 2) << 8 | text[p - 1] - 2 for r, p in enumerate(t.order.tolist()) if p > 1 and text[p - 2] > 1 and text[p - 1] > 1)


def test_short_strings_are_merged_in_parts_of_bounded_size():
    anchor, size = np.repeat(np.arange(5000), 2), np.full(10_000, suffix_dedup.LENGTH + 1)  # a window each, so few windows and many bytes
    anchor[200:3200] = anchor[200]  # an anchor with more than a part holds stays whole
    found = list(suffix_dedup.merged_together(anchor, size))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == 10_000 and (200, 3200) in found
    assert all(size[a:b].sum() <= suffix_dedup.MERGED_BYTES or len(set(anchor[a:b])) == 1 for a, b in found) and len(found) < 20
    assert all(a == 0 or anchor[a] != anchor[a - 1] for a, _ in found)


def test_transforms_of_more_than_65536_symbols_are_sorted_and_merged():
    data = np.random.default_rng(4).integers(97, 99, 100_000).astype(np.uint8)
    data[60_000:60_500] = data[1000:1500]
    t = suffix_dedup.Transform.of(data, np.array([len(data)]))
    text = bytes(data) + b"\0"
    suffix = [text[i : i + 256] for i in t.order]
    assert suffix == sorted(suffix) and t.common.max() == 255
    windows, offsets = np.array([50_000 - 199] * 2), np.array([0, 50_000, 100_000])
    got = suffix_dedup.repeated_windows(data, offsets, windows, np.array([0, 1]), np.zeros(windows.sum(), int))
    every = [text[x + i : x + i + 200] for x, n in zip(offsets, windows) for i in range(n)]
    times = Counter(every)
    assert got.tolist() == [times[x] > 1 for x in every] and got.sum() >= 2 * 301


def test_long_texts_have_the_runs_of_their_parts(monkeypatch):
    data = np.random.default_rng(2).integers(97, 100, 5000).astype(np.uint8)
    cover = lambda: sorted(i for r in anchors.find_runs(data, np.array([0, 5000]), anchors.Tables()) for s, n in zip(r.start, r.windows) for i in range(s, s + n))
    whole = cover()
    monkeypatch.setattr(anchors, "MOST", 700)
    assert cover() == whole == list(range(4801))


def test_packing_is_gapless_and_complete(written):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    t.encode_special_tokens = True
    want = Counter()
    for d in written.collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, s in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[s : first if not k else s + 2048]
            want[d["doc_id"], k, s, len(part), zlib.crc32(np.array(part, "<u4"))] += 1
    rows = packing.pack(written).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    assert len(used) <= 1.1 * sum(used.values()) / 2048 + 1


def test_plan_places_every_rank():
    r = np.random.default_rng(5)
    counts = {int(x): int(n) for x, n in zip(*np.unique(r.integers(1, 2049, 3000), return_counts=True))}
    plan = packing.best_plan(counts)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    seq, offset = plan.place(length, rank)
    order = np.lexsort((offset, seq))
    seq, offset, length = seq[order], offset[order], length[order]
    same = seq[1:] == seq[:-1]
    assert (offset[1:][same] == (offset + length)[:-1][same]).all() and (offset[1:][~same] == 0).all()
    assert plan.sequences == seq.max() + 1 and (offset + length).max() <= 2048


@pytest.mark.parametrize("how", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_matroska_lacing(how):
    frames = [b"x" * 300] if how == matroska.NO_LACING else [b"a" * 300, b"b" * 300, b"c" * 300] if how == matroska.FIXED else [b"a" * 255, b"b" * 700, b"c", b"d" * 20]
    body = matroska.lace(frames, how)
    sizes, at = matroska.lace_sizes(body, 0, len(body), how)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def test_matroska_round_trip(written):
    for r in matroska.media_column(written).collect():
        media = matroska.read(r["media"])
        assert len(media.cues) == len(media.clusters) > 0
    for r in matroska.text_media(written).collect():
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] >= max(64, r["n_bytes"])
    assert matroska.packet_table(matroska.media_column(written)).count() >= written.count()
    with pytest.raises(ValueError):
        matroska.read(b"nothing")


def test_language_of_held_out(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    found = langid.identify(docs.select("*", langid.held_out(F.col("doc_id")).alias("held_out")), langid.train(docs), ["lang", "held_out"])
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_of_odd_rows(written):
    net = langid.train(written)
    rows = langid.identify(written, net, ["doc_id", "text"]).collect()
    assert {r["lang_pred"] for r in rows if not r["text"] or r["doc_id"] == 9} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gru_gradients():
    m = gru_lm.GruLM(10, classes=3, hidden=4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    r = np.random.default_rng(0)
    ids, fresh, h = r.integers(0, 11, (3, 5)), np.zeros((3, 5), bool), np.zeros((3, 4))
    fresh[:, 0] = fresh[1, 3] = True
    g = m.window_gradients(ids, fresh, h)[0]
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for j in r.integers(0, len(flat), 4):
            if flat[j] > -100:
                was, loss = flat[j], []
                for d in (1e-4, -1e-4):
                    flat[j] = was + d
                    loss.append(m.window_gradients(ids, fresh, h)[2])
                flat[j] = was
                assert abs((loss[0] - loss[1]) / 2e-4 - g[k].reshape(-1)[j]) < 1e-5


def test_windows_carry_the_state():
    m = gru_lm.GruLM(20)
    docs = [np.random.default_rng(i).integers(0, 21, 5 + 40 * i) for i in range(4)]
    assert np.allclose(m.score(docs, window=7), m.score(docs, window=1000), atol=1e-3)


def test_base_score_and_tokens(written):
    docs = [(d["doc_id"], [*WORD.findall(low(d["text"])), "\n"]) for d in written.collect()]
    c = Counter(w for k, ws in docs if k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3)) for k, ws in docs)
    rows = gru_lm.score_documents(written).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_every_learning_document_trains(spark):
    """Documents of the driver's first model have their words in random order, all others in a fixed one, with the same counts."""
    ids = spark.range(2400).select(F.col("id").alias("doc_id"))
    first = {r["doc_id"] for r in gru_lm.learners(ids).orderBy(F.xxhash64("doc_id")).limit(gru_lm.FIRST_DOCS).collect()}
    ws, r = [f"w{i}" for i in range(8)] * 8, np.random.default_rng(5)
    rows = [(k, " ".join(r.permutation(ws) if k in first else ws)) for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    held = gru_lm.score_documents(docs).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.05


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("cast(key as int) % 7 = 0")
    cascade = url_filter.Cascade.build(listed, universe, bits_per_key=3.0, hashes=2)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.listed(F.col("key")) != (F.col("key").cast("int") % 7 == 0)).count() == 0


def test_url_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "HTTP://A.Example.COM/en/7x?q", "h"), (3, "http://com/en/", "h"), (None, "x://org#/es/", "h")], "page_id long, url string, host string")
    rules = [url_filter.Rule("com", "/en/", "block"), url_filter.Rule("example.com", "/en/7", "allow"), url_filter.Rule("org", "/es/", "block")]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (3, "com", "/en/", "com/en/", "block"), (None, "org", "", None, "allow")}


def test_mixing(written):
    rows = mixing.mix_report(written).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(written).collect()))
    mixed = mixing.mix(written)
    assert mixed.columns == written.columns
    assert mixed.select(F.sum(F.size(F.expr("array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), '')")))).first()[0] == sum(r["taken"] for r in rows)


def test_quality_odd_rows(written):
    rows = quality.judge_quality(written).collect()
    assert len(rows) == written.count()
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 1, 0, "user", "start", "hi <s>"), (1, 2, 1, "assistant", "start", ""), (1, 2, 2, "assistant", "delta", "bad"), (1, 3, 3, "user", "start", "gone"), (1, 2, 4, "assistant", "regenerate", ""), (1, 2, 5, "assistant", "delta", "go"), (1, 2, 6, "assistant", "delta", "od"), (1, 1, 7, "user", "edit", "hello [x]")]
    df = spark.createDataFrame(log, "conv_id long, message long, seq long, role string, kind string, text string")
    done = chat.render(chat.fold(df))
    assert done.first()["formatted"] == "<s>[user]hello &lsqb;x&rsqb;</s><s>[assistant]good</s>"
    back = chat.read_back(done).first()
    assert back["n_turns"] == 2 and back["loss_chars"] == 4 and back["loss_sha256"] == hashlib.sha256(b"good").hexdigest()
    assert back["turns_sha256"] == hashlib.sha256(b"user\nhello [x]\nassistant\ngood\n").hexdigest()


def test_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "e"))
    docs = spark.read.parquet(str(tmp_path / "e"))
    for f in (jaccard.component_report, suffix_dedup.repeats_report, packing.pack, matroska.text_media, mixing.mix_report, quality.judge_quality, gru_lm.score_documents, lambda d: langid.identify(d, langid.train(d), ["doc_id"])):
        assert f(docs).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), [url_filter.Rule("a", "/", "block")]).count() == 0
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline_equals_its_stages(written, tmp_path):
    """Each stage works on what its predecessor kept, and its decisions take effect: against plain Python where that can follow."""
    import corpus_pipeline

    spark = written.sparkSession
    kept = langid.reject_unknown(written).collect()
    schema = written.schema
    sets = lambda x: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})(WORD.findall(low(x)))
    groups = []
    for r in kept:
        own = sets(r["text"])
        near = [g for g in groups if any(own and s and 100 * len(own & s) >= 75 * len(own | s) for _, s in g)]
        groups = [g for g in groups if g not in near] + [[(r, own), *(x for g in near for x in g)]]
    first = [min((r for r, _ in g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups]
    seen = Counter(b[i : i + 200] for r in first for b in [(r["text"] or "").encode()] for i in range(len(b) - 199))
    texts = []
    for r in first:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        texts.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    spark.createDataFrame([tuple(x if c == "text" else len(x) if c == "n_chars" else r[c] for c in schema.names) for r, x in zip(first, texts)], schema).write.parquet(str(tmp_path / "cut"))
    mixed = Counter()
    for r in mixing.mix_report(spark.read.parquet(str(tmp_path / "cut"))).collect():
        mixed[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    (tmp_path / "sf").mkdir()
    written.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    packed = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    sized = {r["doc_id"] for r, x in zip(first, texts) if WORD.search(x)}
    assert {k: n for k, n in packed.items() if k in sized} == {k: n for k, n in mixed.items() if n}
    assert rows and max(r["offset"] + r["length"] for r in rows) <= 2048


STAGES = {"language_id": langid.reject_unknown, "jaccard_join": jaccard.keep_one_each, "suffix_dedup": suffix_dedup.without_repeats, "source_mix": mixing.mix}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_and_rows_whole(written, stage):
    """Clashing columns come through with their values, and a result planned before the parallelism changes is that planned after."""
    conf, name = written.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    try:
        out = STAGES[stage](written)
        conf.set(name, "20000b")
        rows = out.collect()
        again = STAGES[stage](written).collect()
    finally:
        conf.set(name, before)
    key = lambda r: tuple(map(str, r))
    assert out.columns == written.columns
    assert sorted(map(key, rows)) == sorted(map(key, again))
    for r in rows:
        assert all(r[c] == (c if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None) for c in CLASHES)
    if stage != "suffix_dedup":
        given = {key(r) for r in written.collect()}
        assert {key(r) for r in rows} <= given


def test_reports_outlast_another_split(written):
    conf, name = written.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before, key = conf.get(name), lambda r: tuple(map(str, r))
    for report in (suffix_dedup.repeats_report, mixing.mix_report, jaccard.component_report):
        want = sorted(map(key, report(written).collect()))
        out = report(written)
        try:
            conf.set(name, "20000b")
            assert sorted(map(key, out.collect())) == want
        finally:
            conf.set(name, before)


def test_rejection_drops_what_has_no_language(written):
    kept = {r["doc_id"] for r in langid.reject_unknown(written).collect()}
    found = langid.identify(written, langid.train(written), ["doc_id"]).collect()
    assert kept == {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= langid.MIN_SCORE}
    unlabelled = written.withColumn("lang", F.lit(None).cast("string"))
    assert langid.reject_unknown(unlabelled).count() == written.count()


def test_language_training_takes_repeated_rows_and_rare_languages(spark):
    rows = [(7, "same text every time", "aa")] * 2000 + [(k, "other words here", "bb") for k in (1, 2)] + [(k, f"xyz {k}", f"l{k:03}") for k in range(10, 250)]
    learned = {lang for k, _, lang in rows if zlib.crc32(str(k).encode()) % 5}
    assert set(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == learned


def test_convolution_and_windows_equal_loops():
    net = langid.ByteConvNet(["a", "b", "c"])
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 5, 256, 700)]
    best, score = langid.score_texts(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(x) for x in texts]))
    for i, x in enumerate(texts):
        total = np.zeros(3)
        for at in range(0, len(x), langid.WINDOW):
            w = x[at : at + langid.WINDOW + langid.REACH - 1].ljust(langid.WINDOW + langid.REACH - 1, b"\0")
            e = net.emb[np.frombuffer(w, np.uint8)]
            top = np.zeros(net.conv.shape[1])
            for f in range(len(top)):
                width = langid.WIDTHS[f // langid.PER_WIDTH]
                filt = net.conv[: width * langid.DIM, f].reshape(width, langid.DIM)
                top[f] = max(0, max(float((e[j : j + width] * filt).sum()) for j in range(langid.WINDOW)) + net.bias[f])
            s = np.exp(top @ net.out + net.out_bias)
            total += s / s.sum() * min(langid.WINDOW, len(x) - at)
        if x:
            total /= len(x)
            assert best[i] == total.argmax() and abs(score[i] - total.max()) < 1e-4


def test_media_digests_equal_plain_ones(written):
    texts = {}
    for d in written.collect():
        texts.setdefault(d["doc_id"], []).append((d["text"] or "").encode())
    for r in matroska.text_media(written).collect():
        x = next(x for x in texts[r["doc_id"]] if len(x) == r["n_bytes"] and hashlib.sha256(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))).hexdigest() == r["payload_sha256"])
        padded = x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))
        stored = matroska.write(padded)
        v = list(padded)
        assert (r["payload_bytes"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(padded), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"].endswith(f"sum {sum(v)}, min {min(v)}, max {max(v)}, crossings {sum((a >= 128) != (b >= 128) for a, b in zip(v, v[1:]))}")


def test_media_times_cues_and_errors(spark):
    whole = matroska.write(bytes(range(256)) * 1000)
    m = matroska.read(whole)
    assert [p[1] for p in m.packets[:9]] == [128 * i for i in range(9)]
    assert [p[1] for p in m.packets] == sorted(p[1] for p in m.packets)
    later = matroska.since(m, m.cues[1][0], 1)
    assert len(m.clusters) == 2 and {p[5] for p in later} == {1} and later[0][1] == m.cues[1][0] and matroska.since(m, 0, 1) == m.packets
    broken = [whole[:5000], b"nothing"]
    for how in (matroska.XIPH, matroska.FIXED, matroska.EBML_LACING):
        for body in (b"", b"\x05a", b"\xff" * 3, b"\x02\xff\xff"):
            with pytest.raises(ValueError):
                matroska.lace_sizes(body, 0, len(body), how)
    with pytest.raises(ValueError):
        matroska.floating(b"abc", 0, 3)
    files = spark.createDataFrame([(i, f) for i, f in enumerate([whole, *broken, None])], "doc_id long, media binary")
    rows = matroska.packet_table(files).collect()
    assert {r["doc_id"] for r in rows if r["error"]} == {1, 2} and sum(r["doc_id"] == 0 for r in rows) == len(m.packets)


def test_stripped_headers():
    e, u = matroska.element, matroska.uint
    squeezed = lambda algo: e(matroska.TRACK_ENTRY, u(matroska.TRACK_NUMBER, 1) + u(matroska.DEFAULT_DURATION, 20_000_000) + e(matroska.ENCODINGS, e(matroska.ENCODING, e(matroska.COMPRESSION, u(matroska.COMPRESSION_ALGO, algo) + e(matroska.COMPRESSION_SETTINGS, b"head")))))
    file = lambda algo: e(matroska.EBML, b"") + e(matroska.SEGMENT, e(matroska.TRACKS, squeezed(algo)) + e(matroska.CLUSTER, u(matroska.TIMESTAMP, 5) + matroska.block(1, 0, [b"ab", b"cd"])))
    m = matroska.read(file(3))
    assert m.tracks[0]["stripped"] == b"head" and [p[1] for p in m.packets] == [5, 25]
    with pytest.raises(ValueError):
        matroska.read(file(0))


@pytest.mark.parametrize("v", [1, 10, 1498, 2048])
def test_probabilities_of_all_ids_sum_to_one(v):
    m = gru_lm.GruLM(v)
    h = np.random.default_rng(v).normal(0, 1, (1, m.hidden)).astype(np.float32)
    assert abs(np.exp(m.log_probs(np.repeat(h, v + 1, 0), np.arange(v + 1)).astype(float)).sum() - 1) < 1e-4


def test_score_equals_a_plain_loop(written):
    """The whole path's score is that of the model token by token, with the counts of other words inside their class."""
    docs = [(d["doc_id"], [*WORD.findall(low(d["text"])), "\n"]) for d in written.collect()]
    c = Counter(w for k, ws in docs if k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    counts = gru_lm.count_tokens(written)
    s = gru_lm.train(written, counts)
    m, v = s.model, len(s.ids)
    lp = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    want = []
    for k, ws in docs:
        h, total = np.zeros(m.hidden), 0.0
        for w in ws:
            i = s.ids.get(w.encode(), v)
            g = i // m.per if i < v else m.classes
            total += lp(h @ m.p["wc"] + m.p["bc"])[g]
            if i < v:
                total += lp(h @ m.p["ww"][g] + m.p["bw"][g])[i - g * m.per]
            else:
                total += np.log((c[w] + 1) / (s.other_tokens + s.other_distinct + 1))
            h = m.step(np.array([i]), h[None].astype(np.float32))[0][0]
        want.append((str(k), len(ws), total / np.log(10)))
    rows = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in gru_lm.score_documents(written).collect())
    for a, b in zip(rows, sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 * max(1, abs(b[2]))


def test_frequent_words_fit_even_if_all_are_equally_frequent(spark):
    counts = spark.range(1000).selectExpr("concat('w', id) word", "5L as c")
    assert 60 <= len(gru_lm.frequent(counts, 100)) <= 100


def test_events_that_come_twice_count_once(spark):
    log = [(1, 1, 0, "user", "start", "a"), (1, 1, 1, "user", "delta", "b"), (1, 1, 1, "user", "delta", "b"), (1, 1, 1, "user", "delta", "a")]
    assert chat.fold(spark.createDataFrame(log, "conv_id long, message long, seq long, role string, kind string, text string")).first()["text"] == "aab"


def test_fast_ids_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.default_vocabulary())
    slow.encode_special_tokens = True
    fast, r = packing.encoder(packing.default_vocabulary()), np.random.default_rng(9)
    pools = ["abc XYZ", " \t\n\r", "0123456789", "'s't're<|endoftext|>", "äßñéøčšž", "日本語中文한국어", "🙂👍🏽\u200d\u00a0\u2028", ".,;:!?-—()[]{}", "עבריתالعربية"]
    letters = [c for p in pools for c in p]
    for _ in range(3000):
        own = pools[r.integers(len(pools))]
        text = "".join(letters[r.integers(len(letters))] if r.random() < 0.3 else own[r.integers(len(own))] for _ in range(r.integers(0, 60)))
        assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids


def test_heavy_anchors_and_big_tiles_give_the_same_rows(written, monkeypatch):
    """Strings grouped anew, and tiles cut into small blocks with many turns, change nothing."""
    key = lambda r: tuple(map(str, r))
    repeats, links = (sorted(map(key, f(written).collect())) for f in (suffix_dedup.repeats_report, jaccard.component_report))
    monkeypatch.setattr(suffix_dedup, "HEAVY", 2)
    assert sorted(map(key, suffix_dedup.repeats_report(written).collect())) == repeats
    for name, value in (("SMALL", 2), ("BLOCK", 3), ("LIMIT", 1), ("WIDELY", 8)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(map(key, jaccard.component_report(written).collect())) == links


def test_values(spark):
    assert [r["x"] for r in values(spark, "x", ["a", "b"]).collect()] == ["a", "b"]


def test_a_pair_of_many_tiles_comes_once(spark):
    """Classes that share several large tiles give a pair in the first one only, and in each tile that must be asked again the rest."""
    sets = [np.sort(np.r_[np.arange(1, 41), 1000 + i]).astype(np.uint64) << np.uint64(21) for i in range(12)]
    bits = spark.createDataFrame([(i, len(s), jaccard.bitmap(s)) for i, s in enumerate(sets)], "class long, n int, bits binary")
    members = spark.createDataFrame([(key, i, 41, i, True) for key in (7, 8, 9) for i in range(12)], "key long, class long, n int, label long, probe boolean")
    pairs = lambda limit: [(r["a"], r["b"]) for r in jaccard.bounded_in_tiles(jaccard.dealt_tiles(members).repartition(3), bits.select("class", "bits"), limit).where("a is not null").collect()]
    every = pairs(100)
    assert len(every) == len(set(every)) == 66
    few = jaccard.bounded_in_tiles(jaccard.dealt_tiles(members), bits.select("class", "bits"), 2).collect()
    assert len([r for r in few if r["a"] is not None]) == 1 + 10 * 2 and {r["key"] for r in few if r["a"] is None} == {7}
    for s in sets[:2] + [np.arange(1, 5000, dtype=np.uint64) << np.uint64(21)]:
        packed = pa.py_buffer(jaccard.bitmap(s))
        assert int(np.bitwise_count(jaccard.unpacked(packed, len(s))).sum()) == len(set(((s >> np.uint64(20)).astype(np.int64) & (64 * jaccard.words_of(len(s)) - 1)).tolist()))


def test_bitmaps_are_made_for_the_listed_rows_only(spark, tmp_path):
    texts = [" ".join(f"w{(k * 7 + i) % 40}" for i in range(30 + k)) for k in range(6)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    keyed = jaccard.with_row(spark.read.parquet(str(tmp_path / "d")), "row")
    described, _ = jaccard.describe(keyed)
    assert described.columns == ["row", "doc_id", "n", "class"]
    assert jaccard.prefixes(keyed, (np.zeros(0, np.uint64), np.zeros(0, bool))).columns == ["key", "class", "n", "salt"]  # zeros last, which compress best
    some = described.where("doc_id % 2 = 0")
    got = {r["class"]: (r["n"], r["bits"]) for r in jaccard.bitmaps(keyed, some.select("row")).collect()}
    assert {c: n for c, (n, _) in got.items()} == {r["class"]: r["n"] for r in some.collect()} and len(got) == 3
    sets = [s for s in jaccard.shingle_sets(*jaccard.utf8(pa.array(texts)), jaccard.Powers())]
    assert all(bytes(got[jaccard.class_of(s)][1]) == jaccard.bitmap(s) for s in sets[::2])


def test_short_bitmaps_bound_every_link_and_few_others():
    """Half a byte for each shingle, no link is out at any fold, and of pairs at 0.69 few are left."""
    r, kept = np.random.default_rng(7), 0
    for n in (1, 2, 7, 41, 300, 1000, 1000, 5000):
        for _ in range(25):
            pool = r.integers(0, 1 << 63, 3 * n, np.uint64, endpoint=True)
            common = jaccard.needed(n, n)  # the least at which sets of n link
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:common], pool[n : 2 * n - common]])
            x, y = (jaccard.unpacked(pa.py_buffer(jaccard.bitmap(s)), n) for s in (a, b))
            assert 8 * x.shape[1] <= max(32, n // 2)
            for words in {x.shape[1], max(1, x.shape[1] // 2), 1}:
                assert jaccard.within_bound(n, n, jaccard.fold(x, words), jaccard.fold(y, words)).all()
            if n == 1000:
                b = np.unique(np.r_[pool[:817], pool[n : 2 * n - 817]])  # 817 of 1183
                kept += int(jaccard.within_bound(n, n, x, jaccard.unpacked(pa.py_buffer(jaccard.bitmap(b)), n)).sum())
    assert kept <= 5


def test_shuffled_data_of_written_tables_is_released(spark):
    if spark.sparkContext.master.startswith("local-cluster"):
        pytest.skip("counts this process's blocks")
    here = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {p.name for p in here.rglob("shuffle_*.data")}
    before = files()
    common.stored(spark.range(10_000).withColumn("k", F.col("id") % 97).repartition(5, "k"))
    made, ends = files() - before, time.time() + 30
    assert made
    while made & files() and time.time() < ends:
        common.release(spark)
        time.sleep(0.5)
    assert not made & files()
