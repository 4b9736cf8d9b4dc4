"""Small cases of every operator: brute force, round trips, nulls, ties, empty tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidegap.llm import ann, langid, lines, minhash, mixing, pieces, quality, secrets, tokens, warc
from tidegap.llm.common import durable

KIND = "doc_id long, text string, lang string, source string, n_chars long, node string"
WORDS = "the of and to in is that for it with was on by this from or as at be are".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "a", "er", "ing", str(r.randint(0, 99))]) for _ in range(n))


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


ODD = [None, "", " \n\t", "a", "é ü 中文 👍", "x" * 5000, "word " * 3000, "line\n" * 50, " \x1c\x00 a", "<|endoftext|> b", "▁ ▁▁x"]


def test_pieces_agree_with_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    d = docs(spark, [*ODD, prose(200, 1), prose(200, 1)])
    out = {r["doc_id"]: r for r in pieces.encode(d, path).collect()}
    for r in d.collect():
        want = sp.encode(r["text"] or "")
        assert list(out[r["doc_id"]]["tokens"]) == want
        assert out[r["doc_id"]]["n_tokens"] == len(want)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(d, path), path).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "").replace("▁", " ") for r in d.collect())
    assert pieces.encode(d.limit(0), path).count() == 0


def test_token_counts_agree_with_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    d = docs(spark, [*ODD, prose(300, 2), "long " + "ab" * 40_000 + " run", (prose(50, 3) + "  \n") * 300])
    for r in tokens.count_tokens(d, path).join(d.select("doc_id", "text"), "doc_id").collect():
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len((r["text"] or "").encode()))


def test_segments_join_to_the_text():
    text = " \n" + prose(5000, 4) + "\n\n" + "y" * 50_000 + " \t"
    assert "".join(tokens.segments(text)) == text
    counter = tokens.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    alphabet = ["a", "B", "é", "9", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", "中", "."]
    r = random.Random(5)
    texts = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(300)]
    want = [len(e.ids) for e in counter.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert counter.count(texts) == want


def fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * w[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("counts", [{"a": 900, "b": 10, "c": 10, "d": 5}, {"a": 5, "b": 5, "c": 5}, {"a": 0, "b": 40, None: 7}, {"x": 30}])
def test_targets_by_resharing(spark, counts):
    rows = [("w " * 3, s) for s, n in counts.items() for _ in range(n)] + [(None, s) for s in counts]
    d = docs(spark, [t for t, _ in rows], [s for _, s in rows])
    out = mixing.mix_sources(d).collect()
    want = fill({s: 3 * n for s, n in counts.items()})
    assert len(out) == len(rows)
    for s, target in want.items():
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 3
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_mix_edges(spark):
    assert mixing.mix_sources(docs(spark, ["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(docs(spark, [None, ""])).collect()] == [0, 0]


def test_language_gradient_and_edges(spark):
    net = langid.Network(["a", "b"], hidden=3)
    r = np.random.RandomState(0)
    x, y = r.randint(97, 110, (6, 5)), np.array([0, 1, 0, 1, 1])

    def loss(n):
        p = n.probabilities(x).astype(np.float64)
        return -np.log(p[y, :, np.arange(5)]).mean()

    grad = net.gradient(x, y)
    for k in ("out", "f_cand", "b_gates", "f_table"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        w = net.weights[k]
        old, step = w[at], np.float32(1e-2)
        w[at] = old + step
        up = loss(net)
        w[at] = old - step
        down = loss(net)
        w[at] = old
        assert abs((up - down) / (2 * step) - grad[k][at]) < 0.05 * abs(grad[k][at]) + 1e-3
    out = langid.identify(docs(spark, ODD), net).collect()
    assert [r["lang_pred"] for r in out[:3]] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.train(docs(spark, ["a"]).limit(0)) is None
    assert [r["lang_pred"] for r in langid.identify(docs(spark, ["a"]), None).collect()] == ["und"]


def test_windows_do_not_mix_texts():
    net = langid.Network(["a", "b", "c"])
    texts = [prose(n, n).encode() for n in (1, 3, 60, 400)]
    together = net.label(texts)[1]
    for t, p in zip(texts, together):
        assert np.allclose(net.label([t])[1][0], p, atol=1e-5)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(d, langid.train(d), ("doc_id", "lang"))
    rows = out.collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    assert [r["h"] for r in out.select(langid.held_out(F.col("doc_id")).alias("h")).collect()] == held
    right = [r["lang"] == r["lang_pred"] for r, h in zip(rows, held) if h]
    assert np.mean(right) > 0.95


def test_nearest_recall_and_ties(spark):
    r = np.random.RandomState(1)
    v = r.normal(size=(3000, 16)).tolist()
    v[7] = v[9] = v[100]
    rows = [(i, x) for i, x in enumerate(v)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] + [1.0] * 15), (3150, [None] + [1.0] * 15), (3200, [1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for x in ann.search_table(t).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    m = np.array(v)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5]
        got = sorted(out[q])
        assert [a for a, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(s[i] - c) < 1e-12 for _, i, c in got)
        hits += len({i for _, i, _ in got} & set(want.tolist()))
        total += 5
    assert hits / total > 0.9
    assert [i for _, i, _ in sorted(out[100])[:2]] == [7, 9]
    assert not {3000, 3050, 3100, 3150, 3200} & set(out)
    few = ann.search_table(spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], t.schema)).collect()
    assert [(x["query_id"], x["vec_id"]) for x in few] == [(0, 1)]
    assert ann.search_table(t.limit(0)).count() == 0


def test_nearest_recall_over_blocks_and_groups(spark, monkeypatch):
    """Recall of collisions: several blocks and groups, a sample of 300 rows for bounds only."""
    monkeypatch.setattr(ann, "BLOCK", 6000)
    monkeypatch.setattr(ann, "QUERY_GROUP", 200)
    monkeypatch.setattr(ann, "PILOT", 300)
    r = np.random.RandomState(4)
    n = 24_000
    m = np.concatenate([r.normal(size=(n // 2, 24)), r.normal(size=(60, 24))[r.randint(0, 60, n // 2)] + r.normal(0, 0.4, (n // 2, 24))])
    t = spark.createDataFrame([(i, x) for i, x in enumerate(m.tolist())], "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(0)).withColumn("uid", F.lit(None).cast("int"))
    out = {}
    for x in ann.search_table(t).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hits = {True: [], False: []}
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -9
        got = sorted(out[q])
        assert [a for a, _, _ in got] == [1, 2, 3, 4, 5] and all(abs(s[i] - c) < 1e-12 for _, i, c in got)
        hits[q < n // 2].append(len({i for _, i, _ in got} & set(np.argsort(-s)[:5].tolist())) / 5)
    assert np.mean(hits[True]) > 0.93 and np.mean(hits[False]) > 0.93


def test_nearest_repeated_queries_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (None, [0.0, 1.0])]
    out = ann.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x["rank"], x["vec_id"] is None, x["vec_id"]) for x in out if x["vec_id"] is not None) == sorted([(1, False, 0), (2, False, 1), (3, False, 2)] * 2)
    assert {x["query_id"] for x in out} == {0}


def lines_by_hand(rows):
    """A plain model for passages of 50 words at most: every chunk seen before goes, be it
    one of several lines or a long line."""
    out, seen = [], set()
    for text in rows:
        keep = []
        for chunk in by_rule(text):
            if len([x for x in chunk if x.strip()]) > 1 or len(chunk[0]) >= 120 and chunk[0].strip():
                if "\n".join(chunk) in seen:
                    continue
                seen.add("\n".join(chunk))
            keep += chunk
        out.append(text and "\n".join(keep))
    return out


def by_rule(text):
    """Chunks by the definition: a boundary after a line where the rolling hash of it and the
    line before says so and two lines of the chunk aren't blank."""
    import xxhash

    out, run = [], []
    rolling = 0
    for line in (text or "").split("\n"):
        if len(line) >= 120:
            out += [run, [line]] if run else [[line]]
            run, rolling = [], 0
            continue
        run.append(line)
        h = xxhash.xxh3_64_intdigest(line.encode())
        window = (rolling * 0x9E3779B97F4A7C15 + h) % 2**64
        rolling = h
        if (window // 2**40) % 3 == 0 and sum(bool(x.strip()) for x in run) > 1 or len(run) == 64:
            out.append(run)
            run = []
    return [*out, run] if run else out


def test_lines_by_an_independent_model(spark):
    r = random.Random(12)
    pool = ["\n".join(f"{r.choice(WORDS)} {r.randint(0, 9)}" for _ in range(r.randint(2, 6))) for _ in range(30)]
    texts = []
    for _ in range(60):
        parts = [r.choice(pool) if r.random() < 0.5 else f"own {r.randint(0, 10**6)}" for _ in range(4)]
        texts.append("\n".join(parts)[:150].rsplit("\n", 1)[0])
    texts = [t for t in texts if len(t.split()) <= 50]
    out = sorted(lines.dedup_lines(docs(spark, texts)).collect(), key=lambda x: x["doc_id"])
    assert [x["text"] for x in out] == lines_by_hand(texts)
    assert sum(x["n_removed_lines"] for x in out) > 50
    short = ["a b\nc d", "x\ny", "a b\nc d"]
    assert [x["text"] for x in lines.dedup_lines(docs(spark, short)).orderBy("doc_id").collect()] == ["a b\nc d", "x\ny", ""]


def test_lines_with_hash_clashes(spark):
    """Hashes of few bits: chunks that clash are kept, and whatever goes stands elsewhere before."""
    texts = ["\n".join(f"line {(i * 7 + j) % 40} of a text" for j in range(8)) for i in range(40)]
    whole = {x["doc_id"]: x for x in lines.dedup_lines(docs(spark, texts)).collect()}
    some = {x["doc_id"]: x for x in lines.dedup_lines(docs(spark, texts), bits=6).collect()}
    gone = [sum(x["n_removed_lines"] for x in d.values()) for d in (some, whole)]
    assert gone[0] < gone[1]
    seen = set()
    for i, t in enumerate(texts):
        kept, pairs = some[i]["text"].split("\n"), list(zip(t.split("\n"), t.split("\n")[1:]))
        if some[i]["n_removed_lines"]:
            assert any(p in seen for p in pairs) and set(kept) <= {"", *t.split("\n")}
        seen.update(pairs)


def test_lines_brute_force(spark):
    passage = "shared first line of it\nshared second line of it, longer\nand a third one here"
    texts = [None, "", prose(30, 1) + "\n" + passage, passage + "\n" + prose(20, 2), prose(60, 3), prose(60, 3) + "\nown", "\n".join(f"short {i} of nine" for i in range(40))] * 2
    d = docs(spark, texts)
    out = sorted(lines.dedup_lines(d).collect(), key=lambda r: r["doc_id"])
    seen, want = set(), []
    for t in texts:
        kept = []
        for c, may in lines.chunks(t or ""):
            if not (may and c in seen):
                kept.append(c)
            if may:
                seen.add(c)
        want.append(None if t is None else "\n".join(kept))
    assert [r["text"] for r in out] == want
    assert [r["n_chars"] for r in out] == [None if w is None else len(w) for w in want]
    assert lines.dedup_lines(d.limit(0)).count() == 0
    assert all("\n".join(c for c, _ in lines.chunks(t)) == t for t in texts if t is not None)


def test_chunks_resist_shifts():
    body = [f"line {i} of the body" for i in range(60)]
    a = {c for c, _ in lines.chunks("\n".join(body))}
    b = {c for c, _ in lines.chunks("\n".join(["new first line", *body]))}
    assert len(a & b) >= len(a) - 2


def wordy(r, n):
    return " ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 7))) for _ in range(n))


def test_lines_remove_whole_passages(spark):
    r = random.Random(6)
    texts, passages = [], []
    for n in (2, 4, 6, 7, 10, 4, 7, 10):
        passage = [wordy(r, 60 // n + 1) for _ in range(n)]
        if n == 10:  # single short lines between and beside long ones
            passage[0], passage[4] = wordy(r, 40), wordy(r, 40)
        for k in (0, 2, 5):
            around = [wordy(r, 8) for _ in range(5)]
            texts.append("\n".join([*around[:k], *passage, *around[k:]]))
            passages.append(("\n".join(passage), "\n".join(around)))
    out = sorted(lines.dedup_lines(docs(spark, texts)).collect(), key=lambda x: x["doc_id"])
    for i, (x, (passage, around)) in enumerate(zip(out, passages)):
        assert x["text"] == (texts[i] if i % 3 == 0 else around)
        assert x["n_removed_lines"] == (0 if i % 3 == 0 else passage.count("\n") + 1)


def test_lines_of_rows_that_share_a_doc_id(spark):
    long = [prose(40, i) for i in range(6)]
    rows = [(1, "\n".join(long[:4])), (1, long[4]), (1, None), (1, "\n".join([long[5], long[3]])), (2, "\n".join([long[4], "own", long[0]])), (2, "\n".join([long[5], "else"])), (2, "own")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], KIND)
    out = [r["text"] for r in lines.dedup_lines(d).where("doc_id = 2").collect()]
    assert sorted(out) == ["else", "own", "own"]
    first = [r["text"] for r in lines.dedup_lines(d).where("doc_id = 1").collect()]
    kept = [x for t in first if t for x in t.split("\n")]
    assert None in first and sorted(kept) == sorted(long)


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "WARC/1.0\r\n\r\n" * 3, "é" * 1000, "<p>a</p>", "\r\n\r\nx\r\n"]
    t = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(7, "http://h/7", html[7])], "page_id long, url string, html string")
    out = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(t).collect())
    last = {h or "": i for i, h in enumerate(html)}
    rows = [(i, h or "") for i, h in enumerate(html)] + [(7, html[7])]
    want = [(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in rows]
    assert out == sorted(want, key=lambda x: x[:3])
    warc.write_archives(t, f"{tmp_path}/w")
    records = durable(warc.read_records(spark, f"{tmp_path}/w", payload=True))
    assert records.where("record_type = 'request'").count() == len(rows)
    one = warc.assemble(records).where("metadata.page_id = 5").head()
    assert bytes(one["main"]["payload"]).decode() == html[5] and one["request"]["http"].startswith("GET /5 ")
    assert warc.round_trip(t.limit(0)).count() == 0


def test_warc_odd_rows(spark, monkeypatch):
    long = "<p>" + "é☃" * 400_000 + "</p>"
    rows = [(1, "http://[abc", "a"), (2, None, "a"), (3, "http://h/ü?q", "b"), (None, "http://h/", "c"), (None, None, "c"), (4, "http://h/4", long), (5, "http://h/5", long), (6, "", None), (None, "x", None)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("size", F.lit(1)).withColumn("salt", F.lit(1)).withColumn("original", F.lit(1))
    monkeypatch.setattr(warc, "LARGE", 1 << 10)
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 10)
    out = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["intact"]) for r in warc.round_trip(t).collect()), key=repr)
    size = len(long.encode())
    want = [(1, 1, "revisit", 2, None), (2, 1, "response", None, True), (3, 1, "response", None, True), (None, 1, "response", None, True), (None, 1, "response", None, True), (4, size, "revisit", 5, None), (5, size, "response", None, True), (6, 0, "response", None, True), (None, 0, "revisit", 6, None)]
    assert out == sorted(want, key=repr)
    assert warc.request_of("http://[abc") == ("", "/") and warc.request_of("http://h/a?b") == ("h", "/a?b")


def test_quality_counts(spark):
    texts = [*ODD, prose(80, 1), "a b c " * 40, prose(60, 2) + "\nx\nx\nx\n #$%", "".join(chr(33 + (i * 7919) % 90) for i in range(3000))]
    for r in quality.quality(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        ws = t.encode().split()
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 500 else set(range(len(ws)))
        rows = [x for x in t.split("\n") if x.encode().split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(ws), len(hit), len(rows) - len(set(rows)))
        assert r["word_chars"] == sum(len(w.decode()) for w in ws)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(docs(spark, ["a"]).limit(0)).count() == 0


def noise(r, n, alphabet):
    out = ""
    while len(out) < n:
        out += "".join(r.choice(alphabet) for _ in range(r.randint(2, 9))) + " "
    return out[:n]


def test_quality_rejects_noise(spark):
    r = random.Random(8)
    letters = [chr(c) for c in range(97, 123)]
    base64_ = [*letters, *(x.upper() for x in letters), *"0123456789+/"]
    printable = [chr(c) for c in range(33, 127)]
    texts = [noise(r, n, a) for n in (512, 700, 1024, 2000, 4000, 4096, 9000, 60_000) for a in (base64_, printable)]
    texts += [noise(r, n, letters) for n in (4097, 9000, 60_000)]
    rows = quality.quality(docs(spark, texts)).collect()
    assert not any(x["base_failed"] or x["kept"] for x in rows)
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False).compress
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 9000").orderBy("doc_id").head()["text"].encode()
    assert quality.in_bands(text, compress)[1:] == (0.0, True)
    mixed = text[:4096] + noise(r, 3000, printable).encode()
    assert quality.in_bands(mixed, compress)[1] == 3000 / 7096
    mixed = text[:8192] + noise(r, 8192, printable).encode() + noise(r, 1000, printable).encode()
    assert not quality.in_bands(mixed, compress)[2]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in found and found[0, False] > 0.2 * found[0, True]


def test_quality_rejects_repetition_and_strewn_symbols(spark):
    r = random.Random(9)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars between 6000 and 9000").orderBy("doc_id").head()["text"]
    strewn = " ".join(w + r.choice(("###", "%%%", "&&&", "***")) for w in base.split())
    again = "\n".join(f"{i} {base[at : at + 90]}" for i, at in enumerate(r.choice((0, 100, 200, 300)) for _ in range(60)))
    out = {x["doc_id"]: x for x in quality.quality(docs(spark, [base, strewn, again])).collect()}
    assert [out[i]["kept"] for i in range(3)] == [True, False, False]
    assert not out[1]["base_failed"]


def test_quality_verdict_by_brute_force(spark):
    """Ratios and verdict by another library's compressor at the same level, band edges included."""
    import pyarrow as pa

    r = random.Random(10)
    texts = [*ODD, *(prose(n, n) for n in (50, 60, 200, 700, 1500)), noise(r, 5000, "ab"), noise(r, 9000, [chr(c) for c in range(33, 127)]), prose(60, 1) + "\n" + noise(r, 4000, "xyz")]
    codec = pa.Codec("zstd", compression_level=quality.LEVEL)
    for x in quality.quality(docs(spark, texts)).collect():
        data = (texts[x["doc_id"]] or "").encode()
        if not data:
            assert (x["ratio"], x["bad_chunk_share"], x["kept"]) == (0, 0, False)
            continue
        ratio = codec.compress(data, asbytes=True)
        assert abs(x["ratio"] * len(data) - len(ratio)) <= 12  # the frame's header differs
        lo, hi = next((a, b) for top, a, b in quality.BANDS if top is None or len(data) <= top)
        want = lo <= x["ratio"] <= hi and x["bad_chunk_share"] <= 0.5 and not x["base_failed"]
        assert x["kept"] == want
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL, write_checksum=False, write_content_size=False).compress
    data = prose(300, 3).encode()
    ratio = len(compress(data)) / len(data)
    for band, ok in (((None, ratio, ratio),), True), (((None, ratio + 1e-9, 1.0),), False), (((None, 0.0, ratio - 1e-9),), False):
        assert quality.in_bands(data, compress, band)[2] == ok
    two = prose(3000, 4).encode()[: 2 * quality.CHUNK]
    shares = [len(compress(two[i : i + quality.CHUNK])) / quality.CHUNK for i in (0, quality.CHUNK)]
    edge = quality.in_bands(two, compress, ((None, 0, 1),), (min(shares) + 1e-9, 1.0))
    assert edge[1:] == (0.5, True)


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().split()
        w = [x.lower() for x in w]
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label, sets


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash_brute_force(spark, size, percent):
    r = random.Random(size)
    texts = [*ODD, "two words", "Two Words", prose(100, 1).upper()]
    for k in range(12):
        base = prose(150, k).split()
        for _ in range(30 if k == 0 else 3):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = f"e{r.randint(0, 999)}"
            texts.append(" ".join(copy))
    texts += texts[-5:]
    label, sets = brute_components(texts, size, percent)
    out = sorted(minhash.near_duplicates(docs(spark, texts), size, percent).collect())
    assert [(x["component_id"], x["n_shingles"], x["kept"]) for x in out] == [(a, len(s), a == i) for i, (a, s) in enumerate(zip(label, sets))]
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_minhash_copies_beyond_the_limit(spark):
    r = random.Random(3)
    base = prose(150, 1).split()
    texts = [" ".join(base)]
    for n in range(60):
        copy = list(base)
        for _ in range(n % 15):
            copy[r.randrange(len(copy))] = r.choice(WORDS)
        texts.append(" ".join(copy))
        if n % 5 == 0:  # a chain away from the original
            copy[r.randrange(len(copy))] = "own"
            texts.append(" ".join(copy))
    label, _ = brute_components(texts, 3, 85)
    out = sorted(minhash.near_duplicates(docs(spark, texts), 3, 85).collect())
    assert [x["component_id"] for x in out] == label
    assert len(set(label)) > 10


def test_secrets(spark):
    text = "id AKIA" + "A" * 16 + " key " + "b" * 20 + "Q" * 25 + " at https://s3.example.com/x token=abc secret: 'longvalue1' " + "0f" * 12
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, [text, None, "", "https://a.example " + "b" * 20 + "Q" * 25, "secret=token:longvalue1"])).collect()}
    assert (rows[0]["n_assign"], rows[0]["n_access"], rows[0]["n_hex"]) == (1, 1, 1)
    assert "weak_secret" in rows[0]["spans"] and "endpoint" in rows[0]["spans"]
    assert rows[1]["spans"] == rows[2]["spans"] == rows[3]["spans"] == rows[4]["spans"] == ""
    at = text.index("secret: ")
    assert f"assign:{at}:{at + len(chr(39).join(['secret: ', 'longvalue1']))}" in rows[0]["spans"]
    assert secrets.scan_secrets(docs(spark, ["a"]).limit(0)).count() == 0


def brute_secrets(text, scope=200):
    """Spans by patterns of their own and a comparison of all parts."""
    import re

    patterns = {
        "assign": (r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        "access": (r"(AKIA[A-Z0-9]+)", 20), "hex": (r"([0-9a-f]+)", 24), "weak_id": (r"((?:ASIA|AROA|AIDA)[A-Z0-9]{12,})", 0),
        "weak_secret": (r"([A-Za-z0-9+/]{40,})", 0), "endpoint": (r"(https?://[A-Za-z0-9._:/-]+)", 0),
    }
    parts = [(k, m.start(), m.end()) for k, (p, least) in patterns.items() for m in re.finditer(p, text) if len(m[1]) >= least]
    strong = ("assign", "access", "hex")
    free = [x for x in parts if x[0] in strong or not any(y[0] in strong and y[1] < x[2] and y[2] > x[1] for y in parts)]
    needs = {"weak_id": ("assign", "hex", "weak_secret"), "weak_secret": ("access", "weak_id"), "endpoint": ("access", "weak_id")}
    kept = [x for x in free if x[0] in strong or any(y[0] in needs[x[0]] and y[1] <= x[2] + scope and y[2] >= x[1] - scope for y in free)]
    kept.sort(key=lambda x: (x[1], [*strong, *needs].index(x[0])))
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in kept if k in strong)
    return [sum(x[0] == k for x in kept) for k in strong], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in kept)


def test_secrets_brute_force(spark):
    r = random.Random(13)
    bits = ["AKIA" + "B7" * 8, "ASIA" + "C9" * 8, "ab12" * 6, "Zz9/" * 11, "https://e.example/x", "Token = 'abcdef-1'", "API_KEY:\"q.w=e+r\"", "passwd=AKIA" + "D" * 20, "secret: https://h.example/abc", "é☃👍", "\n", "password", "x" * 90, "y " * 60]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(300)] + [*ODD]
    # edges of the scope: just in reach and one beyond, on both sides
    for n in (200, 201):
        texts += ["ASIA" + "C9" * 8 + " " * n + "ab12" * 6, "ab12" * 6 + " " * n + "ASIA" + "C9" * 8]
    for x in secrets.scan_secrets(docs(spark, texts)).collect():
        counts, sha, spans = brute_secrets(texts[x["doc_id"]] or "")
        assert ([x["n_assign"], x["n_access"], x["n_hex"]], x["base_sha256"], x["spans"]) == (counts, sha, spans), texts[x["doc_id"]]


def test_secrets_of_a_dump_are_linked_in_linear_time(spark):
    text = "\n".join(f"https://h.example/{i} ASIA{'C9' * 8}" for i in range(30_000))
    x = secrets.scan_secrets(docs(spark, [text, text + " " + "Zz9/" * 11])).orderBy("doc_id").collect()
    assert x[0]["spans"].count("endpoint:") == 30_000 and x[0]["spans"].count("weak_id") == 0
    assert x[1]["spans"].count("weak_secret") == 1 and 1 < x[1]["spans"].count("weak_id") < 20


def test_language_sample_is_shared_by_languages(spark):
    rows = [(i, "common words here", "big") for i in range(20_000)] + [(i, "seldom other text", "rare") for i in range(20_000, 20_006)]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40, chars=None)
    assert net.langs == ["big", "rare"]
    out = langid.identify(spark.createDataFrame([(1, "seldom other text"), (2, "common words here"), (3, "seldom " * 40_000)], "doc_id long, text string"), net).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out[:2]] == ["rare", "big"] and len(out) == 3


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidegap.llm.common import clean, shared_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(far)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = durable(spark.range(3))
    clean(spark)
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        spark.read.parquet(table.written_at).count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = d
        d = durable(stage(spark, d, ""), name)
        assert d.columns == before.columns and 0.8 * before.count() <= d.count() <= 3 * before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, d, "")
    assert out.count() == d.count() and out.where("not round_trip").count() == 0


def brute_mix(rows):
    """doc_id: repeats. Documents of a source in the order of their hashes fill its budget."""
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    out = {}
    for s, target in fill(total).items():
        base = min(int(target // total[s]), 3) if total[s] else 0
        rest, sofar, full = target - base * total[s], 0, False
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]):
            fits = not full and sofar + size[i] <= rest
            if not full and not fits:  # the document at the boundary goes in if that is nearer
                fits, full = sofar + size[i] - rest < rest - sofar and rest > 0, True
            sofar += size[i]
            out[i] = min(base + bool(fits and rest > 0), 3)
    return {i: n if size[i] else 1 for i, n in out.items()}


def test_pipeline_by_brute_force(spark):
    """Each stage against a plain version of it on that stage's own input."""
    import corpus_pipeline
    import sentencepiece

    r = random.Random(14)
    other = "der die und das nicht ein ich ist es mit auf von zu den wir sie".split()
    pool = ["\n".join(f"{r.choice(WORDS)} {r.randint(0, 9)} {r.choice(WORDS)}" for _ in range(3)) for _ in range(6)]
    rows = []
    for i in range(90):
        words = WORDS if i % 3 else other
        text = " ".join(r.choice(words) + r.choice(("", "", "a", "x")) for _ in range(r.randint(6, 40)))
        if i % 7 == 0 and rows:
            text = rows[r.randrange(len(rows))][1]
        rows.append((i, f"{text}\n{r.choice(pool)}" if i % 4 == 0 and len(text.split()) < 30 else text, ("en", "de")[words is other], "abc"[i % 3]))
    rows += [(90, None, "en", None), (91, "", "en", "a"), (92, "12 34", None, "b")]
    d = spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(d.collect(), key=lambda x: x["doc_id"])
        texts = [x["text"] for x in before]
        net = langid.train(d) if name == "language_id" else None
        d = durable(stage(spark, d, ""), name)
        got = sorted(d.collect(), key=lambda x: x["doc_id"])
        if name == "language_id":
            want = []
            for x in before:
                low = (x["text"] or "").lower()
                if any(c.isalpha() for c in low):
                    code = np.frombuffer(low.encode(), np.uint8)[:, None].astype(np.int64)
                    want += [x["doc_id"]] if net.probabilities(code).mean(axis=(1, 2)).max() >= corpus_pipeline.LEAST_SCORE else []
            assert [x["doc_id"] for x in got] == want and len(want) > 60
        elif name == "line_dedup":
            assert [x["text"] for x in got] == lines_by_hand(texts) and any(x["text"] != t for x, t in zip(got, texts))
        elif name == "near_dedup":
            label, sets = brute_components(texts, 5, 80)
            assert [x["doc_id"] for x in got] == [x["doc_id"] for i, x in enumerate(before) if label[i] == i] and len(got) < len(before)
        elif name == "mix":
            times = brute_mix([(x["doc_id"], x["text"], x["source"]) for x in before])
            assert [x["doc_id"] for x in got] == [i for i in sorted(times) for _ in range(times[i])]
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert [list(x["tokens"]) for x in got] == [sp.encode(t or "") for t in texts]


def test_near_dedup_judges_rows_by_their_texts(spark):
    import corpus_pipeline

    a, b, c, e, f, g = (prose(60, i) for i in range(20, 26))
    rows = [(None, a), (None, b), (None, ""), (None, None), (1, c), (1, e), (2, f), (2, f), (3, e), (3, g), (None, g + " end"), (4, ""), (4, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], KIND)
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect()]
    assert sorted(map(repr, out)) == sorted(map(repr, [*rows[:7], rows[9], *rows[11:]]))


CLASHES = "score lang_pred n_chunks n_removed_chunks _marks _doc _text hash count kept node comp size repeats taken _id _repeats _copy n_words _d a.b".split()


def clashing(spark, texts):
    """Documents with columns that have names of results and of inner columns."""
    return docs(spark, texts).drop("node").select("*", *[F.col("doc_id").alias(c) for c in CLASHES])


def test_names_may_clash(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, prose(80, 1), prose(80, 1), prose(90, 2) + "\n" + prose(90, 3)]
    d, plain = clashing(spark, texts), docs(spark, texts)
    apply = [
        lambda x: mixing.mix_sources(x), lambda x: minhash.near_duplicates(x), lambda x: quality.quality(x), lambda x: secrets.scan_secrets(x),
        lambda x: tokens.count_tokens(x, path), lambda x: pieces.encode(x, public_tokenizers.path("piece_bpe_32k.model")),
        lambda x: lines.dedup_lines(x).select("doc_id", "text", *lines.COUNTS), lambda x: langid.identify(x, langid.Network(["a", "b"])),
    ]
    for f in apply:
        assert sorted(map(repr, f(d).collect())) == sorted(map(repr, f(plain).collect()))


def test_pipeline_stages_on_clashing_names_nulls_and_nothing(spark):
    import corpus_pipeline

    odd = docs(spark, [None, "", prose(60, 1)]).drop("node").select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    d = clashing(spark, [*ODD, *(prose(70, i) for i in range(12)), prose(70, 3)])
    d = d.union(odd.select("*", *[F.lit(None).cast("long").alias(c) for c in CLASHES]))
    for start in (d, d.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept.columns, durable(stage(spark, kept, ""), name)
            assert name == "tokenize" or kept.columns == before
        assert (kept.count() > 0) == (start is d)
        assert kept.where("not round_trip").count() == 0
