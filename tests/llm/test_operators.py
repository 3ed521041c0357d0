"""Each operator on the cases that its docstring names: nulls, empty and long texts, repeated rows, empty tables and
clashing columns; against brute force where SQL has no word for it."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintlake.llm import common, decontamination, language_id, license_scan, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, warc
from tintlake.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", size long, score double, hits string, s string, gone string, n string, node string, rank int"
LABELS = "doc_id long, quality int, toxic int"


def words(n, seed, alphabet="abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randint(2, 7))) for _ in range(n)]


def text(n, seed):
    return " ".join(words(n, seed))


def odd_rows():
    """Rows that any table may hold."""
    long_line = " ".join(words(30_000, 99))
    return [
        (None, text(60, 1), None, None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, "b", 3), (4, long_line, "en", None, 5),
        (5, "x" * 200_000, "de", "b", 5), (6, text(80, 2), "en", "a", 5), (6, text(80, 2), "en", "a", 5), (7, text(80, 2), "en", "c", 5), (8, "日本語 текст mixed words", "fr", "c", 4),
        (8, text(70, 5), "fr", "c", 4), (9, "\n\n" + text(60, 6) + "\n", "es", "é", 4), (10, "7 8 9 !!! ***", None, "b", 1), (None, None, None, None, None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, 0.5, "h", "s", "g", "n", "o", 3) for r in odd_rows()]
    return spark.createDataFrame(rows, DOCS + CLASH)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS + CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i % 10, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], LABELS)


# ---------------------------------------------------------------- 1


def test_language_spans(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = language_id.train(docs, 500)
    by = defaultdict(list)
    for r in docs.where("lang IN ('en', 'de')").select("lang", "text").collect():
        if len(r.text) > 300:
            by[r.lang].append(" ".join(r.text.split()[:40]))
    mixed = by["en"][3] + ". " + by["de"][3] + "."
    found = language_id.identify([mixed], model)[0]
    assert [s["lang"] for s in found["spans"]] == ["en", "de"]
    edge = found["spans"][0]["end"]
    assert abs(edge - len(by["en"][3])) < 20 and 0.3 < found["score"] < 0.7


def test_language_accuracy_and_odd_rows(spark, sf, odd, none):
    r = language_id.predict_languages(common.table(spark, sf, "documents")).join(common.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in r) >= 0.97 * len(r)
    got = language_id.predict_languages(odd).collect()
    assert len(got) == len(odd_rows())
    for x in got:
        assert 0 <= x.score <= 1
    und = {x.doc_id for x in got if x.lang_pred == "und"}
    assert {1, 2, 3, 10} <= und
    assert language_id.predict_languages(none).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.substr(1, 0).cast("string")).where("false OR lang IS NULL")
    assert {x.lang_pred for x in language_id.predict_languages(unlabelled).collect()} <= {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7):
        s = rng.normal(size=(n, 3)).astype(np.float32) * 3
        got = language_id.viterbi(s, np.array([n]), 2.0)
        paths = [[]]
        for _ in range(n):
            paths = [[*p, k] for p in paths for k in range(3)]
        cost = lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert cost(list(got)) == pytest.approx(max(map(cost, paths)), abs=1e-4)


def plain_identify(t, model):
    """(lang_pred, score) of a text, letter by letter and word by word."""
    mask, found = (1 << 64) - 1, []
    for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*", t or ""):
        code, scores = [0, 0] + [ord(c.lower()) for c in m[0]] + [0], []
        for lang in range(len(model.langs)):
            total = 0.0
            for i in range(2, len(code)):
                pair = code[i - 1] * 0x110000 + code[i]
                triple = (((code[i - 2] * 0x9E3779B97F4A7C15) & mask) ^ pair) & mask
                total += sum(float(table[((x * 0xD6E8FEB86659FD93) & mask) >> (64 - b.bit_length() + 1)][lang]) for table, x, b in zip(model.tables, (pair, triple), language_id.BUCKETS))
            script = next((k for k, ranges in enumerate(language_id.SCRIPTS.values(), 1) if any(x <= ord(m[0][0]) <= y for x, y in ranges)), 0)
            scores.append(total - (0 if model.allowed[script][lang] else 1e4))
        found.append((len(m[0]), scores))
    if not found:
        return "und", 0.0
    n = len(model.langs)
    value, back = list(found[0][1]), []
    for _, scores in found[1:]:
        back.append([max(range(n), key=lambda k: value[k] - (0 if k == j else model.penalty)) for j in range(n)])
        value = [value[back[-1][j]] - (0 if back[-1][j] == j else model.penalty) + scores[j] for j in range(n)]
    path = [max(range(n), key=value.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    letters = Counter()
    for (size, _), k in zip(found, reversed(path)):
        letters[k] += size
    best = max(range(n), key=lambda k: letters[k])
    return model.langs[best], letters[best] / sum(letters.values())


def test_language_query_matches_a_plain_version(spark, sf):
    docs = common.table(spark, sf, "documents")
    model = language_id.train(docs.where(~common.held_out("doc_id")), 2000)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = QUERIES["op1_language_id"](spark, sf).collect()
    assert len(got) == len(texts)
    some = sorted(got, key=lambda r: len(texts[r.doc_id]))[:120]
    for r in some:
        lang, score = plain_identify(texts[r.doc_id], model)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)


def test_marks_without_a_letter_and_many_languages(spark, sf):
    model = language_id.train(common.table(spark, sf, "documents"), 500)
    got = language_id.identify(["\u0301\u0302 \u0303!", "a\u0301 \u0301", None], model)
    assert [x["lang_pred"] == "und" for x in got] == [True, False, True] and got[0]["score"] == 0.0
    scores = np.zeros((5, 300), np.float32)
    scores[:, 250] = 9.0
    assert language_id.viterbi(scores, np.array([5]), 1.0).tolist() == [250] * 5


def test_lowest_takes_the_least_of_each(spark):
    x = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 60, "b").alias("k"), F.xxhash64("id").alias("h"))
    rows, by = x.collect(), defaultdict(list)
    for r in rows:
        by[r.k].append(r.h)
    got = sorted(((r.k, r.h) for r in common.lowest(x, "k", 100).collect()), key=str)
    assert got == sorted(((k, h) for k, hs in by.items() for h in sorted(hs)[:100]), key=str)


# ---------------------------------------------------------------- 2


def test_quality_separates(spark, sf, odd, none, labels):
    docs, lab = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    r = quality_classifier.score_quality(docs, lab).join(lab, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) >= 0.95 * len(r)
    got = quality_classifier.score_quality(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert quality_classifier.score_quality(none, labels).count() == 0
    assert {x.score for x in quality_classifier.score_quality(odd, labels.where("quality = 1")).collect()} == {0.3}
    assert quality_classifier.keep_quality(odd, labels).columns == odd.columns


def test_quality_query_matches_a_plain_version(spark, sf):
    """The cut is the best one for all labelled documents, and scores follow from the weights alone."""
    docs, lab = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    ranker = quality_classifier.train(docs, lab)
    texts = {r.doc_id: r.text for r in docs.collect()}
    strength = {d: float(((np.array(quality_classifier.features(t)) - ranker.mean) / ranker.scale).clip(-6, 6) @ ranker.weights) for d, t in texts.items()}
    learnt = {r.doc_id: r.quality for r in lab.where(~common.held_out("doc_id")).where("quality IN (0, 1)").collect() if r.doc_id in texts}
    wrong = lambda c: sum((strength[d] >= c) != bool(q) for d, q in learnt.items())
    assert wrong(ranker.cut) <= min(wrong(c) for c in sorted(strength[d] for d in learnt)) + 1  # one bin may hold two
    for r in QUERIES["op2_quality_classifier"](spark, sf).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(strength[r.doc_id] - ranker.cut + math.log(0.3 / 0.7)))), abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_hot_ids_do_not_reach_the_driver(spark):
    """An id that most rows repeat is one row of the sample."""
    rows = [(7, text(60, i % 5)) for i in range(3000)] + [(i, text(60, i) + (" !!! $$$" if i % 2 else "")) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(7, 1, 0)] + [(i, 1 - i % 2, 0) for i in range(100, 400)], LABELS)
    r = quality_classifier.score_quality(docs, lab).where("doc_id >= 100").collect()
    assert len(r) == 300 and sum(x.predicted == 1 - x.doc_id % 2 for x in r) >= 290


def test_pairs_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=400) > 0.8).astype(int)
    m = quality_classifier.fit(x, y)
    s = m.strengths(x)
    edges = np.linspace(s.min(), s.max() + 1e-9, 1000)
    n = [np.histogram(s[y == k], edges)[0] for k in (1, 0)]
    m = replace(m, cut=float(edges[quality_classifier.quantile_bin(n[0] + n[1], quality_classifier.best_level(*n))]))
    s = m.scores(x)
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.97 and ((s >= 0.3) == y).mean() > 0.93


def test_weights_minimise_the_pairs_loss():
    """The gradient of the ridged logistic loss over the same pairs, summed plainly, is nothing."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    m = quality_classifier.fit(x, y, n_pairs=700, rounds=60)
    pick = np.random.default_rng(0)
    better, worse = pick.choice(np.flatnonzero(y == 1), 700), pick.choice(np.flatnonzero(y == 0), 700)
    z = ((x - x.mean(axis=0)) / x.std(axis=0)).clip(-6, 6)
    gradient = 1e-3 * m.weights
    for i, j in zip(better, worse):
        d = z[i] - z[j]
        gradient = gradient - d / (1 + math.exp(float(d @ m.weights))) / 700
    assert np.abs(gradient).max() < 1e-5


def test_cut_is_a_quantile_of_strengths():
    """Equal strengths at the cut stay together; in a gap the cut is its middle; nothing labelled is level 0."""
    good, bad = np.array([0, 0, 1, 0, 0, 0, 5, 9]), np.array([7, 0, 3, 0, 0, 0, 0, 0])
    level = quality_classifier.best_level(good, bad)
    assert level == 11 / 25 and quality_classifier.quantile_bin(good + bad, level) == 4
    tied = quality_classifier.best_level(np.array([0, 4, 0]), np.array([0, 3, 0]))
    assert tied in (0.0, 1.0) and quality_classifier.quantile_bin(np.array([0, 7, 0]), tied) in (0, 1, 2, 3)
    for k in range(1, 10):
        n = np.random.default_rng(k).integers(0, 5, 50)
        assert quality_classifier.quantile_bin(n, 0.0) >= 0 and n[: quality_classifier.quantile_bin(n, k / 10)].sum() == pytest.approx(n.sum() * k / 10, abs=4)
    assert quality_classifier.best_level(np.zeros(4, int), np.zeros(4, int)) == 0.0


# ---------------------------------------------------------------- 3


def bench_rows():
    return [(i, "What " + text(25, 500 + i) + "? " + text(6, 700 + i)) for i in range(12)] + [(50, None), (51, ""), (None, text(20, 800))]


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    items = dict(bench_rows())
    rows = odd_rows() + [(100 + i, text(90, i) + " " + items[i] + " " + text(50, i + 1), "en", "a", 1) for i in range(12)]
    rows += [(200, items[3].split("?")[0], "en", "a", 1), (201, " ".join(reversed(items[4].split())), "en", "a", 1), (202, items[5].upper().replace(" ", "  "), "en", "a", 1), (203, items[2] + " " + items[1], "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    want = {(100 + i, i) for i in range(12)} | {(202, 5), (203, 2), (203, 1)}
    assert got == want  # a question without its answer, or the words in another order, are no hit
    kept = decontamination.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def brute_hits(docs, bench, threshold=0.6, question=0.5, answer=0.5):
    """Every window of every text scored against every item, term by term."""
    items = sorted({(i, t) for i, t in bench if t is not None}, key=str)
    bags = [Counter(decontamination.words_of(t)) for _, t in items]
    mean = sum(sum(b.values()) for b in bags) / max(1, len(items))
    df = Counter(w for b in bags for w in b)
    out = []
    for (i, t), bag in zip(items, bags):
        if not bag:
            continue
        n = sum(bag.values())
        weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) for w, tf in bag.items()}
        step = 32
        while step < n:
            step *= 2
        q_words, a_words = decontamination.question_and_answer(t)
        for d, text in docs:
            words_, best = decontamination.words_of(text), None
            for start in range(0, len(words_), step):
                passage = words_[start : start + 2 * step]
                score = sum(weight[w] for w in set(passage) & set(weight)) / sum(weight.values())
                q, a = decontamination.overlap(q_words, passage), decontamination.overlap(a_words, passage)
                if score >= threshold - 1e-9 and (q is None or q >= question) and (a is None or a >= answer) and (best is None or score > best[0] + 1e-12):
                    best = (score, q, a, start, start + len(passage) - 1)
            if best:
                out.append((d, i, round(best[0], 9), *best[1:]))
    return sorted(out, key=str)


def test_decontamination_matches_full_scoring(spark, odd, monkeypatch):
    """The whole query against scoring everything, with long texts cut, items of all lengths, repeated and null ids."""
    monkeypatch.setattr(decontamination, "SLICE", 700)  # of workers that fork here only; the result is the same anyway
    bench = bench_rows() + [(5, "What " + text(25, 505) + "? " + text(6, 705)), (5, text(45, 901) + "? " + text(3, 902)), (60, text(150, 903) + "? " + text(10, 904)), (None, text(20, 800)), (None, text(30, 801)), (61, text(3, 905))]
    items = [t for _, t in bench if t]
    r = random.Random(12)
    rows = [(x[0], x[1]) for x in odd_rows() if len(x[1] or "") < 100_000]
    for n in range(60):
        own = r.choice(items).split()
        own = [w if r.random() > 0.04 * (n % 6) else "zzz" for w in own[: r.choice((len(own), len(own), len(own) - 4))]]
        rows.append((1000 + n, text(r.randint(0, 150), 40 + n) + " " + " ".join(own) + " " + text(r.randint(0, 90), 400 + n) + " " + (r.choice(items) if n % 9 == 0 else "")))
    docs, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = brute_hits(rows, bench)
    assert len({x[0] for x in want}) > 25
    rounded = lambda df: sorted([(x[0], x[1], round(x[2], 9), *x[3:]) for x in df.collect()], key=str)
    assert rounded(decontamination.contaminated(docs, b)) == want
    assert rounded(decontamination.contaminated(docs, b, shard_items=4)) == want
    dirty = {t for _, t in rows} & {t for d, t in rows if d in {x[0] for x in want}}
    assert sorted(map(str, decontamination.decontaminate(docs, b, shard_items=7).collect())) == sorted(f"Row(doc_id={d!r}, text={t!r})" for d, t in rows if t not in dirty)


def test_passages_of_cut_texts(monkeypatch):
    t = "  " + text(400, 3) + " ... " + text(300, 4)
    monkeypatch.setattr(decontamination, "SLICE", 90)
    for start, n in ((0, 64), (64, 64), (33, 7), (650, 64), (699, 64), (800, 64)):
        assert decontamination.passage_of(t, start, n) == decontamination.words_of(t)[start : start + n]


def test_wand_retrieves_all(spark):
    rows = [(i, text(30, i)) for i in range(60)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    shard = next(decontamination.shards(bench, 0.2, 4000))
    x, rng = shard.classes[0], random.Random(1)
    for _ in range(30):
        query = sorted({shard.term[w] for i in rng.sample(range(60), 3) for w in decontamination.words_of(rows[i][1])[: rng.randint(3, 25)]})
        score = defaultdict(float)
        for t in query:
            for i, w in zip(x.postings[t], x.weights[t]):
                score[i] += w
        want = sorted((i, round(s, 9)) for i, s in score.items() if s >= 0.2)
        assert [(i, round(s, 9)) for i, s in decontamination.wand(query, x, list(range(x.n_blocks)))] == want


# ---------------------------------------------------------------- 4


def test_warc_round_trip(spark):
    same, r = "<p>" + text(400, 1) + "</p>", random.Random(2)
    noise = "".join(chr(r.choice((0x1F, 0x8B, 8, 65, 233, 0x4E00))) for _ in range(5000))
    rows = [(1, "http://a/1", same), (2, "http://a/2", same), (9, None, same), (9, None, same), (None, "http://a/n", same), (3, "http://a/3 ü\n", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", noise), (8, "u", "x" * 2_000_000)]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, digest long")
    got = sorted(warc.round_trip(pages, split_bytes=700).collect(), key=str)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        last = max((q for q, _, g in rows if g == h and q is not None), default=None)
        revisit = len(data) >= 1000 and last is not None and p != last
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_warc_payloads_return(spark, tmp_path):
    rows = [(i, f"http://h/{i}", text(i * 3, i)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/w", file_bytes=2000)
    assert manifest.count() > 1
    got = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read(manifest, 512).collect()}
    assert got == {i: (u, h) for i, u, h in rows}


def foreign(kind, block, more=(), length=True):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}-{len(block)}>", "Content-Type: x/y", *more, *([f"Content-Length: {len(block)}"] if length else [])]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_of_other_writers(spark, tmp_path):
    """Archives of two more writers beside ours: other record types, headers that are missing, chunks, hex digests."""
    body = b"<p>\x1f\x8b\x08 body</p>"
    hex_ = hashlib.sha1(body).hexdigest()
    one = [
        foreign("warcinfo", b"software: x\r\n"), foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", ["WARC-Target-URI: http://h/"]), foreign("response", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body, ["WARC-Target-URI: http://h/"]),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}".encode() + b";e=1\r\n" + body[5:] + b"\r\n0\r\n\r\n", [f"WARC-Payload-Digest: sha1:{hex_.upper()}"]),
    ]
    two = [foreign("metadata", b"", length=False), foreign("resource", body, ["WARC-Payload-Digest: md5:abc"]), foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", ["WARC-Refers-To: <urn:uuid:a>"]), foreign("conversion", "é".encode())]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(one))
    (tmp_path / "two.warc.gz").write_bytes(b"junk" + b"".join(two))
    warc.write(spark.createDataFrame([(1, "http://o/", "<b>ours</b>")], "page_id long, url string, html string"), f"file://{tmp_path}/ours").collect()
    for split in (60, 1 << 20):
        got = {(r.record_type, r.record_id.split(":")[1]): r for r in warc.read_folder(spark, f"file://{tmp_path}", split).collect() if r.record_type != "response"}
        assert {k for k, _ in got} == {"warcinfo", "request", "metadata", "resource", "revisit", "conversion"}
        assert bytes(got["resource", "uuid"].payload) == body and got["resource", "uuid"].payload_digest is None and got["revisit", "uuid"].payload_bytes is None and got["metadata", "uuid"].url is None
        responses = [r for r in warc.read_folder(spark, f"file://{tmp_path}", split).collect() if r.record_type == "response"]
        assert sorted((bytes(r.payload), r.payload_digest, r.page_id) for r in responses if r.page_id is None) == [(body, hex_, None)] * 2
        assert [(r.page_id, bytes(r.payload), r.url) for r in responses if r.page_id is not None] == [(1, b"<b>ours</b>", "http://o/")]
    bad = gzip.decompress(foreign("response", b"HTTP/1.1 200 OK\r\n\r\nother", [f"WARC-Payload-Digest: sha1:{hex_}"]))
    with pytest.raises(ValueError, match="not what its headers say"):
        warc.parse(bad)


def plain_reader(data):
    """Types and ids of the records of a whole archive, one after another."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out = []
    while data.strip():
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        out.append((re.search(rb"WARC-Type: (\w+)", head)[1].decode(), re.search(rb"Record-ID: (\S+)", head)[1].decode(), rest[:n]))
        data = rest[n + 4 :]
    return sorted(out)


def test_archives_of_many_records_a_member_and_without_compression(spark, tmp_path):
    """One member with all records, members of two, plain files with what looks like a record inside, at any split."""
    inner = b"WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [b"x" * k + inner * (k % 2) + bytes(range(k % 256)) for k in range(0, 3000, 97)] + [b"", b"y" * 3_000_000]
    records = [gzip.decompress(foreign("resource", b)) for b in bodies]
    files = {"whole.warc.gz": gzip.compress(b"".join(records)), "twos.warc.gz": b"".join(gzip.compress(b"".join(records[i : i + 2])) for i in range(0, len(records), 2)), "plain.warc": b"".join(records), "short.warc": b"".join(records).rstrip(b"\r\n")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = plain_reader(files["whole.warc.gz"])
    for split in (40_000, 8 << 20):
        rows = warc.read_folder(spark, f"file://{tmp_path}", split, damaged="raise").collect()
        for name in files:
            own = [r for r in rows if r.file.endswith(name)]
            assert sorted((r.record_type, r.record_id, bytes(r.payload)) for r in own) == want, (name, split)
            assert len({(r.offset, r.place) for r in own}) == len(want)


def test_damaged_archives_lose_nothing_silently(spark, tmp_path):
    """A wrong check sum, a broken stream, a cut file, a record longer than its member: each is told of, what is whole is
    read, and what begins without a WARC header is no record."""
    three = [foreign("resource", f"{k}".encode() * 900) for k in range(3)]
    wrong = bytearray(three[1])
    wrong[-6] ^= 0xFF
    broken = bytearray(gzip.compress(gzip.decompress(three[1]), 0))
    broken[-40] ^= 0xFF
    long_ = gzip.compress(gzip.decompress(three[1]).replace(b"Content-Length: 900", b"Content-Length: 950"))
    plain = b"".join(map(gzip.decompress, three))
    files = {
        "sum.warc.gz": three[0] + bytes(wrong) + three[2], "stream.warc.gz": three[0] + bytes(broken) + three[2], "long.warc.gz": three[0] + long_ + three[2], "cut.warc.gz": three[0] + three[2] + three[1][:-20],
        "other.warc.gz": three[0] + gzip.compress(b"no record") + three[2], "cut.warc": plain[:-500], "junk.warc": b"junk" + plain,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    for split in (400, 1 << 20):
        rows = warc.read_folder(spark, f"file://{tmp_path}", split).collect()
        got = {name: [r for r in rows if r.file.endswith("/" + name)] for name in files}
        count = {name: (sum(r.error is None for r in x), sum(r.error is not None for r in x)) for name, x in got.items()}
        assert count == {n: (2, 0) if n.startswith("other") else (0, 1) if n.startswith("junk") else (2, 1) for n in files}, count
        assert all(r.record_type is None and r.payload is None for r in rows if r.error)
    for name in files:
        uri = spark.createDataFrame([(f"file://{tmp_path}/{name}", len(files[name]))], "file string, bytes long")
        if name.startswith("other"):
            assert warc.read(uri).count() == 2
        else:
            with pytest.raises(Exception, match="at [0-9]+, record"):
                warc.read(uri).collect()


# ---------------------------------------------------------------- 5


def unpack(rows):
    parts = defaultdict(list)
    for x in rows:
        ids, pos = np.frombuffer(x.input_ids, "<u2"), np.frombuffer(x.position_ids, "<u4")
        assert x.cu_seqlens[0] == 0 and x.cu_seqlens[-1] == x.n_tokens <= len(ids)
        for a, b, d, n, p in zip(x.cu_seqlens, x.cu_seqlens[1:], x.doc_ids, x.doc_rows, x.piece_ids):
            assert (pos[a:b] == np.arange(b - a)).all()
            parts[d, n].append((p, ids[a:b].tolist()))
    return parts


def test_packing_is_lossless(spark, odd, none):
    enc = packing.encoding(packing.tokenizer_folder())
    for rows in (packing.pack(odd, capacity=64, window=50), packing.round_trip(odd, 64)):
        back = []
        for (d, _), pieces in unpack(rows.collect()).items():
            assert [p for p, _ in sorted(pieces)] == list(range(len(pieces)))
            ids = [i for _, x in sorted(pieces) for i in x]
            assert ids[-1] == packing.SEPARATOR
            back.append((d, enc.decode(ids[:-1])))
        assert sorted(back, key=str) == sorted(((r[0], r[1] or "") for r in odd_rows()), key=str)  # repeated ids and rows too
    assert packing.pack(none).count() == 0


def test_rows_are_full(spark):
    """Best fit decreasing leaves little of the rows empty."""
    r = packing.pack(common.table(spark, "/root/testdata/sf0.1", "documents")).selectExpr("sum(n_tokens) / count(*) / 2048 AS fill").first()
    assert r.fill > 0.98


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(20):
        capacity = rng.randint(5, 300)
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(200))
        free = []  # the plain way
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(capacity - n)
        assert sorted(capacity - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_long_text_tokens_are_the_same():
    folder = packing.tokenizer_folder()
    t = text(300_000, 8)
    assert packing.tokenize(t, folder).tolist() == packing.encoding(folder).encode_ordinary(t)


def test_packed_files(spark, tmp_path, sf):
    packed = packing.pack(common.table(spark, sf, "documents"), 128)
    files = packing.write_files(packed, f"file://{tmp_path}/t").collect()
    n = packed.count()
    assert sum(f["rows"] for f in files) == n
    assert sum((tmp_path / "t" / (f["name"].split("/")[-1] + ".ids")).stat().st_size for f in files) == n * 256


def test_packed_files_return(spark, odd, none, sf):
    """What the query returns is read from files in the shared folder, and is all that pack gives."""
    from pathlib import Path

    shared = Path(common.shared_folder(spark).removeprefix("file://"))
    before = set(shared.glob("packed-*/*.ids"))
    docs = common.table(spark, sf, "documents")
    got = sorted(QUERIES["op5_token_packing"](spark, sf).collect())
    assert got == sorted(packing.pack(docs).collect()) and len(got) > 0
    assert sum(f.stat().st_size for f in set(shared.glob("packed-*/*.ids")) - before) == len(got) * 4096
    for capacity in (64, 70_000):
        by_row = lambda df: sorted(df.collect(), key=lambda r: r.row_id)
        assert by_row(packing.round_trip(odd, capacity)) == by_row(packing.pack(odd, capacity))
    assert packing.round_trip(none).count() == 0


# ---------------------------------------------------------------- 6


def test_mixing(spark, odd, none):
    rows = odd_rows() + [(1000 + i, text(10 + i % 70, i), "en", "big" if i % 3 else ["a", "b", "c", None][i % 4], 1) for i in range(900)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", taken long")
    got = mixing.mix_sizes(docs).collect()
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, size(r[1])) for r in rows)
    total, by = Counter(), defaultdict(lambda: [0, 0, 0.0])
    source = {r[0]: r[3] for r in rows}
    for r in rows:
        total[r[3]] += size(r[1])
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, capped, rest = {}, set(), 1.5 * sum(total.values())
    while True:
        open_ = [s for s in order if s not in capped]
        budget = rest - sum(2 * total[s] for s in capped)
        target = {s: 2 * total[s] if s in capped else budget * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    for r in got:
        if r.doc_id is not None:
            assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == total[source[r.doc_id]]
            assert r.taken <= 2 * r.size and (r.size == 0) <= (r.taken == 0)
            by[source[r.doc_id]][0] += r.taken
    assert abs(by["big"][0] - target["big"]) < 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sizes(docs).collect()))
    assert mixing.mix_sizes(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    for r in got:
        if r.doc_id and r.doc_id >= 1000:
            assert times[r.doc_id] * r.size == r.taken
    assert mixing.mix(odd).columns == odd.columns


# ---------------------------------------------------------------- 7


def test_measures():
    t = "a b c\nx y z a b c w\n\n \t\na b c\n#$ x|yé "
    w = t.split()
    spans = set()
    for i in range(len(w) - 2):
        if sum(w[j : j + 3] == w[i : i + 3] for j in range(len(w) - 2)) > 1:
            spans |= {i, i + 1, i + 2}
    assert quality_rules.measure(t) == (len(w), sum(map(len, w)), 3, 1, len(spans))
    assert quality_rules.measure("a a a a") == (4, 4, 0, 0, 4)
    assert quality_rules.measure(None) == quality_rules.measure("") == (0, 0, 0, 0, 0)
    assert quality_rules.measure("no break space")[0] == 1


def test_binomial_bound():
    for n, p, k in ((20, 0.1, 3), (50, 0.02, 0), (7, 0.5, 7)):
        assert quality_rules.at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    rng = random.Random(6)
    for _ in range(400):
        n = rng.choice((1, 2, 30, 400, 3000))
        k, p = rng.randint(0, n), rng.choice((0.0125, 0.3, 0.9, rng.random()))
        terms = [math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)]
        assert quality_rules.at_most(k, n, p) == pytest.approx(math.fsum(terms), abs=1e-9, rel=1e-7), (k, n, p)
    assert 0.0019 < quality_rules.at_most(12_490_000, 1_000_000_000, 0.0125) < 0.0026  # 2.85 deviations below the mean
    assert not quality_rules.certified(0, 50, 0.005, 0.01) and quality_rules.certified(0, 1000, 0.005, 0.01)


def test_rules_keep_clean(spark, odd, none, labels):
    sf = "/root/testdata/sf0.1"
    lab = common.table(spark, sf, "labels")
    r = quality_rules.quality_rules(common.table(spark, sf, "documents"), lab).join(lab, "doc_id").where("NOT base_failed").collect()
    clean, junk = [x for x in r if x.quality == 1], [x for x in r if x.quality == 0]
    assert sum(not x.kept for x in clean) <= 0.02 * len(clean) and sum(not x.kept for x in junk) >= 0.3 * len(junk)
    got = quality_rules.quality_rules(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(x.base_failed for x in got if x.doc_id in (1, 2, 3)) and all(x.kept != x.base_failed for x in got)
    assert quality_rules.quality_rules(none, labels).count() == 0


# ---------------------------------------------------------------- 8


def brute_components(rows):
    sets = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((d, ({tuple(w)} if w else set()) if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [sets[i][0] for i in g if sets[i][0] is not None]
        for i in g:
            out.append((sets[i][0], len(sets[i][1]), min(ids) if ids else None))
    return sorted(out, key=str)


def variants(base, n, edits, seed):
    r = random.Random(seed)
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(1, edits)):
            w[r.randrange(len(w))] = "".join(r.choices("qrstuvwxyz", k=6))
        yield " ".join(w)


def test_near_duplicates_match_brute_force(spark, odd, none):
    base, other = words(150, 41), words(120, 42)
    texts = [*variants(base, 60, 8, 1), *variants(other, 25, 5, 2), " ".join(base).upper(), *(text(40, 100 + i) + " " + " ".join(base[:80]) for i in range(15)), *["one two three four"] * 3, "one two three", *[" ".join(base)] * 4]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(500 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 6} and 7 not in {r.doc_id for r in kept.collect()}
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_first(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    base, other, third = words(150, 51), words(150, 52), words(150, 53)
    hot = [(7, " ".join(base))] * 9 + [(7, t) for t in variants(base, 6, 3, 1)] + [(8, " ".join(base))]  # a row repeated, near copies under its id, a later copy
    nulls = [(None, " ".join(other))] * 5 + [(None, t) for t in variants(other, 4, 3, 2)]  # no id at all
    mixed = [(None, " ".join(third))] * 3 + [(7, t) for t in variants(third, 2, 3, 3)] * 2  # the hot id in another component
    blank = [(2, ""), (2, ""), (None, None), (None, None), (None, " ")]  # linked with nothing
    rows = hot + nulls + mixed + blank + [(6, text(80, 2))] * 2
    got = [(r.doc_id, r.text) for r in near_dedup.keep_first(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, text_hash int")).collect()]
    assert all(r in rows for r in got) and sorted((r for r in got if not (r[1] or "").strip()), key=str) == sorted(blank, key=str)
    stay = [r for r in got if (r[1] or "").strip()]
    assert sorted((d for d, _ in stay), key=str) == [6, 7, 7, None]
    assert {next(i for i, c in enumerate((hot, nulls, mixed, rows[-2:])) if r in c) for r in stay} == {0, 1, 2, 3}


def test_boilerplate_is_no_link_and_is_not_paired(spark):
    """Pages that share most of their text, but too little for a link, among pages that share enough."""
    common = words(164, 61)
    pages = [(i, " ".join(common + words(44, 1000 + i))) for i in range(300)]
    near = [(1000 + i, " ".join(common + words(44, 1007)[: 43 - i])) for i in range(3)]
    docs = spark.createDataFrame(pages + near, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(pages + near)
    ids = spark.createDataFrame([(i, i) for i in range(300)], "id long, root long")
    sets = docs.where("doc_id < 300").select(F.col("doc_id").alias("id"), near_dedup.sets_of("text")["shingles"].alias("shingles"))
    assert near_dedup._across(ids, sets).count() == 0  # not one candidate


def test_across_components_misses_no_pair(spark):
    """Sets that overlap in all degrees: each pair of 0.75 or more is a candidate, whatever its sizes."""
    rng = np.random.default_rng(11)
    pool = np.unique(rng.integers(0, 1 << 63, 300, np.uint64))
    sets = [np.sort(rng.choice(pool[: rng.integers(60, 300)], rng.integers(20, 56), replace=False)) for _ in range(150)]
    sets += [np.sort(np.concatenate([s[: -rng.integers(1, 12)], rng.choice(pool, rng.integers(0, 6), replace=False)])) for s in sets]
    sets = [np.unique(s) for s in sets]
    want = {(j, i) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    ids = spark.createDataFrame([(i, i) for i in range(len(sets))], "id long, root long")
    rows = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, shingles binary")
    got = {(r.a, r.b) for r in near_dedup._across(ids, rows).collect()}
    assert len(want) > 100 and want <= got


def test_sieve_lets_all_keys_through(spark):
    x = spark.range(20_000).withColumn("cell", F.lit(1))
    keys = spark.range(0, 20_000, 7).select(F.xxhash64("id").alias("k"))
    got = common.sieved(x, F.xxhash64("id"), keys, "maybe")
    assert got.columns == ["id", "cell", "maybe"]
    passed = {r.id for r in got.where("maybe").collect()}
    assert passed >= set(range(0, 20_000, 7)) and len(passed) < 3400
    assert common.sieved(x, F.xxhash64("id"), keys.where("false"), "maybe").where("maybe").count() == 0


def test_signatures_estimate():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 3000, np.uint64)
    got = [(near_dedup.signature(np.unique(a[: 1500 + s])) == near_dedup.signature(np.unique(a[500:2000 + s]))).mean() for s in range(0, 500, 50)]
    assert abs(np.mean(got) - np.mean([1000 / 2000 + s / 2000 * 0 for s in range(0, 500, 50)])) < 0.12


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(chain).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


# ---------------------------------------------------------------- 9


def test_licenses(spark, none):
    body = text(30, 3)
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/x.py", body), ("a/b/y.py", body + "\nLicensed under the Apache License, Version 2.0.\n"), ("a/b/c/z.py", body),
        ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.\n" + body), ("q/r.py", body), ("top.py", None), (None, "Licensed under CC BY-NC 4.0."), ("a/b/c/w.py", ""), ("aa/x.py", body),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = {r.path: (r.license, r.inherited_from, r.effective) for r in license_scan.scan_licenses(files).collect()}
    gpl = "GPL-3.0"
    assert got == {
        "a/LICENSE": ("MIT", None, "MIT"), "a/x.py": (None, "a", "MIT"), "a/b/y.py": ("Apache-2.0", None, "Apache-2.0"), "a/b/c/z.py": (None, "a/b", gpl), "a/b/COPYING.txt": (gpl, None, gpl),
        "q/r.py": (None, None, None), "top.py": (None, None, None), None: ("CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), "a/b/c/w.py": (None, "a/b", gpl), "aa/x.py": (None, None, None),
    }
    assert license_scan.scan_licenses(files.where("false")).count() == 0 and license_scan.scan_documents(none).count() == 0


def test_license_lines_of_documents(spark, odd):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        if own := {notices[x.strip()] for x in r.text.split("\n") if x.strip() in notices}:
            want[r.doc_id] = own
    got = {r.doc_id: r.license for r in license_scan.scan_documents(docs).collect() if r.license}
    assert set(got) == set(want) and all(got[d] in want[d] for d in got)
    assert license_scan.scan_documents(odd).count() == odd.count()


def test_long_license_texts(spark):
    """A notice that is wrapped over many lines states the licence of its directory, however many they are."""
    notice = license_scan.TEMPLATES["GPL-3.0"][4].split() * 12
    wrapped = {n: "\n".join(notice[:n]) for n in (400, 401, len(notice))}
    foreign = "\n".join(notice[: len(notice) // 12] + words(420, 8))
    rows = [(f"d{n}/{name}", t) for n, t in wrapped.items() for name, t in (("notes.txt", t), ("sub/x.py", text(30, 3)))] + [("f/notes.txt", foreign), ("f/x.py", text(30, 3)), ("g/LICENSE", wrapped[401]), ("g/x.py", None)]
    # f: a notice wrapped over lines above foreign text is a header, but not the licence of the directory
    got = {r.path: (r.license, r.inherited_from, r.effective) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    gpl = "GPL-3.0"
    want = {f"d{n}/notes.txt": (gpl, None, gpl) for n in wrapped} | {f"d{n}/sub/x.py": (None, f"d{n}", gpl) for n in wrapped}
    assert got == want | {"f/notes.txt": (gpl, None, gpl), "f/x.py": (None, None, None), "g/LICENSE": (gpl, None, gpl), "g/x.py": (None, "g", gpl)}


def plain_scan(t, m):
    """All headers of a text by their definition, each scored in full."""
    lines = [(i, license_scan.words_of(x)) for i, x in enumerate((t or "").split("\n")) if license_scan.words_of(x)]

    def cosine(bag):
        x = {w: n * m.weight(w) for w, n in Counter(bag).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        found = [(sum(x[w] * v[w] for w in x if w in v) / size, name) for name, v in m.templates]
        score = max(s for s, _ in found)
        return next(n for s, n in found if s >= score - 1e-12), score

    best, stated = (None, 0.0, None), set()
    for a in range(len(lines)):
        runs = {a}
        for n in m.lengths:
            total, b = 0, a
            while b < len(lines) and (total := total + len(lines[b][1])) < n:
                b += 1
            if b < len(lines):
                runs.add(b)
        for b in sorted(runs):
            name, score = cosine([w for _, ws in lines[a : b + 1] for w in ws])
            if score >= m.threshold:
                stated |= set(range(a, b + 1))
                if score > best[1] + 1e-12:
                    best = (name, score, lines[a][0])
    only = bool(lines) and len(stated) == len(lines)
    if lines and not only:
        name, score = cosine([w for _, ws in lines for w in ws])
        only = score >= m.threshold
        if only and score > best[1] + 1e-12:
            best = (name, score, lines[0][0])
    return (*best, only)


def test_license_headers_match_full_cosine(spark, sf):
    texts = license_scan.TEMPLATES
    mit, bsd = texts["MIT"][3].split(), texts["BSD-3-Clause"][2].split()
    wrap = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    code = "\n".join(text(6, 700 + i) for i in range(30))
    rows = [
        "Copyright (c) 2020 Somebody\n\n" + wrap(mit, 11), "# " + wrap(mit, 9).replace("\n", "\n# ") + "\n\n" + code, code + "\n" + wrap(bsd, 8) + "\n" + code, wrap(bsd, 12), wrap(mit[:40], 5) + "\n" + code,
        "/* " + wrap(texts["Apache-2.0"][2].split(), 10) + " */\n" + code, wrap(texts["GPL-3.0"][3].split(), 10), "the license of this\nsoftware is\nfree", code, "", None, "SPDX-License-Identifier: Zlib\n" + code, wrap(texts["ISC"][1].split(), 7) + "\n" + code,
    ]
    rows += [r.text for r in common.table(spark, sf, "documents").collect() if len(r.text) < 3000]
    files = spark.createDataFrame([(f"d{i}/x", t) for i, t in enumerate(rows)], "path string, text string")
    m = license_scan.train(files, "text", 0.7)
    found = {r.path: r for r in files.select("path", license_scan.found_column("text", m).alias("f")).select("path", "f.*").collect()}
    want = [plain_scan(t, m) for t in rows]
    for i, (name, score, line, only) in enumerate(want):
        r = found[f"d{i}/x"]
        assert (r.license, r.line, r.only) == (name, line, only) and (name is None or r.score == pytest.approx(score)), i
    assert [w[0] for w in want[:7]] == ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "MIT", "Apache-2.0", "GPL-3.0"]
    bags, n = [Counter(set(license_scan.words_of(t or ""))) for t in rows], len(rows)
    df = sum(bags, Counter())
    for w in ("license", "software", "of"):
        assert m.idf[w] == pytest.approx(math.log((1 + n) / (1 + df[w])) + 1)


def test_license_columns_that_clash(spark):
    files = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.", 1, 2), ("a/x", "", 3, 4)], "path string, text string, score int, line int")
    got = license_scan.scan_licenses(files, keep=("score", "line"))
    assert got.columns == ["path", "score_", "line_", "license", "score", "line", "inherited_from", "effective"]
    assert sorted((r.path, r.score_, r.line_, r.effective) for r in got.collect()) == [("a/LICENSE", 1, 2, "MIT"), ("a/x", 3, 4, "MIT")]


# ---------------------------------------------------------------- 10


def brute_lines(rows, least):
    texts = sorted(((d, t) for d, t in dict.fromkeys(rows)), key=lambda x: (x[0] is not None, x[0] or 0))
    seen, gone = {}, defaultdict(set)
    size = lambda x: len(re.findall(rb"[^\x20\x09-\x0D]+", x.encode()))
    for d, t in texts:
        if t is None:
            continue
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if size(x)]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(x for _, x in lines[a:b])
                if sum(map(size, run)) >= least:
                    if run in seen:
                        gone[(d, t)] |= {i for i, _ in lines[a:b]}
                    seen.setdefault(run, (d, a))
    return {(d, t): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(d, t)]) for d, t in texts}


def test_line_runs_match_brute_force(spark, odd, none):
    r = random.Random(9)
    pool = [text(r.randint(1, 9), 300 + i) for i in range(14)] + ["", " "]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 25)))) for i in range(40)] + [(99, text(70, 5)), (98, text(70, 5)), (3, None), (None, text(70, 5)), (97, text(70, 5) + "\nend")]
    rows.append(rows[0])
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n_lines long")
    for least in (12, 50):
        want = brute_lines(rows, least)
        got = line_dedup.dedup_lines(docs, least).collect()
        assert sorted(map(str, ((x[0], x[1]) for x in got))) == sorted(map(str, ((d, want[(d, t)]) for d, t in rows)))
    assert line_dedup.dedup_lines(docs).columns == ["doc_id", "text", "n_lines", "n_lines_", "n_deleted"]
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_lines(odd).count() == odd.count()


def shuffled(node, by=""):
    """Most rows that an exchange of a finished plan, dealt by a column ``by``, wrote."""
    kind = node.getClass().getSimpleName()
    inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
    below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" and by in node.outputPartitioning().toString() else 0
    return max([own, *(shuffled(x, by) for x in below)])


def test_texts_that_lose_no_line_are_not_shuffled(spark, tmp_path):
    run = "\n".join(text(10, i) for i in range(6))
    rows = [(i, f"{text(30, 1000 + i)}\n{text(30, 3000 + i)}") for i in range(600)] + [(1000 + i, run) for i in range(5)] + [(None, run), (2000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many deleted lines
        got = line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/docs"))
        out = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {d: t if d is None or d < 1000 or t is None else "" for d, t in rows}
    assert {r.doc_id: r.text for r in out} == want and len(out) == len(rows)
    assert {r.n_deleted for r in out if r.doc_id is not None and 1000 <= r.doc_id < 2000} == {6} and sum(r.n_deleted for r in out) == 30
    assert 0 < shuffled(got._jdf.queryExecution().executedPlan()) < 50


def test_runs_of_a_text_in_most_documents_are_not_one_tasks(spark, monkeypatch):
    rows = [(i, i * 7, 0, 0, 0, 5, 1, 1) for i in range(1500)] + [(None, 3, 0, 0, 0, 6, 1, 1), (2001, 4, 0, 0, 0, 6, 1, 1), (2002, 5, 0, 0, 0, 8, 1, 1)]
    level = spark.createDataFrame(rows, "doc long, text_hash long, stretch long, line int, at int, rank long, ahead int, behind int")
    got = line_dedup._later_copies(level, 1)
    assert sorted(tuple(r) for r in got.collect()) == [*((i, i * 7, 0, 0) for i in range(1, 1500)), (2001, 4, 0, 0)]
    assert shuffled(got._jdf.queryExecution().executedPlan(), "r1#") < 100
    r = random.Random(4)
    pool = [text(r.randint(2, 9), 300 + i) for i in range(6)]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(1, 9)))) for i in range(30)]
    monkeypatch.setattr(line_dedup, "_MANY", 2)  # large and small intervals in one table
    want = brute_lines(rows, 12)
    assert sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()) == sorted((d, want[(d, t)]) for d, t in rows)
