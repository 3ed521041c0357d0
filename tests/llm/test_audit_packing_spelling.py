"""Filter audit, hierarchical packing and spelling variants, held against plain versions on odd rows too."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, DOCS, LABELS, odd_rows, text

from tintlake.llm import filter_audit, hierarchical_packing, spelling
from tintlake.llm.common import table
from tintlake.llm.queries import QUERIES


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 0.5, "h", "s", "g", "n", "o", 3) for r in odd_rows()], DOCS + CLASH)


# ---------------------------------------------------------------- 11


def plain_audit(rows, labels):
    """Every order run over the documents one by one."""
    quality, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in rows if j is not None and (u or "") == t]
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j < i for j in same) else set()
        docs.append((lang or "", fails, i in quality and i is not None, i in toxic and i is not None))
    out, share = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                stay = [d for d in left if f not in d[1]]
                already = sum(f in d[1] for d in own) - len(gone)
                out[part, order, step] = [len(stay), len(gone), already, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                share[part, f] += len(gone)
                left = stay
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_matches_running_every_order(spark, odd, monkeypatch):
    r = random.Random(3)
    base = [" ".join(r.choices(["one", "Two", "three", "FOUR", "$5", "six", "x#y", "eins", "zwei"], k=n)) for n in (0, 1, 30, 250)] + [text(n, n) for n in (20, 199, 200, 201, 400)]
    rows = [(r.choice([None, *range(12)]), r.choice(base), r.choice(["en", "de", "", None])) for _ in range(60)]
    rows += [(99, text(300, 7) + " " + text(3, 8), "en"), (99, text(300, 7), "en"), (99, text(300, 7), "en"), (3, None, "en"), (2, None, "en"), (7, "A" * 7 + "b" * 226, "de"), (8, "A" * 8 + "b" * 225, "de")]
    labels = [(i, i % 3, i % 2) for i in range(12)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)
    want = plain_audit(rows, labels)
    assert audited(docs.repartition(5), marks) == want
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 500)
    assert audited(docs.repartition(3), marks) == want
    whole = [(d, t, lang) for d, t, lang, *_ in odd_rows()]
    assert audited(odd, marks) == plain_audit(whole, labels)
    assert filter_audit.audit(odd.where("false"), marks).isEmpty()
    assert audited(docs, marks.where("false")) == plain_audit(rows, [])


def test_term_matrix_is_the_counts_of_each_document(spark):
    import numpy as np

    rows = [(i, text(50 + i, i % 7), "en") for i in range(40)] + [(40, None, None), (41, "a a  a\tb\n", "en")]
    dictionary, matrix = filter_audit.term_matrix(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    words = {r.id: r.word for r in dictionary.collect()}
    assert len(set(words.values())) == len(words) == dictionary.count()
    shards = matrix.collect()
    assert len(shards) == 4 and len({s.shard for s in shards}) == len(shards)
    got = {}
    for s in shards:
        offsets, columns, counts = np.frombuffer(s.offsets, "<i4"), np.frombuffer(s.columns, "<i8"), np.frombuffer(s.counts, "<i4")
        for d, a, b in zip(s.documents, offsets, offsets[1:]):
            got[d.doc_id] = {words[c]: int(n) for c, n in zip(columns[a:b], counts[a:b])}
    assert got == {i: dict(Counter((t or "").split())) for i, t, _ in rows}
    sums = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.row_sums(matrix).collect()}
    assert sums[41] == (4, 2) and sums[40] == (0, 0)


# ---------------------------------------------------------------- 12


def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def check_packing(rows, found, capacity=4096):
    """All of the contract: pieces, ids and gapless sequences; the number of sequences and of ids."""
    want = Counter()
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len({(r.doc_row, r.piece) for r in found}) == len(found)
    return len(by), sum(r.length for r in found)


def test_sequences_hold_all_pieces_and_few_are_needed(spark, odd, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n, ids = check_packing(rows, QUERIES["op12_best_fit_packing"](spark, sf).collect())
    least = -(-ids // 4096)
    assert n <= 1.02 * least + 1
    spread = hierarchical_packing.pieces(hierarchical_packing.pack_sequences(docs.repartition(40), fan_in=3)).collect()
    assert check_packing(rows, spread)[0] <= 1.2 * least  # five documents a leaf
    monkeypatch.setattr(hierarchical_packing, "WINDOW", 20_000)
    small = hierarchical_packing.pieces(hierarchical_packing.pack_sequences(docs.repartition(2), capacity=512)).collect()
    assert check_packing(rows, small, 512)[0] <= 1.05 * -(-ids // 512)
    whole = [(d, t) for d, t, *_ in odd_rows()]
    check_packing(whole, hierarchical_packing.pieces(hierarchical_packing.pack_sequences(odd)).collect())
    assert hierarchical_packing.pack_sequences(odd.where("false")).isEmpty()


def test_ids_are_those_of_the_whole_text():
    import pyarrow as pa

    texts = ["a <|endoftext|> b<|startoftext|>", "é Å ́x ΑΣ ΣΑΣ.", "  a　b\x85c", " don't\tWE'LL\r\n12 3日本語\x0b𝒳 ", "", "\n", "x" * 5000, "ﬁ ǅ İstanbul"] * 2
    r = random.Random(2)
    signs = [*"abcXYZ019'’.,-!<|>§×÷ßéÉñŸµªº½ÞþÄ", "'s", "'LL", "don't", "<|endoftext|>", "<|", "日", "é", "\x1c", "\u00a0", " ", " ", "\n"]
    texts += ["".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(400)]
    encode = hierarchical_packing.Encoder(hierarchical_packing.vocabulary())
    for _ in range(2):
        assert [[*x.tolist(), 1] for x in encode(pa.array(texts))] == plain_ids(texts)


def test_tree_merges_what_fits_and_passes_few(spark):
    """No two open bins of a node fit together, and bins that can't be merged aren't carried to the root."""
    r = random.Random(5)
    left = [(node, node * 100 + k, r.choice([2049, 2500, 3000, 3900]) if k else r.randint(1, 2048)) for node in range(50) for k in range(20)]
    places = hierarchical_packing.merge_tree(spark.createDataFrame(left, "node long, bin long, length int"), fan_in=4).collect()
    size = {b: n for _, b, n in left}
    assert sorted(p.bin for p in places) == sorted(size)
    by = defaultdict(list)
    for p in places:
        by[p.sequence_id].append((p.at, size[p.bin]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    small = [sum(n for _, n in parts) for parts in by.values()]
    assert sum(2 * n <= 4096 for n in small) <= 1 and len(by) <= 20 * 50 - 45


# ---------------------------------------------------------------- 13


def one_error(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    out, form = {}, {}
    for w in n:
        near = sorted((v for v in n if one_error(v, w)), key=lambda v: (-n[v], v))
        form[w] = near[0] if near and n[near[0]] >= 2 * n[w] else None
        out[w] = len(near)
    found = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] else None)
    return found


def grouped(docs, **kw):
    rows = spelling.variants(docs, **kw).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_match_all_pairs(spark, odd):
    r = random.Random(9)
    base = ["".join(r.choices("abé", k=r.randint(5, 7))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "straße", "STRASSE", "Élan", "élans", "über×÷", "q" * 3000]
    rows = []
    for i in range(150):
        words = [w if r.random() < 0.7 else w[:k] + r.choice(["", "a", "b", "éa"]) + w[k + 1 :] for w in r.choices(base, [1 + k % 9 for k in range(len(base))], k=40) for k in [r.randint(0, len(w))]]
        rows.append((r.choice([None, i, i % 5]), r.choice([" ", "-", "1", "\n"]).join(words)))
    docs = spark.createDataFrame([*rows, (1, None), (2, ""), (3, "12 #")], "doc_id long, text string")
    want = plain_variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and len({v[1] for v in want.values()}) > 5
    assert grouped(docs.repartition(4)) == want
    assert grouped(docs, size=7) == want
    assert grouped(odd) == plain_variants([(d, t) for d, t, *_ in odd_rows()])
    assert spelling.variants(odd.where("false")).isEmpty()


def test_index_finds_each_pair_once():
    r = random.Random(4)
    for letters, most in (("ab", 9), ("az", 6), ("aàÿ", 7)):
        words = sorted({"".join(r.choices(letters, k=r.randint(2, most))) for _ in range(300)})
        index = spelling.Index(words[::2])
        found = [(words[i], index.words[j]) for right in (True, False) for i, j in zip(*index.near(words, right))]
        assert Counter(found) == Counter((a, b) for a in words for b in words[::2] if one_error(a, b))


def test_links_are_the_same_in_any_shards(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choices("abc", k=r.randint(5, 8))) for _ in range(400)} | {"a" * 40, "a" * 41, "a" * 39 + "b"})
    table_ = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if one_error(a, b))
    for size in (10, 60, 1000):
        assert sorted((x.word, x.near) for x in spelling.near_words(table_, size).collect()) == want


def test_roots_of_a_long_way(spark):
    ways = [(f"w{i}", f"w{i + 1}") for i in range(62)] + [("x", "w30"), ("y", "z")]
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame(ways, "word string, form string")).collect()}
    assert found == {**{f"w{i}": "w62" for i in range(62)}, "x": "w62", "y": "z"}
