"""The training-data operators on small hostile tables, against plain versions."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from sectorlake.llm import decontaminate, language, ngram_lm, packing, quality, spotsigs, substrings, tokens, urls
from sectorlake.llm.jaccard import jaccard_groups
from sectorlake.session import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, anchor string"


def corpus(seed=1, n=60):
    """Near copies of one text, copies, ties, nulls, empty and very long texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i * 3, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "two words"), (1006, " ".join(r.choice(words) for _ in range(30000)))]
    rows += [(2000 + i, " ".join(base[20:90] + [r.choice(words) for _ in range(40)])) for i in range(6)]
    rows += [(3000, "again " * 300), (3001, "again " * 200)]
    return rows


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, "en" if i % 2 else "fr", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


def components(rows, k, t):
    sets = {}
    for i, x in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= t and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard(spark, k, t):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(frame(spark, rows), k, t).collect()}
    assert got == components(rows, k, t)


def test_jaccard_far_from_the_centre(spark):
    """Copies that differ from each other by about the threshold, and texts that only share a passage."""
    r = random.Random(7)
    words = [f"v{i}" for i in range(3000)]
    base, passage = [r.choice(words) for _ in range(140)], [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in r.sample(range(0, 140, 4), r.randrange(0, 9)):
            w[at] = r.choice(words[:5])
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([r.choice(words) for _ in range(100)] + passage)) for i in range(40)]
    rows += [(200 + i, " ".join(words[a : a + 60])) for i, a in enumerate(range(0, 90, 3))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_groups(frame(spark, rows), 5, Fraction(4, 5)).collect()}
    assert got == components(rows, 5, Fraction(4, 5))
    assert len({c for _, c in got.values()}) > 41


def test_null_and_repeated_ids(spark, tmp_path):
    """A null doc_id counts as 0, and rows that repeat a doc_id keep their own sets."""
    import corpus_pipeline

    r = random.Random(9)
    some = lambda n: [f"t{r.randrange(10**6)}" for _ in range(n)]
    alter = lambda w, at: " ".join([*w[:at], "other", *w[at + 1 :]])
    table = lambda rows: ship(spark).createDataFrame([(i, t, "en", "s", len(t), "x", "y") for i, t in rows], SCHEMA)
    one, two, three = some(150), some(150), some(150)
    rows = [(None, " ".join(one)), (0, " ".join(some(80))), (4, alter(one, 30)), (5, alter(one, 90)), (7, " ".join(two)), (7, " ".join(three)), (8, alter(two, 50)), (9, alter(three, 50)), (11, " ".join(some(90)))]
    docs = table(rows)
    got = [(x.doc_id, x.component_id) for x in jaccard_groups(docs, 5, Fraction(4, 5)).collect()]
    assert sorted(got) == [(0, 0), (0, 0), (4, 0), (5, 0), (7, 7), (7, 7), (8, 7), (9, 7), (11, 11)]
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((x.doc_id, x.text) for x in left) == sorted((i or 0, t) for i, t in rows if i not in (4, 5, 8, 9))

    gone = {x.doc_id: x.n_removed for x in substrings.dedup_substrings(table([(-1, " ".join(one[:80])), (None, " ".join(one)), (3, " ".join(one[20:]))])).collect()}
    assert gone == {-1: 0, 0: 80, 3: 130}

    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, table(rows[:2]), str(tmp_path)).collect()
    assert [(x.doc_id, x.text) for x in left] == rows[1:2]


def test_substrings(spark):
    rows = corpus(2)
    first, want = {}, {}
    texts = {i: WORD.findall(x or "") for i, x in rows}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][a : a + 50]), i)
    for i, w in texts.items():
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] < i:
                gone[a : a + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == want


def removed_by_hand(rows):
    """Words removed from each document (ids are distinct), window by window."""
    texts = {i: WORD.findall(x or "") for i, x in rows}
    first, gone = {}, {}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][a : a + 50]), i)
    for i, w in texts.items():
        gone[i] = len({j for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for j in range(a, a + 50)})
    return gone


@pytest.mark.parametrize("size", [50, 60, 80, 120, 300])
def test_substrings_twice_in_a_document(spark, size):
    """A document holds a boilerplate twice, and a smaller doc_id only part of it."""
    r = random.Random(size)
    some = lambda n: [f"u{r.randrange(10**6)}" for _ in range(n)]
    part = some(size)
    boiler = some(60) + part + some(60)
    rows = [(1, " ".join(some(40) + part + some(40))), (2, " ".join(some(70) + boiler + some(70) + boiler + some(30))), (3, " ".join(some(20) + boiler + some(20) + boiler))]
    got = {x.doc_id: x.n_removed for x in substrings.dedup_substrings(frame(spark, rows)).collect()}
    assert got == removed_by_hand(rows) and got[2] == 2 * size


def test_tokens_and_packing(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(3, 5), (9000, "a <|endoftext|> b"), (9001, "Don't, x1y2. Ünï"), (9002, "é ÉTÉ, end.")]
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    at, want = 0, {}
    for i in sorted(ids):
        x = [*ids[i], 2]
        want[i] = (at, len(x), tokens.crc32(np.array(x)))
        at += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.token_files(frame(spark, rows)).collect()} == want
    packed, rooms = packing.pack(frame(spark, rows)).collect(), {}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packed} == {(i, p // 4096): tokens.crc32(np.array([*x, 1][p : p + 4096])) for i, x in ids.items() for p in range(0, len(x) + 1, 4096)}
    for r in packed:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in rooms.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and sum(s[-1]) <= 4096


def test_urls(spark):
    pages = [(1, None), (2, "nohost"), (3, "HTTP://A.Net/x"), (4, "http://example.net/en/a?b"), (5, "http://net?x"), (6, "http://bnet/x"), (7, "https://x.org/fr/#t"), (8, "://example.com/de/")]
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(ship(spark).createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/x", "net/", "block"), 4: ("example.net", "/en/a", "example.net/en/", "allow"),
        5: ("net", "", None, "allow"), 6: ("bnet", "/x", None, "allow"), 7: ("x.org", "/fr/", "org/fr/", "allow"), 8: ("example.com", "/de/", "example.com/de/", "block"),
    }


def test_language(spark):
    r = random.Random(4)
    alphabets = {"aa": "aeiou klm", "bb": "xyz qrst", "cc": "bdfgh vw"}
    rows = [(i, "".join(r.choice(alphabets[lang]) for _ in range(200)), lang) for i in range(300) for lang in [list(alphabets)[i % 3]]] + [(900, None, "aa"), (901, "123 !", "bb"), (902, "qrst xyz", None)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language.identify(docs, language.train(docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:300]) and got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "bb"
    assert {x.lang_pred for x in language.identify(docs, language.train(docs.where("false"))).collect()} == {"und"}
    assert language.codewords(12).shape[0] == 12


def test_quality(spark):
    rows = [(i, ("bad! " * 50 if i % 4 == 0 else " ".join(f"word{j * i % 97}" for j in range(60)))) for i in range(1, 400)] + [(1000, None), (1001, "")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows[:399]] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.predicted == int(r.doc_id % 4 != 0) for r in got if r.doc_id < 1000) and all(0 <= r.score <= 1 for r in got)


def test_decontamination(spark):
    item = "What colour has the sky over the old town in summer evenings? The answer is deep violet with gold."
    docs = [(1, "x " * 200 + item.upper() + " y" * 300), (2, "the sky over the town " * 40), (3, None), (4, ""), (5, item)]
    items = ship(spark).createDataFrame([(7, item), (8, None), (9, ""), (10, "quite another question entirely, asked of nobody")], "item_id long, text string")
    got = decontaminate.contaminated(frame(spark, docs), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (5, 7)} and all(r.answer_overlap == 1 and r.leak == "both" for r in got)


def test_language_model(spark):
    import collections
    import math
    import zlib

    rows = corpus(5, 30)
    toks = {i: [*WORD.findall((t or "").lower()), None] for i, t in rows}
    learn = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for i in learn for w in toks[i])
    n, v = sum(c.values()), len(c)
    b = collections.Counter(p for i in learn for p in zip([None, *toks[i][:-1]], toks[i], strict=True))
    p = lambda w: (c[w] + 1) / (n + v + 1)
    for r in ngram_lm.score(frame(spark, rows)).collect():
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(p(w)) for w in t))
        assert r.score == pytest.approx(sum(math.log10((b[x] + ngram_lm.MASS * p(x[1])) / (c[x[0]] + ngram_lm.MASS)) for x in zip([None, *t[:-1]], t, strict=True)), rel=1e-3)


def test_elias_fano():
    x = np.sort(np.random.default_rng(0).integers(0, 10**7, 5000))
    ef = ngram_lm.EliasFano(x)
    assert (ef.access(np.arange(5000)) == x).all()
    q = np.random.default_rng(1).integers(0, 10**7 + 10, 3000)
    assert (ef.successor(q) == np.searchsorted(x, q)).all()


def test_fingerprints(spark):
    rows = [*corpus(6, 5), (5000, "the cat sat on the mat and it was a good day for all of them to be in the house")]
    got = {r.doc_id: r for r in spotsigs.fingerprints(frame(spark, rows)).collect()}
    texts = sorted((i, t or "") for i, t in rows)
    for k, (i, t) in enumerate(texts):
        nxt = texts[(k + 1) % len(texts)][1]
        h = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert got[1000].fingerprint == got[1001].fingerprint


def test_spots_across_many_anchors(spark):
    """The next two words that are not anchors, however many anchors stand between."""
    r = random.Random(8)
    plain = ["cat", "house", "runs", "blue"]
    texts = {1: "the cat of the and in house", 2: "of the and in the cat to be", 3: "the cat", 4: "and the of in is it a cat it is a on house was blue", 5: "cat " + "the " * 40 + "house blue"}
    texts |= {10 + i: " ".join(r.choice(spotsigs.ANCHORS if r.random() < 0.85 else plain) for _ in range(60)) for i in range(30)}
    want = {}
    for i, t in texts.items():
        w = t.split()
        chains = {(a, *[x for x in w[k + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]) for k, a in enumerate(w) if a in spotsigs.ANCHORS}
        want[i] = {" ".join(c) for c in chains if len(c) == 1 + spotsigs.CHAIN} or {f" {t} "}
    flat = spark.createDataFrame([(i, s) for i, x in want.items() for s in x], "doc_id long, s string").selectExpr("doc_id", "lower(lpad(hex(xxhash64(s)), 16, '0')) AS h", "xxhash64(s) AS x")
    hashes = {}
    for x in flat.orderBy("doc_id", "x").collect():
        hashes.setdefault(x.doc_id, []).append(x.h)
    got = {x.doc_id: x.fingerprint.split() for x in spotsigs.fingerprints(frame(spark, list(texts.items()))).collect()}
    assert got == hashes


def test_empty_tables(spark):
    none = frame(spark, [])
    assert jaccard_groups(none).count() == substrings.dedup_substrings(none).count() == packing.pack(none).count() == 0
    assert ngram_lm.score(none).count() == spotsigs.fingerprints(none).count() == 0
