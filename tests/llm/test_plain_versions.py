"""Operators against plain versions of what they compute, and on hostile tables."""

import collections
import hashlib
import math
import random
import re
import string
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, components, removed_by_hand

import corpus_pipeline
from sectorlake.llm import decontaminate, language, ngram_lm, packing, quality, spotsigs, substrings, tokens, urls
from sectorlake.llm.common import crc_mod
from sectorlake.llm.jaccard import jaccard_groups
from sectorlake.session import ship

FULL = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, slice long, bucket long, row string, n long"


def table(spark, rows):
    """(doc_id, text[, lang]) rows with columns whose names operators use inside."""
    ship(spark)
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", "k", 7, 7, "r", 7) for r in rows], FULL)


def some_words(r, n, kinds=5000):
    return [f"w{r.randrange(kinds)}" for _ in range(n)]


# ---- decontamination ---------------------------------------------------------

def plain_words(text):
    return [w for w in re.split(f"[{re.escape(string.punctuation)}\\s]+", text.lower()) if w]


def plain_sections(text):
    words = plain_words(text)
    ends = [m.end() for m in re.finditer(r"[.!?:]\s+(?=\S)", text)]
    cut = len(plain_words(text[: ends[-1]])) if ends else 0
    if not 0 < cut < len(words):
        cut = max(1, math.ceil(len(words) * 0.75)) if words else 0
    whole = [(0, len(words))] if min(cut, len(words) - cut) < decontaminate.LEAST_PART else [(0, cut), (cut, len(words))]
    return words, cut, [words[s : min(hi, s + decontaminate.SECTION)] for lo, hi in whole for s in range(lo, hi, decontaminate.SECTION)]


def plain_contaminated(docs, items):
    """BM25 of every window of two cells against every section, then overlaps."""
    parsed = {i: plain_sections(t) for i, t in items if t}
    every = [(i, s) for i, (_, _, ss) in parsed.items() for s in ss]
    n, mean = len(every), sum(len(s) for _, s in every) / max(1, len(every))
    df = collections.Counter(w for _, s in every for w in set(s))
    k1, b = decontaminate.K1, decontaminate.B

    def impacts(s):
        tf = collections.Counter(s)
        raw = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(s) / mean)) for w, f in tf.items()}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    weighted = [(i, impacts(s)) for i, s in every]
    runs = lambda w, size: {tuple(w[a : a + size]) for a in range(len(w) - size + 1)}
    out = {}
    for d, text in docs:
        words = plain_words(text or "")
        windows = [set(words[a : a + 2 * decontaminate.SECTION]) for a in range(0, len(words), decontaminate.SECTION)]
        best = collections.defaultdict(float)
        for win in windows:
            for i, imp in weighted:
                best[i] = max(best[i], sum(x for w, x in imp.items() if w in win))
        for i, score in best.items():
            if score < decontaminate.THRESHOLD:
                continue
            item, cut, _ = parsed[i]
            shares, sizes = [], []
            for part in (item[:cut], item[cut:]):
                size = min(decontaminate.RUN, len(part))
                mine = runs(part, size) if size else set()
                shares.append(len(mine & runs(words, size)) / len(mine) if mine else 0.0)
                sizes.append(len(mine))
            whole = (shares[0] * sizes[0] + shares[1] * sizes[1]) / max(1, sum(sizes))
            leak = "both" if min(shares) >= 0.5 else "question" if shares[0] >= 0.8 and cut >= decontaminate.LEAST_PART else "part" if whole >= 0.5 else None
            if leak:
                out[(d, i)] = (round(score, 6), round(shares[0], 6), round(shares[1], 6), leak)
    return out


def leaks(seed=3):
    r = random.Random(seed)
    items = [(i, " ".join(some_words(r, r.randrange(9, 40), 300)) + ". " + " ".join(some_words(r, r.randrange(1, 30), 300))) for i in range(40)]
    items += [(100, " ".join(some_words(r, 300, 300))), (101, None), (102, ""), (103, "Of. It"), (104, "one")]
    docs = []
    for k, (_, text) in enumerate(items[:41]):
        w = text.split()
        part = {0: w, 1: w[: len(w) * 3 // 4], 2: w[len(w) // 2 :], 3: w[: len(w) // 3], 4: [x.upper() + "," for x in w]}[k % 5]
        docs.append((k, " ".join(some_words(r, r.randrange(0, 200), 300) + part + some_words(r, r.randrange(0, 150), 300))))
    docs += [(1000 + i, " ".join(some_words(r, 150, 300))) for i in range(10)] + [(2000, None), (2001, ""), (2002, "one of it")]
    return docs, items


@pytest.mark.parametrize("slice_chars", [1 << 20, 3000, 150])
def test_leaks(spark, slice_chars):
    """The same rows and scores for any number of slices."""
    docs, items = leaks()
    frame = ship(spark).createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, key long, slice long")
    got = {(r.doc_id, r.item_id): (round(r.score, 6), round(r.question_overlap, 6), round(r.answer_overlap, 6), r.leak) for r in decontaminate.contaminated(table(spark, docs), frame, slice_chars=slice_chars).collect()}
    want = plain_contaminated(docs, items)
    assert {k: v[1:] for k, v in got.items()} == {k: v[1:] for k, v in want.items()} and {v[3] for v in want.values()} == {"both", "question", "part"}
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-5) for k in want)


def test_repeated_items_and_documents(spark):
    text = "What has the long road to the sea behind the hills got in spring? Many small white flowers by the wall."
    items = ship(spark).createDataFrame([(1, text), (2, text), (None, text)], "item_id long, text string")
    got = decontaminate.contaminated(table(spark, [(7, text), (7, text), (None, text)]), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted((d, i) for d in (7, 7, 0) for i in (0, 1, 2))
    assert decontaminate.contaminated(table(spark, [(7, text)]), items.where("false")).count() == decontaminate.contaminated(table(spark, []), items).count() == 0


# ---- quality -------------------------------------------------------------------

def plain_statistics(text):
    body = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", body)
    size, count, n, m = len(body), len(words), max(1, len(body)), max(1, len(words))
    share = lambda chars: sum(c in chars for c in body)
    return [
        math.log1p(size), math.log1p(count), sum(map(len, words)) / m, share(bytes(range(65, 91))) / n, share(b"0123456789") / n, share(b"#$%&*^~") / n, share(b"!?") / n, share(b"|") / n,
        size / (share(b"\n") + 1), sum(c > 127 for c in body) / n, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        sum(len(w) > 1 and 65 <= w[1] < 91 for w in words) / m, sum(w[-1:] in (b".", b",", b";", b":") for w in words) / m,
    ]


def test_statistics():
    texts = ["", "Plain words, here. HERE here here!", "#1 | a|b\n\nÜber Straße 42 x x", " \t\n", "ABC def\tGHI; " * 50, None]
    got = quality.statistics(pa.array(texts))
    assert np.allclose(got, [plain_statistics(t or "") for t in texts])


def test_rules(spark):
    """The compiled expression gives what the rules give, and no weight could be better: the conditions of the lasso's minimum hold."""
    r = np.random.default_rng(2)
    x = r.random((600, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6) | (r.random(600) < 0.05)).astype(float)
    model = quality.fit(x, y, trees=6)
    assert 0 < len(model.rules) and all(1 <= len(k.terms) <= 3 for k in model.rules)
    total = model.bias + sum(w * k.holds(x) for k, w in zip(model.rules, model.weights, strict=True))
    rows = spark.createDataFrame(x.tolist(), [f"{s}" for s in quality.STATISTICS]).withColumn("got", model.score())
    assert np.allclose([q.got for q in rows.collect()], 1 / (1 + np.exp(-total)))
    on = np.column_stack([k.holds(x) for k in model.rules]).astype(float)
    bias, weight = quality._lasso(on, y, 3e-3, steps=6000)
    slope = on.T @ (1 / (1 + np.exp(-(on @ weight + bias))) - y) / len(y)
    assert np.all(np.abs(slope) <= 3e-3 + 1e-4) and np.allclose(slope[weight != 0], -3e-3 * np.sign(weight[weight != 0]), atol=1e-4)


def test_quality_rows(spark):
    rows = [(i % 90, "bad! " * 30 if i % 3 else " ".join(f"word{j * i % 91}" for j in range(50))) for i in range(200)] + [(None, None), (None, "x"), (5, "")]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(90)] * 2 + [(None, 1, "y"), (7, None, "z")], "doc_id long, quality int, text string")
    got = quality.classify(table(spark, rows), labels, fit_rows=40).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id)
    assert {r.score for r in quality.classify(table(spark, rows), labels.where("false")).collect()} == {0.5}
    assert quality.classify(table(spark, []), labels).count() == 0


# ---- language --------------------------------------------------------------------

def test_held_out_languages(spark):
    """Four invented languages, learned from three folds and told in the fourth."""
    r = random.Random(5)
    parts = {"aa": "ka lo mi tu", "bb": "sch ung ver lich", "cc": "tion ment eau oux", "dd": "ing the ed wh"}
    text = lambda lang: " ".join("".join(r.choice(parts[lang].split()) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40)))
    rows = [(i, text(lang), lang) for i in range(1200) for lang in [r.choice(list(parts))]]
    docs = table(spark, rows)
    got = language.identify(docs, language.train(docs)).collect()
    lang = {i: x for i, _, x in rows}
    out = [g.lang_pred == lang[g.doc_id] for g in got if g.held_out]
    assert len(out) > 200 and sum(out) / len(out) > 0.98
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)


def test_decoding():
    """Loss-weighted decoding against the sum written out; codewords are far apart."""
    r = np.random.default_rng(1)
    code = language.codewords(5)
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) == 2 ** 3
    model = language.Model([f"l{i}" for i in range(5)], code, r.normal(size=(6, code.shape[1])), r.normal(size=code.shape[1]), r.random(code.shape[1]))
    x = r.normal(size=(20, 6))
    best, share, other = model.decode(x)
    for k in range(20):
        margin = x[k] @ model.weights + model.bias
        loss = [sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(margin, word, model.trust, strict=True)) for word in code]
        p = sorted(math.exp(-v) for v in loss)
        assert best[k] == int(np.argmin(loss)) and share[k] == pytest.approx(p[-1] / sum(p)) and other[k] == pytest.approx(p[-2] / sum(p))


def test_language_rows(spark):
    rows = [(None, "kalomi tu ka", "aa"), (None, "ungver sch", "bb"), (3, None, "aa"), (3, "", "bb"), (4, "42 !", None), (5, "kalo mitu " * 8000, None), (6, "Ä", "cc")] + [(10 + i, "kalo mitu", "aa") if i % 2 else (10 + i, "verung schlich", "bb") for i in range(40)]
    got = language.identify(table(spark, rows), language.train(table(spark, rows))).collect()
    assert len(got) == len(rows) and sum(g.doc_id == 0 for g in got) == 2 and {g.lang_pred for g in got if g.doc_id in (3, 4)} == {"und"}
    assert next(g for g in got if g.doc_id == 5).lang_pred == "aa"
    assert language.identify(table(spark, []), None).count() == 0 and language.train(table(spark, [])) is None


# ---- URL filters -------------------------------------------------------------------

def test_many_rules(spark, monkeypatch):
    """Nested rules, in one sweep and in slices, against every rule in turn."""
    r = random.Random(9)
    label = lambda: r.choice("abcd")
    hosts = [".".join(label() for _ in range(r.randrange(1, 5))) for _ in range(400)]
    rules = {(r.choice(hosts), r.choice(["/", "/a", "/a/b", "", "/b/"]), r.choice(["allow", "block"])) for _ in range(150)}
    pages = [(i, f"http://{r.choice(hosts).upper() if i % 3 else r.choice(hosts)}{r.choice(['', '/', '/a', '/a/b/c', '/b/?q', '#x'])}") for i in range(600)] + [(1000, None), (1000, ""), (None, "http://a/"), (1001, "x://" + "a" * 5000 + "/a")]
    frame = ship(spark).createDataFrame([(h, p, v, 1) for h, p, v in rules] + [("a", "/", None, 1), (None, "/", "block", 1), ("A", None, "block", 1)], "host string, path string, verdict string, page_id int")
    want = []
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        ties = {f[2] for f in fits if best and f[:2] == best[:2]}
        want.append((i, host, path, ties or {None}, best[3] if best else "allow"))
    for most in (50_000, 20):
        monkeypatch.setattr(urls, "RULES_A_SWEEP", most)
        got = urls.judge(ship(spark).createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id long, url string, host string, rule string"), frame).collect()
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
            assert g[:3] == w[:3] and g[3] in w[3] and g[4] == w[4]
    assert urls.judge(ship(spark).createDataFrame([], "page_id long, url string"), frame).count() == 0
    assert {g.verdict for g in urls.judge(ship(spark).createDataFrame([(1, "http://a/")], "page_id long, url string"), frame.where("false")).collect()} == {"allow"}


# ---- packing, tokens -----------------------------------------------------------------

def best_fit(lengths, capacity):
    """Best fit, longest first, document by document: the number of sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in rooms if x >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    """As few sequences as best fit over single documents, within one in a hundred, and never below the sum's bound."""
    r = random.Random(seed)
    lengths = [min(100, max(1, int(r.expovariate(1 / r.choice([5, 20, 60]))))) for _ in range(1500)]
    counts = collections.Counter(lengths)
    rooms, used = collections.defaultdict(list), collections.Counter()
    for length, first, last, sequence, each, offset in packing.plan(dict(counts), 100):
        for k in range(last - first):
            rooms[sequence + k // each].append((offset + k % each * length, length))
            used[length] += 1
    assert used == counts
    for s in rooms.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(s[-1]) <= 100
    assert -(-sum(lengths) // 100) <= len(rooms) <= best_fit(lengths, 100) * 1.01


def test_hostile_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(None, "null id"), (0, "zero id"), (3, "a b"), (3, "a b"), (3, "c"), (4, None), (5, ""), (6, "w " * 30000)]
    tok = Tokenizer.from_file(tokens.vocabulary_path())
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    got = sorted(map(tuple, tokens.token_files(table(spark, rows)).collect()))
    assert sorted((d, n) for d, _, n, _ in got) == sorted((i or 0, size(t)) for i, t in rows)
    by_start = sorted((start, d, n) for d, start, n, _ in got)
    assert [s for s, _, _ in by_start] == list(np.cumsum([0] + [n for _, _, n in by_start[:-1]])) and [d for _, d, _ in by_start] == sorted(i or 0 for i, _ in rows)
    packed = packing.pack(table(spark, rows)).collect()
    assert sum(r.length for r in packed) == sum(size(t) for _, t in rows) and packing.pack(table(spark, [])).count() == tokens.token_files(table(spark, [])).count() == 0


def test_other_tokenizers(spark, tmp_path):
    """One that keeps case and has other special tokens, one that does not split on white space."""
    from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"Hello": 1, "hello": 2, "world.": 3, "world": 4, ".": 5, "[UNK]": 0, "a": 6}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tok.add_special_tokens([AddedToken("[SEP]", special=True)])
    tok.save(str(tmp_path / "words.json"))
    whole = Tokenizer(models.WordLevel({"a b": 1, "[UNK]": 0}, unk_token="[UNK]"))
    whole.save(str(tmp_path / "whole.json"))
    texts = ["Hello world. [SEP] hello", "world.", "a[SEP]a", None, "", "a b", "HELLO  World\n."]
    for name, t in (("words", tok), ("whole", whole)):
        flat, first = tokens.encode(pa.array(texts), str(tmp_path / f"{name}.json"))
        assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_orc_files(spark, tmp_path):
    """Stripes, row indexes and run-length encoding are in the files, and a range is read through them."""
    from pyarrow import orc

    r = random.Random(1)
    rows = [(i, " ".join(some_words(r, 40))) for i in range(23_000)]
    out = str(tmp_path / "orc")
    tokens.write_orc(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), out, tokens.vocabulary_path())
    files = sorted((tmp_path / "orc").glob("*.orc"))
    found = [orc.ORCFile(str(f)) for f in files]
    assert sum(f.nrows for f in found) == len(rows) and all(f.row_index_stride == 10_000 for f in found if f.nrows) and all(f.compression == "ZSTD" for f in found if f.nrows)
    ids = [f.read(columns=["doc_id"]).column(0).to_pylist() for f in found if f.nrows]
    assert [i for x in ids for i in x] == list(range(len(rows)))  # ascending, across files too
    assert sum(f.stat().st_size for f in files) < 4 * sum(len(f.read(columns=["ids"]).column(0).combine_chunks().flatten()) for f in found if f.nrows)
    few = tokens.read_ids(spark, out, 11_000, 11_004)
    assert sorted(x.doc_id for x in few.collect()) == list(range(11_000, 11_005)) and tokens.read_ids(spark, out, 9, 9).count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,11000)" in few._jdf.queryExecution().executedPlan().toString()


# ---- SpotSigs --------------------------------------------------------------------------

def plain_spots(text):
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    out = set()
    for k, a in enumerate(words):
        after = [w for w in words[k + 1 :] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if a in spotsigs.ANCHORS and len(after) == spotsigs.CHAIN:
            out.add((a, *after))
    return frozenset(out)


def spot_texts(seed=4):
    r = random.Random(seed)
    word = lambda: r.choice(spotsigs.ANCHORS[:30] if r.random() < 0.4 else [f"x{r.randrange(200)}" for _ in range(3)])
    rows, base = [], [word() for _ in range(120)]
    for i in range(25):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = word()
        rows.append((2 * i, " ".join(w)))
    rows += [(100 + i, " ".join(word() for _ in range(r.randrange(5, 150)))) for i in range(20)] + [(200, rows[0][1]), (201, rows[0][1]), (300, None), (301, ""), (302, "!!")]
    return [(i, re.sub(r"[^a-z0-9 ]", "", t) if t else t) for i, t in rows]


def test_likeness(spark):
    rows = spot_texts()
    got = {r.doc_id: r for r in spotsigs.fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else None
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        for want, have in ((like(plain_spots(t), plain_spots(edited)), got[i].near_edited), (like(plain_spots(t), plain_spots(nxt)), got[i].near_next)):
            assert want is None or have == pytest.approx(want)
    assert got[0].fingerprint == got[200].fingerprint and got[200].near_next == 1.0 and got[300].near_edited == 1.0


def test_similar(spark):
    rows = spot_texts(6)
    pairs, members = spotsigs.similar(table(spark, rows), 0.8)
    spots = {i: plain_spots(t or "") for i, t in rows}
    classes = collections.defaultdict(list)
    for i, s in sorted(spots.items()):
        classes[s if s else re.sub(r"[^a-z0-9]+", " ", (dict(rows)[i] or "")).strip()].append(i)
    assert {r.doc_id: r["class"] for r in members.collect()} == {i: c[0] for c in classes.values() for i in c}
    heads = [c[0] for c in classes.values() if spots[c[0]]]
    want = {(a, b): len(spots[a] & spots[b]) / len(spots[a] | spots[b]) for a in heads for b in heads if a < b}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert len(want) > 5 and {(r.a, r.b): pytest.approx(r.likeness) for r in pairs.collect()} == want


# ---- substrings ---------------------------------------------------------------------------

def test_rows_of_one_id(spark):
    """A row loses its own words alone, whatever another row of the same id holds."""
    r = random.Random(2)
    w, z = some_words(r, 100), some_words(r, 100)
    rows = [(1, " ".join(w)), (2, " ".join(w)), (2, " ".join(z)), (2, " ".join(w)), (3, " ".join(z[:70])), (None, " ".join(z[20:]))]
    got = sorted((x.doc_id, x.n_removed, x.kept_sha256) for x in substrings.dedup_substrings(table(spark, rows)).collect())
    sha = lambda words: hashlib.sha256(" ".join(words).encode()).hexdigest()
    assert got == sorted([(0, 0, sha(z[20:])), (1, 0, sha(w)), (2, 100, sha([])), (2, 100, sha([])), (2, 80, sha(z[:20])), (3, 70, sha([]))])


# ---- pipeline -----------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    """Every stage against a plain version that takes the stage's own predecessor."""
    r = random.Random(7)
    kinds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "lich"]}
    word = lambda lang: "".join(r.choice(kinds[lang]) for _ in range(r.randrange(3, 7)))
    prose = lambda lang, n: [word(lang) for _ in range(n)]
    item, passage = prose("aa", 40), prose("bb", 70)
    rows = [(i, " ".join(prose(lang, r.randrange(30, 120))), lang) for i in range(1, 60) for lang in [r.choice("ab") * 2]]
    base = prose("aa", 150)
    for i in range(8):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(150)] = word("aa")
        rows.append((100 + i, " ".join(w), "aa"))
    rows += [(200 + i, " ".join(prose("bb", 40) + passage + prose("bb", 30)), "bb") for i in range(4)] + [(300, " ".join(passage), "bb")]
    rows += [(400, " ".join(prose("aa", 60) + item + prose("aa", 20)), "aa"), (401, None, "aa"), (402, "", None), (403, "12 34", "bb"), (404, " ".join(prose("aa", 6000)), "aa")]
    rows += [(7, " ".join(prose("bb", 90)), "bb"), (None, " ".join(prose("aa", 90)), "aa"), (500, rows[3][1], "bb"), (500, rows[3][1], "bb")]
    docs = table(spark, rows)
    spark.createDataFrame([(1, " ".join(item[:30]) + ". " + " ".join(item[30:]), 5), (2, None, 5)], "item_id long, text string, row long").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = lambda df: sorted((x.doc_id, x.text or "") for x in df.collect())
    stage = dict(corpus_pipeline.STAGES)

    first = stage["language"](spark, docs, str(tmp_path)).cache()
    seen = language.identify(docs, language.train(docs)).collect()
    bad = {g.doc_id for g in seen if g.lang_pred == "und" or g.ambiguous}
    assert pairs(first) == sorted((i or 0, t or "") for i, t, _ in rows if (i or 0) not in bad) and bad == {401, 402, 403}
    assert first.columns == corpus_pipeline.COLUMNS

    second = stage["near_copies"](spark, first, str(tmp_path)).cache()
    numbered = list(enumerate(pairs(first)))
    group = components([(n, t) for n, (_, t) in numbered], 5, Fraction(4, 5))
    least = {}
    for n, (i, _) in numbered:
        least[group[n][1]] = min(least.get(group[n][1], i), i)
    assert pairs(second) == sorted((i, t) for n, (i, t) in numbered if i == least[group[n][1]])

    third = stage["repeated_passages"](spark, second, str(tmp_path)).cache()
    have = pairs(second)
    texts, gone = {n: WORD.findall(t) for n, (_, t) in enumerate(have)}, {}
    start = {}
    for n, (i, _) in enumerate(have):
        for a in range(len(texts[n]) - 49):
            k = tuple(texts[n][a : a + 50])
            start[k] = min(start.get(k, i), i)
    for n, (i, _) in enumerate(have):
        gone[n] = {j for a in range(len(texts[n]) - 49) if start[tuple(texts[n][a : a + 50])] < i for j in range(a, a + 50)}
    want = sorted((i, t if not gone[n] else " ".join(w for j, w in enumerate(texts[n]) if j not in gone[n])) for n, (i, t) in enumerate(have) if not gone[n] or len(gone[n]) < len(texts[n]))
    assert pairs(third) == want and any(gone.values())

    fourth = stage["contamination"](spark, third, str(tmp_path)).cache()
    hit = plain_contaminated(list(enumerate(t for _, t in pairs(third))), [(1, " ".join(item[:30]) + ". " + " ".join(item[30:]))])
    assert pairs(fourth) == sorted(p for n, p in enumerate(pairs(third)) if (n, 1) not in hit) and 400 not in {i for i, _ in pairs(fourth)}

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary_path())
    want = collections.Counter()
    for i, t in pairs(fourth):
        x = [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID]
        want.update((i, p // 4096, p, len(x[p : p + 4096]), tokens.crc32(np.array(x[p : p + 4096]))) for p in range(0, len(x), 4096))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    rooms = collections.defaultdict(list)
    for r_ in packed:
        rooms[r_.sequence_id].append((r_.offset, r_.length))
    assert all(sum(max(s)) <= 4096 and sum(n for _, n in s) == sum(max(s)) for s in rooms.values())
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, table(spark, []), str(tmp_path)).count() == 0, name


def test_folds(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("f", crc_mod(7)).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)


def test_hostile_models(spark):
    """Null and repeated ids, empty and long texts for the language model and the joins."""
    r = random.Random(8)
    rows = [(None, "a b c"), (None, None), (0, ""), (4, "a b c"), (4, "A B C"), (4, "other"), (9, " ".join(some_words(r, 40000)))]
    scored = ngram_lm.score(table(spark, rows)).collect()
    assert sorted((s.doc_id, s.n_tokens) for s in scored) == sorted((i or 0, len((t or "").split()) + 1) for i, t in rows)
    near = jaccard_groups(table(spark, rows)).collect()
    assert sorted((n.doc_id, n.component_id) for n in near) == [(0, 0), (0, 0), (0, 0), (4, 0), (4, 0), (4, 4), (9, 9)]
    assert removed_by_hand([(1, "x")]) == {1: 0}


def test_large_stars(spark, monkeypatch):
    """A star's members in many runs, each led by its centre."""
    from sectorlake.llm import jaccard
    from test_llm import corpus

    monkeypatch.setattr(jaccard, "MEMBERS_A_RUN", 3)
    rows = corpus(11, 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(table(spark, rows), 5, Fraction(4, 5)).collect()}
    assert got == components(rows, 5, Fraction(4, 5))


def test_hot_contexts(spark, monkeypatch):
    """Contexts that are spread over shards by the word too score as others do."""
    r = random.Random(12)
    rows = [(i, " ".join(some_words(r, 80, 12))) for i in range(40)]
    plain = {s.doc_id: s.score for s in ngram_lm.score(table(spark, rows)).collect()}
    monkeypatch.setattr(ngram_lm, "HOT_TOKENS", 20)
    hot = {s.doc_id: s.score for s in ngram_lm.score(table(spark, rows)).collect()}
    assert hot.keys() == plain.keys() and all(hot[i] == pytest.approx(plain[i], rel=1e-3) for i in plain)


def test_many_shards(spark, monkeypatch):
    """Several shards for a task score as a task for each."""
    r = random.Random(13)
    rows = [(i, " ".join(some_words(r, 60, 30))) for i in range(30)]
    plain = {s.doc_id: s.score for s in ngram_lm.score(table(spark, rows)).collect()}
    monkeypatch.setattr(ngram_lm, "MOST_TASKS", 3)
    dealt = {s.doc_id: s.score for s in ngram_lm.score(table(spark, rows)).collect()}
    assert dealt.keys() == plain.keys() and all(dealt[i] == pytest.approx(plain[i], rel=1e-6) for i in plain)
