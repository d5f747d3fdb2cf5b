"""Corpus operators against brute force and SQL, and their defined cases."""

import collections
import hashlib
import math
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilcount.llm import decontam, fertility, htmltext, langid, licenses, linededup, neardup, ordinal, packing, queries, substr
from veilcount.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, rank int, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 6))) for _ in range(n))


LINES = "\n".join(prose(s, 8) for s in range(90, 95))
ROWS = [
    (1, prose(1), "en", "a.b.fr"), (2, prose(1), "en", None), (3, prose(1, 59) + " zz", None, "h"), (3, prose(1, 59) + " zz", None, "h"),
    (4, None, "en", "h"), (5, "", None, None), (6, " \n\t", "xx", ""), (None, prose(1), None, "h"), (None, None, None, None),
    (7, "x", "en", "h"), (8, prose(8, 30_000), "en", "h"), (9, LINES + "\n" + prose(7), "en", "h"), (10, prose(6) + "\n" + LINES, "en", "h"),
    (11, "Licensed under the MIT License.\n<|endoftext|> é Á!̸ it's 'tis ΣΣ", "en", "h"), (12, prose(1), "de", "h"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, None, "c", 1, "n") for r in ROWS], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.mark.parametrize("name", ["op4_line_dedup", "op9_substring_dedup", "op10_license_scan"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda x: sorted(map(repr, x.astype(object).values.tolist()))
    assert key(got) == key(want)


def brute_substr(rows, least=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - least + 1):
                k = tuple(w[p : p + least])
                seen[k] = min(seen.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - least + 1):
            if i is not None and seen[tuple(w[p : p + least])] < i:
                gone[p : p + least] = [True] * least
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def test_substr_cases(edge, none):
    got = collections.Counter(tuple(r)[:4] for r in substr.dedup(edge).collect())
    assert got == brute_substr([r[:2] for r in ROWS])
    assert substr.dedup(none).count() == 0


@pytest.mark.parametrize(("least", "k"), [(13, 5), (5, 2), (4, 4)])
def test_substr_by_brute_force(spark, least, k):
    """Passages cut, shifted, edited and repeated within and across documents; words that recur within a window."""
    rng = np.random.default_rng(least)
    source = [prose(800 + i, 40).split() for i in range(6)] + [["a"] * 40, ["a", "b"] * 20, ["x", "y", "z"] * 12]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.integers(0, 5)):
            part = source[rng.integers(len(source))]
            a = int(rng.integers(0, len(part)))
            part = list(part[a : a + int(rng.integers(1, 40))])
            if len(part) > 3 and rng.random() < 0.4:
                part[int(rng.integers(len(part)))] = f"e{i}"
            words += part + prose(900 + i, int(rng.integers(0, 6))).split()
        rows.append((int(rng.integers(0, 60)), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = collections.Counter(tuple(r)[:4] for r in substr.dedup(docs, least, k).collect())
    assert got == brute_substr(rows, least)


def test_packing_cases(edge, none):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, n, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    rows = packing.pack(edge, path).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 4096
    assert packing.pack(none, path).count() == 0


def test_chunks_encoded_together_have_the_ids_they_have_alone():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    words = ["a", "it's", "12", "é", "Σ", "<|start", "of|>", "!?", "<", "x" * 300, "ǅ", "ﬁ", "e\u0301", "\u0301", "\x00", "\u200b", "\ufeff", "日本", "🙂"] + prose(1, 500).split()
    alone = [t.encode(w, add_special_tokens=False).ids for w in words]
    for given, want in ((words, alone), (words + ["b<|endoftext|>c"], [*alone, t.encode("b<|endoftext|>c", add_special_tokens=False).ids])):
        lengths, ids = packing._encoded(t, given)
        assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_bins_are_best_fit():
    rng = np.random.default_rng(1)
    b, free = packing.Bins(100, 8), {}
    for length in rng.integers(1, 101, 500).tolist():
        fits = [f for f in free.values() if f >= length]
        got, at = b.place(length)
        if fits:
            assert free[got] == min(fits) and at == 100 - min(fits)
        else:
            assert at == 0
            free[got] = 100
        free[got] -= length
        still = {x for bins in b.by_free for x in bins}
        closed = set(free) - still
        assert len(still) <= 8 and all(free[x] == 0 or free[x] <= min(free[y] for y in still - {got} or {x}) for x in closed)
        free = {x: free[x] for x in still}


VOCABULARIES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")


def brute_tokens(texts):
    """By vocabulary and text: n_tokens, chars_per_token, byte_share, token_entropy, of whole texts."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    p = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARIES[1], "rb"))}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def part(i):
        try:
            t.decode_bytes([i]).decode()
            return False
        except UnicodeDecodeError:
            return True

    for encode, is_byte in ((p.encode, p.is_byte), (t.encode_ordinary, part)):
        out = []
        for x in texts:
            ids = encode(x)
            n = max(1, len(ids))
            out.append((len(ids), len(x) / n, sum(map(is_byte, ids)) / n, -sum(c / n * math.log2(c / n) for c in collections.Counter(ids).values())))
        yield out


def test_fertility_cases(edge, none):
    texts = [t or "" for _, t, *_ in ROWS]
    rows = fertility.judge(edge, *VOCABULARIES, least=3).collect()
    want = []
    one, two = brute_tokens(texts)
    for (i, *_), t, a, b in zip(ROWS, texts, one, two, strict=True):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {q for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for q in range(k, k + 5)}
        bad = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), bad, *a, *b))
    names = [f"{m}{v}" for v in fertility.VOCABULARIES for m in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")]
    key = lambda x: sorted([[-1 if y is None else round(float(y), 6) for y in r] for r in x])
    assert key([(*tuple(r)[:7], *(r[m] for m in names)) for r in rows]) == key(want)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert all(r["kept"] == (not r["base_failed"] and not r["fertility_failed"]) for r in rows)
    assert fertility.judge(none, *VOCABULARIES).count() == 0


def test_fertility_scripts(spark):
    texts = ["Hello there", "Привет, как дела", "γειά σου Κόσμε", "你好世界 ok", "こんにちは", "안녕하세요", "مرحبا", "שלום", "नमस्ते", "12 ?!", "", None, "x"]
    docs = spark.createDataFrame([(i, t, " " if i % 2 else None) for i, t in enumerate(texts)] + [(99, "Hello", "de")], "doc_id int, text string, lang string")
    got = {r["doc_id"]: r["lang"] for r in fertility.measures(docs, *VOCABULARIES).collect()}
    want = ["latn", "cyrl", "grek", "hani", "kana", "hang", "arab", "hebr", "indc", "und", "und", "und", "latn"]
    assert got == {99: "de"} | {i: f"script:{x}" for i, x in enumerate(want)}


def test_fertility_bands_by_brute_force(spark):
    """With least=0 a band is that of its class alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = fertility.judge(docs, *VOCABULARIES, least=0).toPandas()
    rows["size"] = np.floor(np.log2(rows["n_tokens"].clip(lower=1)))
    failed = np.zeros(len(rows), bool)
    for m, width, slack in fertility.MEASURES:
        for _, x in rows[~rows["base_failed"]].groupby(["band", "size"]):
            bins = np.sort(np.floor(x[m] / width + 0.5).to_numpy())
            a, b, c = (bins[int(np.ceil(p * len(bins))) - 1] for p in (0.25, 0.5, 0.75))
            low, high = width * (b - 4 * (b - a)) - slack, width * (b + 4 * (c - b)) + slack
            failed[x.index[(x[m] < low) | (x[m] > high)]] = True
    here = ~rows["base_failed"].to_numpy()
    assert (rows["fertility_failed"].to_numpy()[here] == failed[here]).all() and failed.any()


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return fertility.judge(docs, *VOCABULARIES).join(docs.select("doc_id", "text"), "doc_id").toPandas()


def test_fertility_rejects_junk_and_keeps_clean_text(judged):
    rows = judged[~judged["base_failed"]]
    gone = set(rows.loc[rows["fertility_failed"], "doc_id"])
    assert gone >= {39, 40, 101, 1418}
    share = rows["n_symbols"] / rows["n_words"]
    print(rows.loc[share >= 1, "fertility_failed"].mean(), rows.loc[share < 0.2, "fertility_failed"].mean())
    assert rows.loc[share >= 1, "fertility_failed"].mean() > 0.85
    assert rows.loc[share < 0.2, "fertility_failed"].mean() < 0.015


def test_fertility_bands_at_every_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = fertility.measures(docs, *VOCABULARIES).withColumn("base_failed", F.expr("n_words < 10"))
    bands = fertility.bands(measured)
    classes = fertility._classed(measured).where("not base_failed").select("band", "size").distinct()
    assert bands.join(classes, ["band", "size"]).dropna().count() == classes.count() == bands.count()
    words = [w for r in docs.where("lang = 'en'").orderBy("doc_id").limit(100).collect() for w in r["text"].split() if w[-3:] in ("&&&", "***", "$$$", "%%%", "###")]
    junk = spark.createDataFrame([(-1, " ".join(np.random.default_rng(1).choice(words, 6000).tolist()), "en")], "doc_id bigint, text string, lang string")
    rows = fertility.judge(docs.select("doc_id", "text", "lang").union(junk), *VOCABULARIES).where("doc_id = -1").collect()
    assert [(r["base_failed"], r["fertility_failed"]) for r in rows] == [(False, True)] and rows[0]["n_tokens"] >= 8192


def shingles(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8, hot=neardup.HOT):
    sets, df = {}, collections.Counter()
    for i, t in rows:
        x = shingles(t)
        df.update(x.keys())
        if i is not None:
            sets.setdefault(i, []).append(x)
    n = len(rows)
    idf = {g: max(0.05, min(1, math.log((n + 100) / c) / math.log(1 / hot))) if c > hot * n else 1.0 for g, c in df.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def weight(x):
        return sum(c * idf[g] for g, c in x.items())

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(weight(x & y) >= threshold * weight(x | y) > 0 for x in sets[a] for y in sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_near_dedup(edge, none, real):
    for docs in (edge, real):
        rows = docs.select("doc_id", "text").collect()
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
        assert {k: v for k, v in got.items() if k is not None} == brute_classes([tuple(r) for r in rows])
    assert neardup.classes(none).count() == 0


def test_near_dedup_weighs_common_shingles_less(spark):
    """Texts that share a passage half of all documents have are alike only where the passage counts in full."""
    common = prose(50, 120)
    rows = [(i, common + " " + prose(1000 + i, 22)) for i in range(60)] + [(100 + i, prose(2000 + i, 140)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weighed = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, threshold=0.6).collect()}
    plain = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, threshold=0.6, hot=1.0).collect()}
    assert weighed == brute_classes(rows, 0.6) and len(set(weighed.values())) == 120
    assert plain == brute_classes(rows, 0.6, hot=1.0) and len(set(plain.values())) == 61


def test_pipeline_near_dedup_weighs_every_shingle_by_idf(spark):
    """A passage that 12 of 400 rows have weighs less than what only one has, and one that two have only a little less."""
    words = iter(range(10**6))
    fresh = lambda n: " ".join(f"w{next(words)}" for _ in range(n))
    common, pair = fresh(150), fresh(150)
    rows = [(i, f"{common} {fresh(15)}") for i in range(12)] + [(20 + i, f"{pair} {fresh(15)}") for i in range(2)]
    rows += [(100 + i, fresh(12)) for i in range(384)] + [(None, common), (None, None)]
    df = collections.Counter(g for _, t in rows for g in shingles(t))

    def alike(x, y):
        weight = lambda z: sum(c * (1 + math.log((1 + len(rows)) / (1 + df[g]))) for g, c in z.items())
        return weight(x & y) / weight(x | y)

    texts = {i: shingles(t) for i, t in rows if i is not None}
    assert alike(texts[0], texts[1]) < 0.79 and alike(texts[20], texts[21]) > 0.81
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _ in rows} - {21} and len(kept) == len(rows) - 1


def edited(words, rate, rng):
    return " ".join(f"e{rng.integers(10**9)}" if rng.random() < rate else w for w in words)


@pytest.mark.parametrize("block", [4096, 200])
def test_near_dedup_of_a_group_about_the_threshold(spark, monkeypatch, block):
    """1500 copies of one text with 0 to 7 % of the words replaced: three of four pairs are below the threshold."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(3)
    words = prose(70, 150).split()
    rows = [(i, edited(words, rng.uniform(0, 0.07), rng)) for i in range(1500)]
    sets = [set(shingles(t)) for _, t in rows]
    names = {g: k for k, g in enumerate(set().union(*sets))}
    a = np.zeros((len(rows), len(names)), np.float32)
    for i, x in enumerate(sets):
        a[i, [names[g] for g in x]] = 1
    common = a @ a.T
    size = a.sum(axis=1)
    links = common >= 0.8 * (size[:, None] + size - common) - 1e-6
    assert 0.1 < links.mean() < 0.4
    up = np.arange(len(rows))
    for _ in range(50):
        up = np.array([up[x].min() for x in links])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, hot=1.0).collect()}
    lost = sum(got[i] != up[i] for i in range(len(rows)))
    assert lost == 0, (lost, len(set(up)), len(set(got.values())))


@pytest.mark.parametrize("copies", [1, 2])
def test_near_dedup_of_a_group_below_the_threshold_compares_few_pairs(spark, monkeypatch, copies):
    """400 short copies of one text, most alike at about 0.7 under idf: sketches alone leave a large part of all pairs to be verified."""
    rng = np.random.default_rng(4)
    words = prose(71, 150).split()
    rows = []
    for i in range(400):
        w, n = list(words), rng.choice([1, 2, 3], p=[0.35, 0.5, 0.15])
        for at in rng.choice(len(w), n, replace=False):
            w[at] = f"e{rng.integers(10**9)}"
        rows += [(1000 * c + i, " ".join(w)) for c in range(copies)]
    rows += [(10000 + i, prose(9000 + i, 8)) for i in range(4000)]
    df = collections.Counter(g for _, t in rows for g in shingles(t))
    names = {g: k for k, g in enumerate(df)}
    weight = np.array([1 + math.log((1 + len(rows)) / (1 + c)) for c in df.values()])
    a = np.zeros((400, len(names)))
    for i, (_, t) in enumerate(r for r in rows if r[0] < 400):
        assert max(shingles(t).values()) == 1
        a[i, [names[g] for g in shingles(t)]] = 1
    common, size = (a * weight) @ a.T, a @ weight
    alike = common / (size[:, None] + size - common)
    links = alike >= 0.8 - 1e-9
    assert 0.6 < np.median(alike) < 0.75 and links.sum() > 440
    up = np.arange(400)
    for _ in range(50):
        up = np.array([up[x].min() for x in links])
    pairs, verified = [], neardup._Search.verified
    monkeypatch.setattr(neardup._Search, "verified", lambda self, x: pairs.append(x.count()) or verified(self, x))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert all(got[1000 * c + i] == up[i] for i in range(400) for c in range(copies))
    assert sum(pairs) < links.sum() + 400 * 5, pairs


def test_consistent_sampling_follows_weighted_similarity():
    rng = np.random.default_rng(4)
    g = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    a, b = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.zeros(300, np.int64)
    got = (neardup.samples(g, doc, a, 1, 2000) == neardup.samples(g, doc, b, 1, 2000)).mean()
    assert abs(got - want) < 0.05


def test_decontamination(spark, edge, none, real):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in real.collect() for i, t in items.items() if t in plain(r["text"])}
    found = decontam.leaks(real, bench).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in found} and all(r["score"] >= 0.5 for r in found)
    i, text = next((i, t.split()) for i, t in items.items() if len(t.split()) > 30)
    edited = " ".join("qqq" if k % 7 == 3 else w for k, w in enumerate(text))
    docs = spark.createDataFrame([(1, prose(2) + " " + edited + " " + prose(3)), (2, prose(5)), (None, None), (3, "")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()] == [(1, i)]
    odd = spark.createDataFrame([(1, None), (2, "two words"), (None, " ".join(prose(1).split()[5:40]))], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(edge, odd).collect()} == {(1, None), (2, None), (3, None), (12, None), (None, None)}
    assert decontam.leaks(none, bench).count() == decontam.leaks(edge, odd.limit(0)).count() == 0


def test_decontamination_of_an_edited_copy_beside_an_exact_one(spark):
    words = prose(11, 40).split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    edited = " ".join("qqq" if k % 5 == 4 else w for k, w in enumerate(words))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, edited)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs, bench).collect()} == {1, 2}


def brute_lines(rows, least, chars):
    """{doc_id: kept text}: lines of maximal runs that also stand earlier and are long enough, found pair by pair."""
    seq = []
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        seq += [(i, n, x.strip(linededup.BLANKS)) for n, x in enumerate(t.split("\n")) if x.strip(linededup.BLANKS)]
        seq.append((i, -1, None))
    gone = set()
    for p in range(len(seq)):
        for q in range(p):
            n = 0
            while p + n < len(seq) and seq[p + n][2] is not None and seq[p + n][2] == seq[q + n][2]:
                n += 1
            if n >= least or n and chars is not None and sum(len(x[2]) for x in seq[p : p + n]) >= chars:
                for k in range(n):
                    here = seq[p + k]
                    after = seq[p + k + 1][1] if k + 1 < n else here[1] + 1
                    gone |= {(here[0], m) for m in range(here[1], max(after, here[1] + 1))}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


@pytest.mark.parametrize(("least", "chars"), [(3, 20), (3, None), (1, None), (2, 12)])
def test_line_dedup_by_brute_force(spark, least, chars):
    rng = np.random.default_rng(9)
    pool = ["x", "yes", "no more", "a middling line", "one line that is long enough", "another line of some length", " blank ", "tail"]
    rows = []
    for i in range(40):
        lines = [str(x) for x in rng.choice(pool, rng.integers(0, 9))] + [f"own {i} {rng.integers(99)}"] * int(rng.integers(0, 2))
        for at in sorted(rng.integers(0, len(lines) + 1, 2).tolist(), reverse=True):
            lines.insert(at, str(rng.choice(["", "  ", "\t", f"u{rng.integers(999)}"])))
        rows.append((i, "\n".join(lines)))
    rows.append((40, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(docs, least, chars).collect()} == brute_lines(rows, least, chars)


def test_line_dedup_cases(edge, none):
    out = linededup.dedup(edge)
    assert out.columns == [*edge.columns, "__vc_spans"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[9] == LINES + "\n" + prose(7) and texts[10] == prose(6) and texts[4] is None and texts[5] == ""
    assert texts[1] == prose(1) and texts[2] == texts[12] == ""  # a long line that stands in a smaller document
    whole = {r["doc_id"]: r["text"] for r in linededup.dedup(edge, chars=None).collect()}
    assert whole[1] == whole[2] == whole[12] == prose(1) and whole[10] == prose(6)
    assert linededup.dedup(none).count() == 0


def test_language_id(edge, none, real):
    rows = langid.identify(langid.of_documents(real), ["doc_id"]).collect()
    assert np.mean([r["language"] == r["declared"] for r in rows]) > 0.97 and np.mean([r["rejected"] for r in rows]) < 0.02
    out = langid.identify(langid.of_documents(edge), ["doc_id"]).collect()
    assert len(out) == len(ROWS) and all(r["rejected"] for r in out if r["doc_id"] in (4, 5, 6))
    assert langid.identify(langid.of_documents(none), ["doc_id"]).count() == 0


def test_language_sample_keeps_rare_languages(spark):
    rows = [("en", prose(i, 30)) for i in range(1000)] + [("xx", prose(5000 + i, 30).upper()[::-1]) for i in range(6)]
    docs = spark.createDataFrame(rows, "declared string, text string")
    few, all_ = langid.train(docs, sample=40), langid.train(docs, sample=10_000)
    assert few.languages == all_.languages == ["en", "xx"]
    assert np.array_equal(few.logs[1], all_.logs[1]) and not np.array_equal(few.logs[0], all_.logs[0])
    assert langid.quotas({"a": 1000, "b": 6, "c": 10**9}, 106) == {"b": 6, "a": 50, "c": 50}


def brute_languages(rows, model):
    """{row number: (language, confidence)} by the formulas, row by row; rows: text, declared, host."""
    size, kappa = len(model.languages), langid.KAPPA
    logs, soft, count = [], [], []
    for text, _, _ in rows:
        raw = list((text or "").encode())
        x = [ord(chr(b).lower()) if b < 0x80 and chr(b).isalpha() else 0x20 if b < 0x80 else b + 0x20 if k and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b for k, b in enumerate(raw)]
        grams = [tuple(x[k : k + 3]) for k in range(len(x) - 2)]
        grams = [g for g in grams if (g[0], g[1]) != (32, 32) and (g[1], g[2]) != (32, 32)]
        keys = [((a | b << 8 | c << 16) * 0x9E3779B1 % 2**32) >> 18 for a, b, c in grams]
        z = np.zeros(size) if not keys else model.logs[:, keys].mean(axis=1) * min(len(keys), langid.EFFECTIVE)
        e = np.exp(z - z.max())
        logs.append(z), soft.append(e / e.sum() * bool(keys)), count.append(len(keys))
    declared = [(re.match("[a-z]+", (d or "").strip().lower()) or [None])[0] for _, d, _ in rows]
    hosts = [h.strip().lower() if h is not None else None for _, _, h in rows]
    up = {}
    for h in set(hosts) - {None}:
        labels = h.split(".")
        up[h] = (".".join(labels[-2:]) if len(labels) > 2 else h, labels[-1] if len(labels) > 1 else "")
    said = np.full((size, size), 0.5)
    total = [collections.defaultdict(lambda: np.zeros(size)) for _ in range(3)]
    for d, h, s in zip(declared, hosts, soft, strict=True):
        if d in model.languages:
            said[model.languages.index(d)] += s
        if h is not None:
            for t, key in zip(total, (h, *up[h]), strict=True):
                t[key] += s
    said = np.log(said / said.sum(axis=0))
    share = lambda n, base: (n + kappa * base) / (n.sum() + kappa)
    out = {}
    for k, (z, d, h, s, n) in enumerate(zip(logs, declared, hosts, soft, count, strict=True)):
        score = z.copy()
        if d in model.languages:
            score += said[model.languages.index(d)]
        if h is not None:
            domain, suffix = up[h]
            base = share(total[1][domain], share(total[2][suffix], np.full(size, 1 / size)))
            score += np.log(np.maximum(share(total[0][h] - s, base), 1e-9))
        p = np.exp(score - score.max())
        out[k] = (model.languages[int(p.argmax())], 1 / p.sum()) if n else ("und", 0.0)
    return out


def test_language_id_by_brute_force_with_hosts_in_a_hierarchy(spark, real):
    rng = np.random.default_rng(8)
    hosts = ["www.a.fr", "b.a.fr", "a.fr", "shop.x.de", "x.de", "news.co.uk", "plain", "", None, "M.A.FR "]
    tags = lambda x: [x, f"{x.upper()}-XX", f" {x}", None, "", "zz", "en"][rng.integers(7)]
    cut = lambda t: (t or "")[: int(rng.choice([0, 2, 9, 25, 60, 4000]))]
    rows = [(cut(r["text"]), tags(r["lang"] or "en"), hosts[rng.integers(len(hosts))]) for r in real.collect()]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, declared string, host string")
    model = langid.train(df.withColumn("declared", F.expr("nullif(regexp_extract(lower(trim(declared)), '^[a-z]+', 0), '')")))
    assert len(model.languages) >= 4
    want = brute_languages(rows, model)
    got = {r["id"]: r for r in langid.identify(df, ["id"]).collect()}
    assert len(got) == len(rows)
    for i, (language, confidence) in want.items():
        assert abs(got[i]["confidence"] - confidence) < 2e-6, i
        assert got[i]["language"] == language or 0.49 < confidence < 0.51
        assert got[i]["rejected"] == (got[i]["confidence"] < 0.5)
    alone = {r["id"]: r["confidence"] for r in langid.identify(df.withColumn("host", F.lit(None).cast("string")), ["id"]).collect()}
    assert any(abs(alone[i] - got[i]["confidence"]) > 0.05 for i in got)  # hosts count


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(f"l{chr(97 + i % 8)}", prose(i, 20)) for i in range(8 * 30)] + [("la", prose(900 + i, 20)) for i in range(9)] + [("rare", prose(i)) for i in range(4)]
    assert langid.train(spark.createDataFrame(rows, "declared string, text string")).languages == ["la", "lb", "lc"]


def smith_waterman(item, text):
    h = np.zeros(len(text) + 1, int)
    best = 0
    for x in item:
        t = np.maximum(h - 1, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where([x == y for y in text], 2, -1)) if len(text) else t[1:]
        for j in range(1, len(t)):
            t[j] = max(t[j], t[j - 1] - 1)
        h = t
        best = max(best, int(h.max()))
    return best / (2 * len(item))


def test_decontamination_scores_by_brute_force(spark):
    """Every score, and that nothing else is found, over items edited by replacing, leaving out and putting in words."""
    rng = np.random.default_rng(6)
    items = {i: prose(300 + i, int(rng.integers(3, 30))).split() for i in range(12)} | {50: ["same"] * 6, 51: ["two", "words"]}
    docs = {}
    for d in range(60):
        words = prose(400 + d, 15).split()
        for i in rng.choice(list(items), 2, replace=False):
            kept = []
            for w in items[i]:
                u = rng.random()
                kept += [w] if u > 0.3 else [] if u > 0.2 else [f"q{d}"] if u > 0.1 else [w, f"q{d}"]
            words += kept + prose(500 + d, 12).split()
        docs[d] = words
    docs[60] = ["same"] * 500 + items[3] * 9  # one item again and again
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id bigint, text string")
    table = spark.createDataFrame([(d, " ".join(x).upper() + "!") for d, x in docs.items()], "doc_id bigint, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(table, bench).collect()}
    want = {}
    for d, text in docs.items():
        grams = {tuple(text[k : k + 3]) for k in range(len(text) - 2)}
        for i, x in items.items():
            if any(tuple(x[k : k + 3]) in grams for k in range(len(x) - 2)) and (score := smith_waterman(x, text)) >= decontam.THRESHOLD:
                want[d, i] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert 30 < len(want) < 130


def test_decontamination_of_very_long_texts_works_in_bounded_steps(spark, monkeypatch):
    sizes = []
    align = decontam.align
    monkeypatch.setattr(decontam, "align", lambda a, b: (sizes.append(len(b) * max(map(len, b))), align(a, b))[1])
    words = prose(11, 40).split()
    bench = [{"item_id": 1, "text": " ".join(words)}, {"item_id": 2, "text": "same same same same"}]
    text = " ".join(["same"] * 300_000 + words[:30] + words * 200 + ["x"] * 1000 + words)
    block = decontam.items(bench)
    seeds = decontam.seeds(block, decontam.Keys(block.grams(3)[0]), np.zeros(0), 3, 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text])], ["doc_id", "text"])
    found = [r for b in decontam._leaks(block, seeds, 3, 0.5)([batch]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in found] == [(7, 1, 1.0), (7, 2, 1.0)]
    assert max(sizes) <= decontam.AREA


def test_ordinal_sample_is_cut_by_hash_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 2000, prose(i, 8)) for i in range(4000)], "doc_id bigint, text string")  # two rows of each doc_id
    ratings = spark.createDataFrame([(i, i % 3) for i in range(2000)] + [(5, 2)] * 3000, "doc_id bigint, grade int")
    seen = {}
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades, levels: seen.update(rows=rows, grades=grades))
    ordinal.train(docs, ratings, 3, sample=600)
    share = np.bincount(seen["grades"], minlength=3) / len(seen["grades"])
    assert len(seen["grades"]) == 600 and (abs(share - 1 / 3) < 0.08).all()
    monkeypatch.setattr(ordinal, "FEATURES", 3000)
    ordinal.train(docs, ratings, 3, sample=600)
    assert 1500 < sum(map(len, seen["rows"])) < 4500


def test_ordinal_scores_by_brute_force(spark, real):
    """P(grade > k) is the logistic of the sum of the weights of the features a text has, less the threshold."""
    rng = np.random.default_rng(2)
    model = ordinal.Model(rng.normal(0, 0.05, ordinal.BUCKETS).astype(np.float32).astype(float), np.array([-0.3, 0.4]))
    for r, row in zip(real.orderBy("doc_id").collect(), ordinal.score(real, model, 3).orderBy("doc_id").collect(), strict=True):
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        key, _ = ordinal.features(raw, np.array([0, len(raw)]))
        assert len(set(key.tolist())) == len(key)
        z = model.weights[key].sum()
        tails = [1 / (1 + np.exp(-(z - t))) for t in model.thresholds]
        assert np.allclose(row["tails"], tails, atol=1e-4) and abs(row["expected_grade"] - sum(tails)) < 2e-4
        assert row["kept"] == (row["expected_grade"] >= 1 and row["tails"][0] >= 0.5)


def test_columns_that_clash(spark):
    names = "key node rank h band n text_a __vc_d __vc_k __vc_0 __vc_1 __vc_in __vc_word spans d k line bits word score grade host declared language".split()
    rows = [(i, prose(i % 5) + "\n" + LINES, "en", "a.b.de", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{x} bigint" for x in names))
    plain = docs.select("doc_id", "text", "lang", "source")
    model = ordinal.Model(np.zeros(ordinal.BUCKETS), np.zeros(2))
    bench = spark.createDataFrame([(1, prose(2))], "item_id bigint, text string")
    for f in (neardup.classes, substr.dedup, licenses.scan, lambda x: decontam.leaks(x, bench.withColumn("key", F.lit(1))), lambda x: langid.identify(langid.of_documents(x), ["doc_id"]), lambda x: ordinal.score(x, model, 3), lambda x: fertility.judge(x, *VOCABULARIES), lambda x: packing.pack(x, vocabulary("word_bpe_49k.json")).drop("sequence_id", "offset")):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(plain).collect()))
    out = linededup.dedup(docs)
    assert out.columns == [*docs.columns, "__vc_spans"] and sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, linededup.dedup(plain).select("doc_id", "text").collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_html():
    page = """<html><head><title>t</title></head><body><header><a href=/>Home</a></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use it on the site and for the rest of it.</div>
    <article><h1>Short &amp; plain</h1><p>One.<p>Two<br>lines &nbsp; here &eacute;<script>var a = "<p>no</p>";</script></p><form><p>mail</p></form><!-- <p>no</p> --></article>
    <aside><p>The aside is for all of you and it is not the text of the page at all.</p></aside><section id="comments"><p>I like it and so do you, as it is for all of us to be in the end of it.</p></section><footer>end</footer>"""
    assert htmltext.main_text(page) == "Short & plain\nOne.\nTwo lines here é"
    assert htmltext.main_text(None) == htmltext.main_text("") == ""
    bare = "<div><a href=x>one</a> <a href=y>two</a></div><p>It was the best of times and it was the worst of times, as all of them said in the end.<p>Yes.<p>But then there was more of it, and all of that was for the good of them and of the rest."
    assert htmltext.main_text(bare).count("\n") == 2 and "Yes." in htmltext.main_text(bare)
    for broken in ("<", "<p", "</", "<!--", "<script>", "<a href='", "&#xZZ; &amp", "<p></b></p></p>"):
        htmltext.main_text(broken)


def test_html_keeps_text_after_missing_ends():
    long = "It was the best of times and it was the worst of times, as all of them said in the end."
    for bad in ("<button>Click", "<svg><path d=x>", "<svg/>", "<select><option>one", "<iframe src=x>", "<object data=x>", "<canvas>", "<a href=x>link", "<noscript>", "<video src=x>", "<svg><svg></svg><text>in</text></svg>", "<template><p>no</p></template>", "<button>a<b>b</b></button>"):
        for page in (f"<article><p>{long}</p>{bad}<p>{long}</p><p>{long}</p></article>", f"<div><p>{long}</p>{bad}<p>{long}</p><div>{long}</div></div>"):
            got = htmltext.main_text(page).split("\n")
            assert got.count(long) == 3 and set(got) <= {long, "link"}, (bad, got)
    assert htmltext.main_text(f"<p>{long}</p><script>var a = 1; <p>{long}</p>") == long


def test_html_reads_attributes_of_paragraphs_and_inline_elements():
    long = "It was the best of times and it was the worst of times, as all of them said in the end."
    page = f'<article><p>{long}</p><p class="advert">Buy it now, as it is the best of all of them and for you.<p class=cookie-notice>We use it.</p><p>And <span class="share">share it <span>now</span></span>then <a href=x class="social-link">post</a> it <em>was</em> over.</p></article>'
    assert htmltext.main_text(page) == f"{long}\nAnd then it was over."
    assert htmltext.main_text(f"<p class=sponsored>{long}</p><p>{long}</p>") == long


def test_html_in_languages_without_known_stop_words():
    ru = "Это был лучший из дней. Это был худший из дней, и все они так говорили в конце."
    ja = "これは最高の時代であり、最悪の時代でもあった。人々はみなそう言った。終わりまで。"
    tr = "Zamanlarin en iyisiydi, zamanlarin en kotusuydu. Hepsi sonunda boyle soyledi."
    for text in (ru, ja, tr):
        page = f"<div><a href=x>{text[:8]}</a> <a href=y>{text[9:14]}</a></div><div>{text}</div><p>{text}</p><ul><li><a href=z>{text[:12]}</a></ul>"
        assert htmltext.main_text(page) == f"{text}\n{text}", text


def made_page(rng):
    """A page and its main text, both by construction."""
    words = "the of and to in is that it for on with as are was be by this at or from an not but which have had his they you were all".split() + [f"w{i}x" for i in range(60)]
    say = lambda a, b: " ".join(rng.choice(words, rng.integers(a, b)).tolist()).capitalize() + "."
    mark = lambda t: t.replace(" the ", " <i>the</i> ").replace(" of ", " &#111;f\n ").replace(" is ", " <!-- <p>no</p> -->is ")
    end = lambda x: x if rng.random() < 0.7 else ""
    main, body = [], []
    for _ in range(rng.integers(2, 12)):
        t = say(12, 60) if rng.random() < 0.7 else say(2, 6)
        kind = rng.choice(["p", "p", "h2", "li", "blockquote", "div"])
        opened = {"li": "<ul><li>"}.get(kind, f"<{kind}>")
        closed = {"li": "</ul>", "p": end("</p>")}.get(kind, f"</{kind}>")
        body.append(opened + mark(t) + closed)
        main.append(t)
        if rng.random() < 0.4:
            body.append(rng.choice([f'<div class="ad">{say(5, 30)}</div>', f'<p class="promo">{say(5, 20)}</p>', f"<aside><p>{say(10, 30)}</aside>", f"<form><label>{say(2, 5)}</label><button>{say(1, 3)}</button></form>", f"<script>if (a < b) {{ '{say(3, 9)}' }}</script>", f"<figure><svg><text>{say(2, 4)}</text></svg></figure>"]))
    nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>{say(1, 3)}</a>{end('</li>')}" for i in range(5)) + "</ul></nav>"
    notes = f'<section id="comments"><h3>{say(1, 3)}</h3><article class="comment"><p>{say(10, 40)}</article></section>'
    page = f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><style>p {{}}</style></head><body><header><h1>{say(1, 4)}</h1></header>{nav}<article>{''.join(body)}</article><div id=sidebar><p>{say(10, 40)}</p></div>{notes}<footer>{say(4, 20)}</footer></body></html>"
    return page, "\n".join(main)


def test_html_against_pages_made_with_their_text():
    rng = np.random.default_rng(5)
    for _ in range(300):
        page, want = made_page(rng)
        assert htmltext.main_text(page) == want, page


def test_html_of_a_very_long_page():
    text = "It was the best of times and it was the worst of times."
    page = "<article>" + f"<p>{text} &amp;<p><a href=x>{text}</a>" * 20_000 + "</article>"
    assert htmltext.main_text(page) == "\n".join([f"{text} &", text] * 20_000)


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a", "x"), (None, None, "", "x")], "page_id bigint, url string, html string, text string")
    assert [r["n_chars"] for r in htmltext.extract(rows).orderBy("page_id", "n_chars").collect()] == [0, 0, 1]
    assert htmltext.extract(rows.limit(0)).count() == 0


def test_ordinal(spark, edge, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = ordinal.grades(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = ordinal.train(docs, labels.where(~held), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = ordinal.score(docs, model, 3).join(labels.where(held), "doc_id").collect()
    kept = {g: np.mean([r["kept"] for r in rows if r["grade"] == g]) for g in (0, 1, 2)}
    assert kept[0] < 0.2 and kept[2] > 0.97, kept
    assert ordinal.score(edge, model, 3).count() == len(ROWS)
    assert ordinal.train(docs, labels.limit(0), 3) is None
    assert not any(r["kept"] for r in ordinal.score(edge, None, 3).collect())
    assert ordinal.score(none, model, 3).count() == 0


def test_licenses(spark, edge, none):
    for s in licenses.SENTENCES.values():
        assert any(w in s.lower() for w in licenses.WORDS), s
    mit = "MIT License\n\n" + licenses.SENTENCES[13] + " " + licenses.SENTENCES[14]
    bsd = "\n".join(licenses.SENTENCES[i] for i in (40, 41, 42, 43))
    docs = spark.createDataFrame([(1, mit), (2, bsd), (3, None), (4, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs).collect()} == {1: "MIT", 2: "BSD-3-Clause", 3: "", 4: ""}
    assert licenses.scan(edge).where("licenses = 'MIT'").count() == 1 and licenses.scan(none).count() == 0


# Licences as they stand in files: wrapped, with quotation marks, notices between, and comment signs.
FILES = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 A. B.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n',
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2020, A. B.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n",
    "Apache-2.0": '/*\n * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an "AS IS" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n * See the License for the specific language governing permissions and\n * limitations under the License.\n */\nint main;',
    "GPL-3.0-or-later": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n# GNU General Public License for more details.\n#\n# You should have received a copy of the GNU General Public License\n# along with this program.  If not, see <https://www.gnu.org/licenses/>.\n",
    "LGPL-2.1-or-later": "// This library is free software; you can redistribute it and/or\n// modify it under the terms of the GNU Lesser General Public\n// License as published by the Free Software Foundation; either\n// version 2.1 of the License, or (at your option) any later version.\n",
    "ISC": 'ISC License\n\nCopyright (c) 2020, A. B.\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS.',
    "MPL-2.0": "<!-- This Source Code Form is subject to the terms of the Mozilla Public\n   - License, v. 2.0. If a copy of the MPL was not distributed with this\n   - file, You can obtain one at https://mozilla.org/MPL/2.0/. -->\n",
    "EPL-2.0": "// SPDX-License-Identifier: EPL-2.0\npackage a;",
    "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007",
    "CC-BY-NC-ND-3.0": "This work is licensed under a Creative Commons\nAttribution-NonCommercial-NoDerivatives 3.0 Unported License.",
}


def test_licenses_in_files_and_by_sql(spark, tmp_path):
    names = list(FILES)
    rows = [(i, FILES[x]) for i, x in enumerate(names)] + [(50, "Apache License, v. 2.0 and v.\n3"), (51, FILES["MIT"] + FILES["Apache-2.0"]), (52, "all rights\r\nreserved"), (53, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in queries.op10_license_scan(spark, str(tmp_path)).collect()}
    assert {i: got[i][3] for i in range(len(names))} == dict(enumerate(names))
    assert got[51][3] == "Apache-2.0,MIT"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r for r in con.sql(queries.oracle_sql()["op10_license_scan"]).fetchall()} == got


def test_licenses_wrapped(spark):
    known = {licenses.plain(s): str(i) for i, s in licenses.SENTENCES.items()}  # 21 and 24 differ in a sign only
    one = lambda i: known[licenses.plain(licenses.SENTENCES[i])]
    whole = [(i, s, one(i), None) for i, s in licenses.SENTENCES.items()]
    rules = [(1000 + k, "\n\n".join(licenses.SENTENCES[i] for i in ids), ",".join(map(one, ids)), name) for k, (ids, name) in enumerate(licenses.RULES)]
    rows = whole + rules
    wrap = lambda t, w: "\n\n".join("\n".join(textwrap.wrap(p, w, break_long_words=False)) for p in t.split("\n\n"))
    for width in (10**6, 72, 40):
        docs = spark.createDataFrame([(i, wrap(t, width)) for i, t, *_ in rows], "doc_id bigint, text string")
        got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
        for i, _, ids, name in rows:
            assert got[i]["sentence_ids"] == ids and (name is None or got[i]["licenses"] == name), (width, i)
    apart = spark.createDataFrame([(1, "All\n\nrights reserved."), (2, "All. rights reserved."), (3, "MIT License\nall of it"), (4, "# All rights\r\n# reserved.\r\n")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(apart).collect()} == {1: "", 2: "", 3: "12", 4: "50"}


def test_pipeline_stages(spark, edge, none):
    docs = edge.drop("h1", "rank")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, none, SF).count() == 0
    near = corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()
    assert {r[0] for r in near} == {1, 4, 5, 6, 7, 8, 9, 10, 11, None}


def test_pipeline_run_by_brute_force(spark):
    """Each stage on what the one before kept; the rows of run() are the pieces of what is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rejected = {r["doc_id"] for r in langid.identify(langid.of_documents(docs), ["doc_id"]).where("rejected").collect()}
    texts = {i: t for i, t in texts.items() if i not in rejected}
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == texts.keys()
    lines = {}
    rows = sorted(texts.items())
    seen = set()  # windows of three lines that stand earlier
    for i, t in rows:
        all_of = (t or "").split("\n")
        at = [n for n, x in enumerate(all_of) if x.strip(linededup.BLANKS)]
        gone = set()
        for a, b, c in zip(at, at[1:], at[2:]):
            window = tuple(all_of[n].strip(linededup.BLANKS) for n in (a, b, c))
            gone |= set(range(a, c + 1)) if window in seen else set()
            seen.add(window)
        left = "\n".join(x for n, x in enumerate(all_of) if n not in gone)
        if not gone or WORD.search(left):
            lines[i] = left
    classes = brute_classes(list(lines.items()))
    lines = {i: t for i, t in lines.items() if classes[i] == i}
    bench = {r["item_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaked = set()
    for i, t in lines.items():
        words = re.findall(r"[^\W_]+", t.lower())
        grams = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        if any(any(tuple(x[k : k + 3]) in grams for k in range(len(x) - 2)) and smith_waterman(x, words) >= 0.5 for x in bench.values()):
            leaked.add(i)
    lines = {i: t for i, t in lines.items() if i not in leaked}
    assert leaked and len(lines) < len(classes)
    packed = corpus_pipeline.run(spark, SF).collect()
    left = spark.createDataFrame(list(lines.items()), "doc_id bigint, text string")
    want = packing.pieces(left, vocabulary("word_bpe_49k.json")).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(map(tuple, want))
    fill = collections.Counter()
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096
