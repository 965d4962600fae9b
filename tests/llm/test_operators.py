"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat_rotation, dart_minhash, decontaminate, deleted_interpolation, exact_dedup, lang_id, line_dedup, pieces, queries, token_counts, url_filter
from scriptorium.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
R = random.Random(11)
WORDS = ["the", "of", "Éa", "ch", "und", "x1", "THE", "la,", "é", "über", "中文", "a"]
CLASH = ("row", "pos", "line", "key", "k1", "k2", "n", "id", "fold", "batch", "huge", "words", "label", "score", "lang_pred", "ids", "kept", "part", "chunk", "edits", "speaker", "host")


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def prose(n):
    return " ".join(R.choice(WORDS) + (R.choice("abcdefgh") * R.randrange(3)) for _ in range(n))


BASE = prose(300)
TEXTS = [None, "", "   \n\t", "one", "One", "o n e", BASE, BASE, BASE + " ", BASE.replace(" ", "\n"), BASE[:-9] + "zz", prose(5000), "a\nb\n\nB \n b", "\n" * 7, "中文 é", "12345", "😀 x", "x" * 50_000]
TEXTS += [BASE.replace("the", "thee", 1), *(f"header\nline {i}\n  FOOTER " for i in range(12)), prose(13), prose(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "src", None) for i, t in enumerate(TEXTS)]
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert Counter(rows(got.select(*columns))) == Counter(want.fetchall()), name


# Exact dedup


def exact_brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[strip(t)].append((-len(t or ""), i))
    out = []
    for i, t in pairs:
        g = groups[strip(t)]
        out.append((i, min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "huge", "limit"), [(1 << 16, 8 << 20, 1000), (64, 8 << 20, 0), (256, 1000, 1000)])
def test_exact_dedup(docs, empty, chunk, huge, limit):
    got = exact_dedup.exact_dedup(docs, chunk, huge, limit).drop("n_points")
    assert sorted(rows(got)) == exact_brute(list(enumerate(TEXTS)))
    assert exact_dedup.exact_dedup(empty, chunk, huge, limit).count() == 0


def test_exact_dedup_repeats_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "c")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter({(1, 1, 3, True): 2, (None, 1, 3, False): 1, (2, 2, 1, True): 1})


def test_exact_dedup_survives_collisions(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BASES", (0, 0))
    exact_dedup.powers.cache_clear()
    same = docs.where(F.length("text") < 5).unionByName(docs.where(F.col("doc_id") == 5))
    pairs = [(r.doc_id, r.text) for r in same.collect()]
    forced = exact_dedup.fingerprints(same)
    assert forced.select("f1", "f2").distinct().count() <= forced.select("text_sha256").distinct().count()
    assert sorted(rows(exact_dedup.exact_dedup(same).drop("n_points"))) == exact_brute(pairs)
    exact_dedup.powers.cache_clear()


def test_unequal_keys_finds_a_collision(spark):
    texts = ["abcd", "abce", "wxyz", "w xyz"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    sha = [hashlib.sha256(strip(t).encode()).hexdigest() for t in texts]
    members = spark.createDataFrame([(sha[0], 4, 7, 7), (sha[1], 4, 7, 7), (sha[2], 4, 8, 8)], "text_sha256 string, n_bytes long, f1 long, f2 long")
    assert rows(exact_dedup.unequal_keys(df, members, chunk_bytes=3)) == [(4, 7, 7)]


def test_exact_dedup_of_string_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy"), (None, "z"), ("c", "z z")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [("None", None, True), ("a", "b", False), ("b", "b", True), ("c", "c", True)]


def test_fingerprints_compose():
    data = prose(3000).encode()
    assert len({exact_dedup.fingerprint(data, c) for c in (7, 100, 1 << 16)}) == 1


# Lines


def line_brute(pairs, least):
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    seen = Counter(k for _, t in pairs for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1000, 0])
def test_line_dedup(docs, empty, limit):
    for least in (2, 10):
        got = line_dedup.drop_frequent_lines(docs, least, batches=5, fanout=2, broadcast_rows=limit)
        assert sorted(rows(got)) == line_brute(list(enumerate(TEXTS)), least)
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def test_line_dedup_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x\ny"), (1, "x\nz"), (None, None)], "doc_id long, text string")
    got = {r.kept_text: r for r in line_dedup.drop_frequent_lines(df, 2).collect()}
    assert set(got) == {"y", "z", ""} and got["y"].n_dropped == 1 and got[""].n_lines == 1


def test_line_runs_incremental(spark, docs):
    runs, seen = line_dedup.LineRuns(spark, fanout=2), set()
    for b in range(4):
        batch = docs.where(F.col("doc_id") % 4 == b)
        new = {tuple(r) for r in line_dedup.first_seen(runs, batch).collect()}
        mine = {tuple(r) for r in line_dedup.key_counts(batch).select("h1", "h2").collect()}
        assert new == mine - seen
        seen |= mine
    assert len(runs.runs()) == 1 and {tuple(r) for r in runs.frequent(1).collect()} == seen
    runs.close()
    assert runs.runs() == [] and runs.frequent(1).collect() == []  # no batch, no hashes


def test_line_runs_stay_where_they_lie(spark):
    """A batch is dealt once; runs are neither dealt nor sorted again; runs that were compacted are deleted."""
    hashed = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n_docs"))
    runs = line_dedup.LineRuns(spark, fanout=4)
    for a in (0, 500, 1000):
        assert runs.add(hashed(a, a + 1000)).count() == (1000 if a == 0 else 500)
    with line_dedup.sorted_buckets(spark):
        again = runs.unseen(hashed(1900, 2100).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))
        again.collect()
        plan = again._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"\bExchange ", final)) == 1 and final.count("Scan parquet") == 3, plan
    assert len(re.findall(r"\bSort \[", final)) == 1, plan  # the batch's
    assert again.count() == 100
    held = [f for r in runs.runs() for f in spark.table(r).inputFiles()]
    assert runs.add(hashed(1900, 2100)).count() == 100
    assert len(runs.runs()) == 1 and spark.table(runs.runs()[0]).count() == 2100
    assert not any(os.path.exists(f.split("://")[-1].replace("file:", "")) for f in held)
    assert runs.frequent(2).count() == 1100
    runs.close()


# URLs


def test_url_filter(spark, empty):
    urls = [None, "", "no scheme", "http://a.net", "http://A.Example.NET/en/x", "http://example.net/en", "x://example.com/de/?q", "http://example.com/dex/", "http://notexample.com/de/", "http://b.org/fr/1#f", "http://org/fr/", "http://x.net?y=/en/", "http://u.net/a://b.org/fr/", "http://net/"]
    df = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    rules = queries.RULES

    def brute(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    want = sorted((i, *brute(u)) for i, u in enumerate(urls))
    assert sorted(rows(url_filter.filter_urls(df, rules))) == want
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    assert sorted(rows(url_filter.rules_table(df, table))) == want
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0
    assert url_filter.match(url_filter.build([url_filter.Rule("block", "a.b", "/x"), url_filter.Rule("allow", "b", "/xy/")]), "q.a.b", "/xy/z").host == "a.b"
    with pytest.raises(ValueError, match="at most"):
        url_filter.filter_urls(df, rules, max_rules=3)


def test_url_filter_of_long_paths():
    """One long segment takes no longer than its length tells."""
    trie = url_filter.build([url_filter.Rule("block", "net", "/en"), url_filter.Rule("allow", "net", "/en/x"), url_filter.Rule("block", "", "/very/")])
    long = "y" * 2_000_000
    for path, want in ((f"/en{long}", "/en"), (f"/en/x{long}", "/en/x"), (f"/{long}", None), (f"/{'a/' * 100_000}", None)):
        start = time.time()
        found = url_filter.match(trie, "a.net", path)
        assert (found and found.path) == want and time.time() - start < 1


# Language


def test_lang_id(spark, docs, empty, real):
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = lang_id.train(real.where(~held))
    got = lang_id.identify(real.where(held).where(F.length("text") >= 40), model, F.col("lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    odd = {r.doc_id: r for r in lang_id.identify(docs, model).collect()}
    for i, t in enumerate(TEXTS):
        assert (odd[i].lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= odd[i].score <= 1
    assert lang_id.identify(empty, model).count() == 0
    none = lang_id.train(empty)
    assert {(r.lang_pred, r.score) for r in lang_id.identify(docs, none).collect()} == {("und", 0.0)}


def lang_brute(train, texts, buckets, alpha=0.5):
    """Naive Bayes written out with dictionaries: (language, posterior) of each text."""
    word = (1 << 64) - 1

    def found(text):
        padded = f" {text.lower()}   "
        for i in range(len(padded) - 2):
            h = 0
            for n in range(3):
                h = (h + ord(padded[i + n]) + n + 1) * 0x9E3779B97F4A7C15 & word
                yield ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & word) >> (64 - buckets.bit_length() + 1)

    counts, docs = defaultdict(Counter), Counter(lang for _, lang in train if lang is not None)
    for text, lang in train:
        if lang is not None:
            counts[lang].update(found(text or ""))
    out = []
    for text in texts:
        if not any(map(str.isalpha, text or "")):
            out.append(("und", 0.0))
            continue
        logs = {x: math.log(docs[x] / docs.total()) for x in sorted(docs)}
        for g in found(text):
            for x in logs:
                logs[x] += math.log((counts[x][g] + alpha) / (counts[x].total() + alpha * buckets))
        best = max(logs, key=logs.get)  # of equal ones the first
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_lang_id_against_brute_force(spark, docs, real):
    pairs = [(r.text, r.lang) for r in docs.collect()] + [(r.text, r.lang) for r in real.where("doc_id % 9 = 0").collect()]
    texts = [t for t, _ in pairs if len(t or "") < 3000] + ["a", "été", "the the", "the the"]
    model = lang_id.train(spark.createDataFrame(pairs, "text string, lang string"), max_cells=1 << 12)
    want = lang_brute(pairs, texts, len(model.log_probs))
    asked = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(asked, model).collect()}
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and abs(got[i][1] - score) < 2e-3, texts[i]


def test_lang_id_ties_and_repeated_rows(spark):
    """Languages with the same counts tie, and the first by name wins; repeated and null ids each give a row."""
    train = spark.createDataFrame([("same text", "b"), ("same text", "a"), ("same text", "c"), ("other", None)], "text string, lang string")
    asked = spark.createDataFrame([(1, "same"), (1, "same"), (None, "zzz"), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in lang_id.identify(asked, lang_id.train(train)).collect())
    assert got == Counter({(1, "a", 0.333333): 2, (None, "a", 0.333333): 1, (None, "und", 0.0): 1})


def test_lang_id_counts_whole_texts_in_pieces():
    text = prose(400)
    whole = Counter(g for p, s, _ in lang_id.blocks([text]) for g in lang_id.grams(p, s, 1 << 12).ravel().tolist())
    cut = Counter(g for p, s, _ in lang_id.blocks([text], 50) for g in lang_id.grams(p, s, 1 << 12).ravel().tolist())
    padded = f" {text.lower()}   "
    assert whole == cut and sum(whole.values()) == 3 * (len(padded) - 2)


# Decontamination


@pytest.mark.parametrize("limit", [1000, 0])
def test_decontamination(spark, docs, empty, limit):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(BASE))
    items = [(1, " ".join(words[20:60])), (2, " ".join(words[50:70])), (10, "one"), (11, ""), (12, None), (13, "header line 3 footer"), (13, "header line 3 footer"), (14, " ".join(words[20:33]))]
    bench = clash(spark.createDataFrame(items, "item_id long, text string"))
    got = decontaminate.contamination(docs, bench, broadcast_windows=limit)
    want = []
    wins = {(str(i), tuple(w[k : k + 13])) for i, t in items if (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for k in range(max(1, len(w) - 12))}
    for i, t in enumerate(TEXTS):
        ws, hit, ids = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)), set(), set()
        for item, w in wins:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    ids.add(item)
        want.append((i, len(ws), len(hit), len(ids), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    assert sorted(rows(got)) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.n_hit for r in decontaminate.contamination(docs, bench.where("false")).collect())


def test_decontamination_repeated_rows(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (1, "gamma"), (None, "beta alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    got = Counter((r.doc_id, r.n_hit) for r in decontaminate.contamination(df, bench).collect())
    assert got == Counter({(1, 2): 2, (1, 0): 1, (None, 2): 1})


# Near duplicates


def near_brute(pairs, threshold=0.8):
    sets, groups = {}, {}
    for i, t in pairs:
        w = lower(t).encode().split()
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or Counter([tuple(w)] if w else [])
    find = lambda x: x if groups.setdefault(x, x) == x else find(groups[x])
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b:
                shared = sum((a & b).values())
                if shared >= threshold * (a.total() + b.total() - shared):
                    x, y = sorted((find(i), find(j)))
                    groups[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("limit", [1000, 0])
def test_near_classes(docs, empty, real, limit):
    small = real.select("doc_id", "text").limit(10_000)
    for df in (docs, small):
        want = near_brute([(r.doc_id, r.text) for r in df.collect()])
        got = dart_minhash.near_classes(df, broadcast_rows=limit).collect()
        assert {r.doc_id: r.class_id for r in got} == want
        assert all(r.class_size == list(want.values()).count(r.class_id) for r in got)
    assert dart_minhash.near_classes(empty).count() == 0


def test_near_chain_through_a_pivot(spark):
    """A chain of texts in which far ends aren't similar is one class."""
    words = [f"w{i}" for i in range(160)]
    chain = [" ".join(words[k : k + 100]) for k in range(0, 60, 5)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.class_id for r in dart_minhash.near_classes(df).collect()} == {0}


def test_darts_estimate_weighted_similarity():
    a, b = prose(400), prose(400)
    texts = pa.array([a + " " + b, a, a + " " + a, ""])
    of, e, w = dart_minhash.shingles(texts)
    sig = dart_minhash.signatures(of, e, w, 4)
    assert (sig[3] == dart_minhash.NONE).all()
    counts = [Counter(dict(zip(e[of == i].tolist(), w[of == i].tolist(), strict=True))) for i in range(3)]
    for i, j in ((0, 1), (1, 2), (0, 2)):
        shared = (counts[i] & counts[j]).total()
        true = shared / (counts[i].total() + counts[j].total() - shared)
        assert abs((sig[i] == sig[j]).mean() - true) < 4 * math.sqrt(0.25 / dart_minhash.K)


def test_near_centres_in_one_bucket(spark):
    """Texts of several sizes around several centres, none of which is alike the first pivot's, lose no link."""
    r = random.Random(8)
    core = [f"w{i}" for i in range(120)]
    texts = []
    for c in range(6):
        centre = [*core[: 104 - c], *(f"c{c}_{i}" for i in range(16 + c))]
        texts += [" ".join([*centre[:-k], *(f"r{r.randrange(10**6)}" for _ in range(k))]) for k in range(1, 6)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = near_brute([*enumerate(texts)])
    assert 1 < len(set(want.values())) < len(texts)
    assert {x.doc_id: x.class_id for x in dart_minhash.near_classes(df).collect()} == want


def test_near_classes_of_odd_ids(spark):
    rows_in = [("b", BASE), ("a", BASE + " end"), ("a", BASE + " end"), (None, BASE), ("z", "x"), ("y", None)]
    got = Counter(rows(dart_minhash.near_classes(spark.createDataFrame(rows_in, "doc_id string, text string")).drop("class_key")))
    assert got == Counter({("a", "a", 3): 2, ("b", "a", 3): 1, (None, None, 1): 1, ("z", "z", 1): 1, ("y", "y", 1): 1})


def test_near_unlike_texts_of_one_id(spark):
    """A document that stands for two texts doesn't join what is like the one with what is like the other."""
    a, b = prose(80), prose(80)
    got = dart_minhash.near_classes(spark.createDataFrame([(1, a), (1, b), (2, b), (3, a + " end"), (4, b + " x")], "doc_id long, text string")).collect()
    keys = {(r.doc_id, r.class_key) for r in got}
    assert len({k for i, k in keys if i == 1}) == 2 and {k for i, k in keys if i in (2, 4)}.isdisjoint(k for i, k in keys if i == 3)
    assert sorted(r.class_size for r in got) == [2, 2, 3, 3, 3] and {r.class_id for r in got} == {1}


def test_near_texts_just_below_the_threshold(spark, monkeypatch):
    """Texts that nearly link one another but don't are not compared in pairs; the few that do link are found."""
    r, sizes = random.Random(3), {}
    common = [f"w{i}" for i in range(130)]

    def text():
        own = iter(f"z{r.randrange(10**9)}" for _ in range(20))
        return " ".join([*common[:60], *(next(own) for _ in range(10)), *common[60:], *(next(own) for _ in range(10))])

    compared = dart_minhash.compared
    monkeypatch.setattr(dart_minhash, "compared", lambda pairs, *a: (sizes.setdefault(n, []).append(pairs.count()), compared(pairs, *a))[1])
    for n in (300, 1200):
        texts = [text() for _ in range(n)]
        texts += [t + " tail" for t in texts[:5]]
        got = {x.doc_id: x.class_id for x in dart_minhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == {**{i: i for i in range(n)}, **{n + i: i for i in range(5)}}
        assert near_brute(list(enumerate(texts[:40]))) == {i: i for i in range(40)}
    assert sum(sizes[1200]) < 6 * sum(sizes[300]), sizes  # all pairs would be 16 times as many


def test_components_says_when_it_stops_early(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        dart_minhash.components(df, rounds=1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(120, 39)] + [(200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.label for r in dart_minhash.components(df).collect()}
    assert got == {**{i: 0 for i in [*range(41), *range(100, 140)]}, 200: 200, 201: 200}


def test_components_write_no_more_than_they_must(spark, monkeypatch):
    """Stars are done as they are given, and links that add nothing are not gone over again; each round deals few rows many times."""
    written, table = [], dart_minhash.table
    monkeypatch.setattr(dart_minhash, "table", lambda df, name, *by: (written.append(name), table(df, name, *by))[1])
    stars = spark.createDataFrame([(0, i) for i in range(1, 20)] + [(30, 31), (31, 30), (7, 7)], "a long, b long")
    assert {r.id: r.label for r in dart_minhash.components(stars).collect()} == {**dict.fromkeys(range(20), 0), 30: 30, 31: 30}
    assert written == ["stars"]
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    least = list(range(300))
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.label for r in dart_minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: least[x] for a, b in edges if a != b for x in (a, b)}
    written.clear()
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{text} {i}") for i in range(4)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dart_minhash.near_classes(docs).collect()} == dict.fromkeys(range(4), 0)
    assert written.count("stars") <= 3


# Language model


def test_deleted_interpolation(spark, docs, empty):
    def brute(pairs):
        train = [t for i, t in pairs if zlib.crc32(str(i).encode()) % 7 != 2]
        tokens = lambda t: [*(lower(t).encode().split()), None]
        counts = Counter(w for t in train for w in tokens(t))
        n, v = counts.total(), len(counts)
        return {i: (zlib.crc32(str(i).encode()) % 7 == 2, len(ws := tokens(t)), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, t in pairs}

    pairs = list(enumerate(TEXTS))
    held = crc_mod(F.col("doc_id"), 7) == 2
    for order in (1, 2, 3):
        got = {r.doc_id: r for r in deleted_interpolation.score(docs, ~held, order=order).collect()}
        for i, (_, n, known, total, base) in brute(pairs).items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and abs(r.base_score - base) < 1e-6 and -1e9 < r.score <= 0
    assert deleted_interpolation.score(empty, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 and r.score == 0 for r in deleted_interpolation.score(docs, F.lit(False)).collect())


def test_deleted_interpolation_formula_and_gain(spark, real, monkeypatch):
    """Scores follow the mixture from the learned weights, computed here by dictionaries; held-out texts gain by it."""
    learned = []
    learn = deleted_interpolation.learn
    monkeypatch.setattr(deleted_interpolation, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    held = crc_mod(F.col("doc_id"), 7) == 2
    got = deleted_interpolation.score(real, ~held).withColumn("held", held).collect()
    texts = {r.doc_id: r.text for r in real.collect()}
    one, two, before = Counter(), Counter(), Counter()
    for r in got:
        if not r.held:
            w = [0, *lower(texts[r.doc_id]).encode().split(), None]
            one.update(w[1:])
            before.update(w[:-1])
            two.update(zip(w, w[1:], strict=False))
    n, v, weights = one.total(), len(one), learned[0]
    for r in got[:40]:
        w = [0, *lower(texts[r.doc_id]).encode().split(), None]
        total = 0
        for h, x in zip(w, w[1:], strict=False):
            low = weights[0][0] * one[x] / n + (1 - weights[0][0]) / (v + 1)
            b = min(deleted_interpolation.BUCKETS - 1, math.ceil(math.log2(before[h] + 1)))
            total += math.log10(weights[1][b] * two[h, x] / max(1, before[h]) + (1 - weights[1][b]) * low)
        assert abs(total - r.score) < 1e-6 * max(1, abs(total))
    out = [r for r in got if r.held]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def probabilities(df, training, texts, order):
    """10 to the power of the score of each held-out text."""
    more = df.sparkSession.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], df.schema)
    got = {r.doc_id: 10**r.score for r in deleted_interpolation.score(df.unionByName(more), training & (F.col("doc_id") < 1000), order=order).collect()}
    return [got[1000 + i] for i in range(len(texts))]


def test_deleted_interpolation_is_a_distribution(spark, monkeypatch):
    """Texts score as the product of probabilities that, after any word, add up to one over all words, the end and an unknown word."""
    train = ["a b", "a c", "b a", "a", "c c a", "b b c a", "", "a a", "c", "b"] * 3
    words = ["a", "b", "c", "zz"]
    texts = ["", *words, *(f"{h} {x}" for h in words for x in words)]
    df = spark.createDataFrame([*enumerate(train), *((1000 + i, t) for i, t in enumerate(texts))], "doc_id long, text string")
    for order in (1, 2):
        learned = []
        learn = deleted_interpolation.learn
        monkeypatch.setattr(deleted_interpolation, "learn", lambda *a, f=learn, to=learned: to.append(f(*a)) or to[-1])
        got = {r.doc_id: r.score for r in deleted_interpolation.score(df, F.col("doc_id") < 1000, order=order).collect()}
        one, two, before = Counter(), Counter(), Counter()
        for t in train:
            w = ["<", *t.split(), ">"]
            one.update(w[1:])
            before.update(w[:-1])
            two.update(zip(w, w[1:], strict=False))

        def p(h, x, weights=learned[0], order=order, counts=(one, two, before)):
            one, two, before = counts
            low = weights[0][0] * one[x] / one.total() + (1 - weights[0][0]) / (len(one) + 1)
            w = weights[1][math.ceil(math.log2(before[h] + 1))] if order == 2 else 0
            return w * two[h, x] / max(1, before[h]) + (1 - w) * low

        for h in ["<", *words]:
            assert abs(sum(p(h, x) for x in [*words, ">"]) - 1) < 1e-9  # zz is the unknown word
        for i, t in enumerate(texts):
            w = ["<", *t.split(), ">"]
            assert abs(got[1000 + i] - sum(math.log10(p(h, x)) for h, x in zip(w, w[1:], strict=False))) < 1e-6
        monkeypatch.setattr(deleted_interpolation, "learn", learn)


def em_brute(pairs, held, rounds=12):
    """Bigram weights by expectation-maximisation with dictionaries: (unigram weight, weight of each bucket of contexts)."""
    kept = [t for i, t in pairs if not held[i]]
    out = [t for i, t in pairs if held[i]]
    padded = lambda t: [0, *lower(t).encode().split(), None]
    one, two, before = Counter(), Counter(), Counter()
    for t in kept:
        w = padded(t)
        one.update(w[1:])
        before.update(w[:-1])
        two.update(zip(w, w[1:], strict=False))
    every = {w for _, t in pairs for w in padded(t)[1:]}
    n, floor = one.total(), 1 / (len(every) + 1)
    bucket = lambda h: min(deleted_interpolation.BUCKETS - 1, math.ceil(math.log2(before[h] + 1)))
    tokens = [(one[x] / n, two[h, x] / max(1, before[h]), bucket(h)) for t in out for h, x in zip(padded(t), padded(t)[1:], strict=False)]
    low, high = 0.5, defaultdict(lambda: 0.5, {0: 0.0})
    for _ in range(rounds):
        got, of, got1, of1 = Counter(), Counter(), 0.0, 0.0
        for f1, f2, b in tokens:
            p1 = low * f1 + (1 - low) * floor
            p2 = high[b] * f2 + (1 - high[b]) * p1
            post = high[b] * f2 / p2
            got[b] += post
            of[b] += 1
            got1 += (1 - post) * low * f1 / p1
            of1 += 1 - post
        new = {b: min(got[b] / of[b], 1 - 1e-6) for b in of}
        moved = max(abs(got1 / of1 - low), *(abs(new[b] - high[b]) for b in new))
        low = min(got1 / of1, 1 - 1e-6)
        high.update(new)
        if moved < 1e-3:
            break
    return low, high, n, one, two, before, floor


def test_deleted_interpolation_learns_by_em(spark, monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choices(["a", "b", "c", "d", f"x{r.randrange(40)}"], [9, 5, 3, 1, 2], k=r.randrange(1, 30))) for _ in range(120)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    held = {x.doc_id: x.h for x in df.select("doc_id", (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(10)) == 0).alias("h")).collect()}
    assert 3 < sum(held.values()) < 30
    low, high, *_ = em_brute(list(enumerate(texts)), held)
    learned = []
    learn = deleted_interpolation.learn
    monkeypatch.setattr(deleted_interpolation, "learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    deleted_interpolation.score(df, F.lit(True), order=2).collect()
    assert abs(learned[0][0][0] - low) < 1e-4
    assert all(abs(learned[0][1][b] - w) < 1e-4 for b, w in high.items())


def test_deleted_interpolation_over_levels(spark, docs, monkeypatch):
    """Many small chunks through several levels of the exchange score as one chunk does; ids may be null, repeated and strings."""
    training = crc_mod(F.col("doc_id"), 7) != 2
    repeated = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").limit(5)).unionByName(spark.createDataFrame([(None, "one the"), (None, None)], "doc_id long, text string"))
    rounded = lambda df: Counter((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in df.collect())
    want = rounded(deleted_interpolation.score(repeated, training, order=3))
    monkeypatch.setattr(deleted_interpolation, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(deleted_interpolation, "SHARD_TOKENS", 500)
    assert rounded(deleted_interpolation.score(repeated.repartition(3), training, order=3, fan=4)) == want
    named = repeated.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert rounded(deleted_interpolation.score(named.repartition(2), training, order=3, fan=8)) == want
    made = deleted_interpolation.chunks(repeated.repartition(2), training)
    n = made.count()
    assert n > 5 and deleted_interpolation.requests(made, 2, 1, 3).count() <= n * 2 * 8


# Token counts


def test_token_counts(spark, docs, empty):
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read(), token_counts.PATTERN)
    edited = docs.withColumn("edits", token_counts.derived_edits(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    got = token_counts.apply_edits(token_counts.build(edited)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.n_tokens == len(enc.encoding.encode_ordinary(r.text)) and r.n_before == len(enc.encoding.encode_ordinary(TEXTS[r.doc_id] or ""))
        assert r.sizes == [len(p) for p in enc.pattern.findall(r.text)] and sum(r.counts) == r.n_tokens
    plain = token_counts.build(docs)
    assert {(r.n_edits, r.n_tokens - r.n_before) for r in token_counts.apply_edits(plain).collect()} == {(0, 0)}
    log = spark.createDataFrame([(6, 2, 0, 3, "new "), (6, 1, 5, 0, "first "), (6, 3, 10**6, 9, None), (0, 1, 0, 0, "x y")], "doc_id long, seq int, at int, removed int, added string")
    after = {r.doc_id: r for r in token_counts.apply_edits(token_counts.with_edits(plain, log)).collect()}
    want = BASE[:5] + "first " + BASE[5:]
    assert after[6].text == "new " + want[3:] and after[0].text == "x y" and after[6].n_tokens == len(enc.encoding.encode_ordinary(after[6].text))
    assert token_counts.apply_edits(token_counts.build(empty)).count() == 0


def test_token_counts_of_odd_rows(spark):
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read(), token_counts.PATTERN)
    long = prose(40_000)
    df = spark.createDataFrame([("a", long), ("a", long), (None, "x y"), ("b", None)], "doc_id string, text string")
    edits = F.when(F.length("text") > 10, token_counts.derived_edits(F.coalesce("doc_id", F.lit("")), F.col("text")))
    got = token_counts.apply_edits(token_counts.build(df.withColumn("edits", edits))).collect()
    assert Counter(r.doc_id for r in got) == Counter({"a": 2, None: 1, "b": 1})
    for r in got:
        assert r.n_tokens == len(enc.encoding.encode_ordinary(r.text)) and r.n_encoded < 200
    assert len({(r.doc_id, r.text) for r in got}) == 3


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, " \t\n" * 300_000 + "end", "x" * 300_000, "a " * 200_000], ids=["spaces", "lines", "mixed", "letters", "words"])
def test_token_counts_of_long_runs(spark, text):
    state = token_counts.build(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").withColumn("edits", token_counts.derived_edits(F.col("doc_id"), F.coalesce("text", F.lit("")))))
    first = state.where("doc_id = 1").first()
    assert sum(first.sizes) == len(text) and sum(first.counts) == first.n_tokens > 0
    whole = {r.doc_id: r.n_tokens for r in token_counts.build(token_counts.apply_edits(state).select("doc_id", "text")).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.apply_edits(state).collect()} == whole


def test_counts_of_pre_tokens_are_the_encoders():
    """What stands as one pre-token encodes alone as the whole encoder does."""
    encode = token_counts.encoder(open(token_counts.RANKS, "rb").read(), token_counts.PATTERN)
    for text in [t for t in TEXTS if t] + [" " * 3000 + "a", "a   \n\n  b's"]:
        pieces = encode.pattern.findall(text)
        assert sum(encode.counts(pieces)) == len(encode.encoding.encode_ordinary(text))


def test_edits_reencode_locally():
    enc = token_counts.encoder(open(token_counts.RANKS, "rb").read(), token_counts.PATTERN)
    junk = ["", "a", " ", "  ", "'s", "'", "\n", "1", "don't", "x y z", " \n ", "é", "!!"]
    text = prose(2000)
    p = enc.pattern.findall(text)
    tree, most = token_counts.grow([len(x) for x in p], enc.counts(p)), 0
    for _ in range(300):
        at, cut, add = R.randrange(len(text) + 1), R.choice([0, 0, 1, 2, 7, 400]), R.choice(junk)
        want = text[:at] + add + text[at + cut :]
        tree, text, k = token_counts.edit(tree, text, at, cut, add, enc)
        most = max(most, k)
        p = enc.pattern.findall(want)
        assert text == want and token_counts.flat(tree) == ([len(x) for x in p], enc.counts(p)) and (tree.chars[1], tree.tokens[1]) == (len(want), sum(enc.counts(p)))
    assert most < 20


# Pieces


ODD = ["a  b ", " ", "   ", "  x   y  ", "▁a ▁▁", "a▁b", "é😀 \x00 中", "\t \n a", "z" * 3000 + "  " * 40 + "end"]


def test_pieces(spark, docs, empty, real):
    """The ids of the rebuilt tokenizer against those of the sentencepiece library, which the operator uses for parity alone."""
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = spark.createDataFrame([*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")], "doc_id long, text string")
    for df in (docs, real, odd):
        got = pieces.encode(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert r.ids == plain.encode(r.text or "") and r.n_ids == len(r.ids) and r.round_trip and r.parity
    back = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encode(empty).count() == 0


def test_pieces_returns_the_tokenizers_ids(monkeypatch):
    """A sentencepiece library that disagrees changes parity, never the ids."""
    data = open(pieces.MODEL, "rb").read()
    spec, fast, plain, _ = pieces.loaded(data)

    class Other:
        def encode(self, texts, num_threads):
            return [[*ids, 7] if "wrong" in t else ids for t, ids in zip(texts, plain.encode(texts), strict=True)]

    texts = pa.array(["all right here", "some wrong word", ""])
    runs = pieces.Runs(spec, fast, Other())
    for by_run in (runs, None):
        monkeypatch.setattr(pieces, "loaded", lambda _, r=by_run: (spec, fast, Other(), r))
        got = pieces.encode_texts(texts, data, 1).to_pylist()
        assert [r["ids"] for r in got] == plain.encode(texts.to_pylist()) and [r["parity"] for r in got] == [True, False, True] and all(r["round_trip"] for r in got)


def test_pieces_forgets_runs(monkeypatch):
    data = open(pieces.MODEL, "rb").read()
    spec, fast, plain, _ = pieces.loaded(data)
    runs = pieces.Runs(spec, fast, plain)
    for limit in (6000, 0):
        monkeypatch.setattr(pieces, "CACHE_BYTES", limit)
        for _ in range(6):
            texts = [prose(60) for _ in range(3)] + ["the the"]
            ids, sizes, same, back = runs.encode(pa.array(texts), 1)
            assert ids.tolist() == [i for x in plain.encode(texts) for i in x] and sizes.tolist() == [len(x) for x in plain.encode(texts)] and same.all() and back.all()


def test_pieces_of_long_texts():
    data = open(pieces.MODEL, "rb").read()
    spec, _, plain, _ = pieces.loaded(data)
    text = "  " + "  ".join(prose(40) for _ in range(20)) + "   "
    parts = pieces.cut(text, spec, 100)
    assert len(parts) > 10 and " ".join(parts) == text
    assert [i for p in parts for i in plain.encode(p)] == plain.encode(text)


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_models_that_cannot_be_rebuilt_are_refused(spark, tmp_path, kind):
    """Plain trained models give sentencepiece's ids; those with user-defined pieces or white space as a suffix are an error, not wrong ids."""
    import sentencepiece

    lines = [prose(12) for _ in range(400)]
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines[:40])], "doc_id long, text string")
    for name, more in (("plain", {}), ("user", {"user_defined_symbols": ["the"]}), ("suffix", {"treat_whitespace_as_suffix": True})):
        sentencepiece.SentencePieceTrainer.train(input=str(tmp_path / "lines.txt"), model_prefix=str(tmp_path / name), model_type=kind, vocab_size=60, hard_vocab_limit=False, minloglevel=2, **more)
        if name == "plain":
            assert {r.parity for r in pieces.encode(df, str(tmp_path / "plain.model")).collect()} == {True}
        else:
            with pytest.raises(ValueError, match="not supported"):
                pieces.encode(df, str(tmp_path / f"{name}.model"))


def test_decode_of_odd_rows(spark):
    df = pieces.encode(spark.createDataFrame([(1, "One two"), (1, "One two"), (2, None), (3, "")], "doc_id long, text string"))
    assert sorted(rows(pieces.decode(df.withColumn("decoded", F.lit(9))).select("doc_id", "decoded"))) == [(1, "One two"), (1, "One two"), (2, ""), (3, "")]
    assert pieces.decode(df.where("false")).collect() == []
    assert pieces.decode(df.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))).first().decoded is None


def test_unigram_model_is_rebuilt():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{i:02X}>", 0, 6) for i in range(256)), ("▁", -2.0, 1), ("▁a", -2.5, 1), ("ab", -3.0, 1), ("a", -4.0, 1), ("b", -4.25, 1), ("abc", -3.5, 1), ("c", -5.0, 1)]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, True, 0
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", True
    data = model.SerializeToString()
    plain = sentencepiece.SentencePieceProcessor(model_proto=data)
    spec = pieces.parse(data)
    assert spec.kind == pieces.UNIGRAM and spec.byte_fallback and spec.squeeze
    texts = ["abc ab", "a  bé c ", "", "cab abc", "  "]
    assert [e.ids for e in pieces.build(spec).encode_batch(texts)] == plain.encode(texts)


# Chat


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "", "who?"), (1, 700, "ann", "bye"), (2, 0, "system", "alone"), (None, 3, "x", "y"), (None, 900, None, "z")]
    df = clash(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    for block in (1, 256):
        got = chat_rotation.rotate(df, block=block)
        seen = defaultdict(list)
        for r in got.collect():
            seen[r.conv_id, r.speaker].append(r)
        assert set(seen) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, None), (None, "x"), (None, "unknown")}
        texts, _ = chat_rotation.dialogues(got)
        whole = {(r.conv_id, r.speaker): r for r in texts.collect()}
        for key, segments in seen.items():
            segments.sort(key=lambda r: r.seq)
            text = "".join(r.segment for r in segments)
            assert [r.seq for r in segments] == list(range(len(segments))) and whole[key].dialogue == text
            for r in segments:
                assert text[r.char_start : r.char_end] == r.segment
                own = r.name == r.speaker
                assert (r.role == "assistant") == own and (text[r.train_start : r.train_end] == (r.segment.removeprefix("<|assistant|>\n") if own else ""))
        assert "".join(r.segment for r in seen[1, "ann"]).startswith("<|user|>\nunknown: who?<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\nbob: <|end|>\n")
        assert chat_rotation.dialogues(got, most_chars=1)[1].count() == got.count()
    assert chat_rotation.rotate(df.where("false")).count() == 0


# Pipeline


def test_pipeline_stages(spark, docs, real, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "pieces"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (real, docs, docs.where("false")):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
            if name != "pieces":
                assert out.columns == now.columns and set(after) <= set(before) and all(after[i] == before[i] for i in after)
            pairs = [(i, r.text) for i, r in before.items()]
            if name == "exact_dedup":
                assert set(after) == {x[0] for x in exact_brute(pairs) if x[3]}
            if name == "near_dedup":
                assert set(after) == {i for i, c in near_brute(pairs).items() if i == c}
            if name == "language_id":
                assert all(any(map(str.isalpha, r.text or "")) for r in after.values()) and len(after) >= (0.95 * len(before) if start is real else 0)
            if name == "decontamination":
                found = decontaminate.contamination(now, bench).where("contaminated")
                assert set(before) - set(after) == {r.doc_id for r in found.collect()}
            now = spark.createDataFrame(out.collect(), out.schema)
    assert json.dumps(sorted(now.columns))


def test_pipeline_rejects_what_is_in_no_language(spark, real):
    """Foreign scripts and noise go, whatever language they are nearest to; clean documents stay."""
    from scriptorium.llm import pipeline

    odd = ["这是中文文本内容测试一二三", "Съешь ещё этих мягких французских булок да выпей чаю", "xqzjkv wqxz zzkqj vvxq kjqz " * 5, "k3j4h5 QmFzZTY0IGVuY29kZWQgdGV4dA== 9x9X//+q " * 30, "x9 " * 10 + "\u4e2d" * 400, "1234 5678", "", None]
    made = real.unionByName(spark.createDataFrame([(-1 - i, t, None, "odd", 1) for i, t in enumerate(odd)], real.schema))
    kept = {r.doc_id for r in pipeline.language(spark, made, SF).collect()}
    assert not any(i < 0 for i in kept)
    assert kept == {r.doc_id for r in real.collect() if any(map(str.isalpha, r.text or ""))}


def test_pipeline_keys_are_unique_and_stay(spark, tmp_path):
    from scriptorium.llm import pipeline

    spark.range(5000).withColumn("path", F.lit("clash")).repartition(9).write.parquet(f"{tmp_path}/rows")
    keys = lambda: {(r[0], r[1]) for r in pipeline.keyed(spark.read.parquet(f"{tmp_path}/rows")).select("id", pipeline.KEY).collect()}
    assert keys() == keys() and len({k for _, k in keys()}) == 5000


@pytest.mark.parametrize("written", [False, True])
def test_pipeline_null_and_repeated_ids(spark, tmp_path, written):
    from scriptorium.llm import pipeline

    words = [f"w{i}" for i in range(60)]
    long, alike, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"v{i}" for i in range(40))
    pairs = [(None, "ab"), (2, "ab"), (5, "x y"), (5, "x y"), (5, "z"), (None, long), (7, alike), (None, other), (None, None), (8, other), (8, other)]
    spark.createDataFrame([("1", " ".join(words[:20]))], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    if written:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    got = lambda stage: Counter((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect())
    assert got(pipeline.exact) == Counter([(None, "ab"), (5, "x y"), (5, "z"), (None, long), (7, alike), (None, other), (None, None)])
    assert got(pipeline.near) == Counter([(None, "ab"), (5, "x y"), (5, "z"), (None, long), (None, other), (None, None)])
    assert got(pipeline.clean) == Counter(p for p in pairs if p[1] not in (long, alike))
