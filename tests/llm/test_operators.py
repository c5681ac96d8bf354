"""The operators over small tables: nulls, empty and repeated rows, ties, extra columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestra.llm import embed_dedup, html_text, minhash, packing, pii, quality, sentencepiece_unigram, topk, url_filter, warc
from attestra.llm.common import connected_components
from tests.llm.test_kernels import _sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, block int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in texts], DOCS)


def _roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 1), (2, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    expect = _roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in expect.items() if any(k in p and p[0] != p[1] for p in links)}
    assert connected_components(df.limit(0)).count() == 0


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCUMENTS", 7)
    monkeypatch.setattr(minhash, "BLOCK_POSTS", 5)
    monkeypatch.setattr(minhash, "SHORT_LIST", 4)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    bases = [[word() for _ in range(120)] for _ in range(3)]
    texts = []
    for k in range(60):
        w = list(bases[k % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = word()
        texts.append((k, " ".join(w)))
    texts += [(200, texts[3][1]), (201, texts[3][1].upper()), (202, None), (203, ""), (204, " "), (205, "one two"), (206, "One\ttwo"), (207, "long " * 30_000), (207, "long " * 30_000), (None, texts[3][1])]
    got = minhash.near_duplicates(_docs(spark, texts)).collect()
    assert len(got) == len(texts)
    sets = {i: _sets(t) for i, t in texts if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expect = _roots(ids, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (expect[r["doc_id"]], expect[r["doc_id"]] == r["doc_id"], len(sets[r["doc_id"]])), r
    assert minhash.near_duplicates(_docs(spark, [])).count() == 0


def test_recall_of_near_duplicates_against_all_rows(spark):
    """Documents whose id is divisible by 50 against all others, at 0.8 and 0.85."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    asked = {i: _sets(t) for i, t in rows if i % 50 == 0}
    where = {}
    for i, s in asked.items():
        for x in s:
            where.setdefault(x, []).append(i)
    sizes, shared = {}, {}
    for i, t in rows:
        found = _sets(t)
        sizes[i] = len(found)
        for x in found:
            for q in where.get(x, ()):
                if q != i:
                    shared[q, i] = shared.get((q, i), 0) + 1
    for percent in (80, 85):
        links = [(q, i) for (q, i), n in shared.items() if 100 * n >= percent * (sizes[q] + sizes[i] - n)]
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent).select("doc_id", "component_id").collect()}
        assert len(links) > 20 and all(got[q] == got[i] for q, i in links)


def test_near_duplicate_rows_are_dropped_by_row(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(5))
    # repeated rows, copies without an id, and ids with a second text that has copies elsewhere or none
    texts = [(1, a), (1, a), (1, a + " end"), (None, a), (None, b), (None, b), (2, c), (2, d), (3, d), (3, e), (4, None), (4, None), (0, c)]
    got = [(r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(_docs(spark, texts)).collect()]
    assert sum(i == 1 for i, _ in got) == 1
    assert sorted((x for x in got if x[0] != 1), key=str) == sorted([(0, c), (2, d), (3, e), (None, b), (4, None), (4, None)], key=str)


def test_packed_documents(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choices(["alpha", "Beta!", "γ", "12"], k=rng.randint(0, 60)))) for k in range(80)] + [(90, None), (91, ""), (92, "word " * 300), (3, "again"), (None, "x")]
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.packed_documents(_docs(spark, texts), path, capacity=64).collect()
    own = Tokenizer.from_file(path)
    expect = []
    for i, t in texts:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        expect += [(i, k, s, len(p := ids[s : s + 64]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(expect, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.packed_documents(_docs(spark, []), path).count() == 0


def test_archive_round_trip(spark):
    big, same = "é<p>" * 20_000, "z" * 1500
    pages = [(1, "http://a", big), (2, "u\r\nX: y", same), (3, None, same), (4, "u", same), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (4, "u", same), (None, "u", same)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["problem"]) for r in warc.round_trip(df, 4096).collect()), key=str)
    expect = []
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = i in (2, 3)
        expect.append((i or 0, "revisit" if revisit else "response", 4 if revisit else None, len(raw), hashlib.sha1(raw).hexdigest(), None))
    assert got == sorted(expect, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_keys_of_64_bits(spark, tmp_path):
    same, ids = "z" * 1500, (10**18, 2**63 - 1, -(2**63), 5)
    df = spark.createDataFrame([(i, "u", same if i > 0 else "y" * 9000) for i in ids], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["problem"]) for r in warc.round_trip(df, 4096).collect()}
    assert got == {10**18: ("revisit", 2**63 - 1, None), 2**63 - 1: ("response", None, None), -(2**63): ("response", None, None), 5: ("revisit", 2**63 - 1, None)}
    made = [r for key, uri, size, revisits in (("", "none", 9, False), (str(2**63), "large", 1500, False), ("x7", "word", 9000, False), ("8", "again", 1500, True)) for r in warc._records(key, uri, b"q" * size, revisits, 4096)]
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n" for r in made))
    read = warc.read_archive(spark, str(tmp_path)).cache()
    assert {r["target_uri"]: (r["key"], r["problem"]) for r in read.collect()} == {"none": (None, None), "large": (None, "record key"), "word": (None, "record key"), "again": (8, None)}
    assert [(r["payload_bytes"], r["problem"]) for r in warc.resolved(read).where("key = 8").collect()] == [(1500, None)]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-5, 6, 4).astype(float).tolist(), "x") for i in range(90)] + [(200, None, "x"), (220, [1.0, None, 1.0, 1.0], "x"), (240, [float("nan")] * 4, "x"), (260, [1.0, 2.0], "x"), (40, [9.0] * 4, "x"), (None, [1.0] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, dim string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5, candidates=16, queries=3).collect()}
    fit = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fit[i] = min(fit.get(i, v), v)
    expect = {}
    for q in (i for i in fit if i % 20 == 0):
        best = sorted((-int(np.dot(fit[q], v)), i) for i, v in fit.items() if i != q and len(v) == len(fit[q]))[:5]
        expect |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == expect
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(k, (base[k % 12] + rng.normal(size=8) * 0.05).tolist(), k % 2) for k in range(60)]
    rows += [(100, rows[0][1], 0), (101, [2 * x for x in rows[0][1]], 0), (102, rows[0][1], None), (103, None, 0), (104, [0.0] * 8, 0), (105, [float("inf")] * 8, 0), (106, [], 0), (107, [1.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string")
    got = embed_dedup.near_duplicates(df, block=9).collect()
    ok = [i is not None and v is not None and len(v) > 0 and np.isfinite(v).all() and any(v) and lab is not None for i, v, lab in rows]
    links, n = [], dict.fromkeys((r[0] for r in rows), 0)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((rows[a][0], rows[b][0]))
                    n[rows[a][0]] += 1
                    n[rows[b][0]] += 1
    root = _roots([r[0] for r in rows if r[0] is not None], links)
    assert len(got) == len(rows) and len(links) > 50
    for r in got:
        assert r["n_links"] == n[r["vec_id"]] and r["component_id"] == root.get(r["vec_id"]), r
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_url_rules_and_classifier(spark):
    rules = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
    cases = {
        "http://A.example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://x.org": ("x.org", "", None, "allow"), "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://cheappills.net/a": ("cheappills.net", "/a", None, "block"), "http://n.net/a?b://c/d": ("n.net", "/a", None, "allow"),
    }
    urls = [*cases] + [f"http://site{k % 7}.blog.net/en/{k}" for k in range(60)]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(df, rules).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert url_filter.judged(df.limit(0), rules).count() == 0


def _judged_by_loops(urls):
    """Counts, odds and verdicts without rules, in plain Python."""
    U = url_filter
    parts = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        parts.append((re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", ""))
    runs = lambda t: [w for w in re.split("[^a-z]+", t.lower()) if w]
    sites = {(w, ".".join(h.split(".")[-2:])) for h, _ in parts for w in runs(h)}
    counts = Counter(w for w, _ in sites)
    counts = Counter({w: n for w, n in counts.items() if n > 1})
    counts.update(w for _, p in parts for w in runs(p))
    counts = Counter({w: n for w, n in counts.items() if len(w) <= 63})
    total = max(1, sum(counts.values()))
    for found, weight in ((U.SEEDS, U.SEED_WEIGHT), (U.COMMON, U.COMMON_WEIGHT)):
        for w in found:
            counts[w] = max(counts[w], weight, total * weight // 20_000)
    whole = sum(counts.values())
    words = U.Words({w: math.log(whole / n) for w, n in counts.items()}, math.log(whole + 1))

    def tokens(h, p):
        labels = h.split(":")[0].split(".")
        host = [w for r in runs(".".join(labels[:-1] if len(labels) > 1 else labels)) for w in words.split(r)]
        return [f"h:{w}" for w in host], [f"p:{w}" for w in runs(p)]

    seeds, sums, urls_of = {f"h:{w}" for w in U.SEEDS}, {True: Counter(), False: Counter()}, Counter()
    for h, p in parts:
        host, path = tokens(h, p)
        seeded = not seeds.isdisjoint(host)
        urls_of[seeded] += 1
        sums[seeded].update(t for t in host + path if t not in seeds)
    n = {k: sum(c.values()) for k, c in sums.items()}
    every = max(1, n[True] + n[False])
    odds = dict.fromkeys(seeds, U.SEED_ODDS)
    for t in {*sums[True], *sums[False]}:
        both = U.SMOOTHING * (sums[True][t] + sums[False][t]) / every
        odds[t] = math.log((sums[True][t] + both) / (n[True] + U.SMOOTHING) / ((sums[False][t] + both) / (n[False] + U.SMOOTHING)))
    prior = math.log((urls_of[True] + 1) / (urls_of[False] + 1))
    return ["block" if prior + sum(odds[t] for side in tokens(h, p) for t in side) > U.MARGIN else "allow" for h, p in parts], parts


def test_url_classifier_against_loops(spark):
    rng = random.Random(12)
    bad = ["casino", "lottery", "winners", "luckyday", "jackpot", "bonus"]
    good = ["garden", "river", "museum", "library", "stone", "music"]
    urls = [None, "no scheme", "http://" + "z" * 300 + ".net/a", "http://x.net/" + "long/" * 3000]
    for k in range(600):
        names, suffix = (bad, "bonus") if k % 4 == 0 else (good, "page")
        host = rng.choice(["", "-", "."]).join(rng.sample(names, 2))
        urls.append(f"http://{rng.choice(['www.', 'm.', ''])}{host}.{rng.choice(['net', 'com'])}/{rng.choice(['en', 'fr'])}/{suffix}{rng.choice(['', '/win'])}")
    urls += ["http://winnersluckyday.net/bonus", "http://track.museum.library.river.music.net/page", "http://a.b.c/" + "garden/" * 5] * 2
    expect, parts = _judged_by_loops(urls)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["host"], r["path"]) for r in url_filter.judged(df, ()).collect()}
    assert [got[k] for k in range(len(urls))] == [(v, *p) for v, p in zip(expect, parts, strict=True)]
    seeded = [any(w in url_filter.SEEDS for w in re.split("[^a-z]+", h)) for h, _ in parts]
    # counted words block hosts without a seed and outweigh one
    assert {(s, v) for s, v in zip(seeded, expect, strict=True)} == {(True, "block"), (True, "allow"), (False, "block"), (False, "allow")}


def test_url_classifier_counts_rare_tokens(spark):
    # 50,100 path words of five URLs each, and one of the blocked class that is rarer than all of them
    word = F.translate((F.col("id") % 50_100 + 100_000).cast("string"), "0123456789", "abcdefghij")
    many = spark.range(250_500).select("id", F.concat(F.lit("http://plain.net/"), word).alias("url"))
    few = spark.createDataFrame([(-1, "http://casino.net/zrare"), (-2, "http://casino.net/zrare"), (-3, "http://other.net/zrare/zrare"), (-4, "http://other.net/x")], "id long, url string")
    got = url_filter.judged(many.union(few).withColumnRenamed("id", "page_id"), ()).where("page_id < 0").collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {-1: "block", -2: "block", -3: "block", -4: "allow"}


def test_text_columns(spark):
    df = _docs(spark, [(1, "mail a@b.cd or +1 (389) 555-5010"), (2, None), (3, ""), (3, "clean"), (4, "<p>x" * 3)])
    out = {(r["doc_id"], r["spans"]) for r in pii.pii_digest(df).collect()}
    assert out == {(1, "email:5:11,phone:15:32"), (2, ""), (3, ""), (4, "")}
    assert [r["base_sha256"] for r in pii.pii_digest(df).where("doc_id = 2").collect()] == [hashlib.sha256(b"").hexdigest()]
    clean = {(r["text"], r["n_chars"]) for r in pii.redact_pii(df).collect()}
    assert ("mail <EMAIL> or <PHONE>", 23) in clean and (None, None) in clean and pii.redact_pii(df).columns == df.columns
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = df.select("text", sentencepiece_unigram.encode("text", path).alias("ids")).select("text", "ids", sentencepiece_unigram.decode("ids", path).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in back) and [r["ids"] for r in back if r["text"] == ""] == [[]]
    checked = df.select("text", sentencepiece_unigram.encode_checked("text", path).alias("c")).select("text", "c.ids", "c.same").collect()
    assert sorted((str(r["text"]), r["ids"], True) for r in back) == sorted((str(r["text"]), r["ids"], r["same"]) for r in checked)
    assert {r[0] for r in df.select(html_text.extract_text("text")).collect()} >= {None, "", "x\n\nx\n\nx"}


def test_empty_and_repeated_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    none = _docs(spark, [])
    coded = none.select(sentencepiece_unigram.encode("text", path).alias("ids"))
    assert coded.select(sentencepiece_unigram.decode("ids", path)).count() == pii.pii_digest(none).count() == pii.redact_pii(none).count() == none.select(html_text.extract_text("text")).count() == 0
    twice = _docs(spark, [(1, "a@b.cd <p>x"), (1, "a@b.cd <p>x"), (None, "a@b.cd <p>x")]).withColumn("spans", F.lit("clash")).withColumn("found", F.lit(0))
    assert [(r["n_email"], r["spans"]) for r in pii.pii_digest(twice).collect()] == [(1, "email:0:6")] * 3
    assert len({tuple(r[0]) for r in twice.select(sentencepiece_unigram.encode("text", path)).collect()}) == 1
    assert {r[0] for r in twice.select(html_text.extract_text("text")).collect()} == {"a@b.cd\n\nx"}


def test_stages_against_brute_force(spark, tmp_path):
    """All stages over one small table: what each keeps, by loops over the same rows."""
    import corpus_pipeline as cp

    rng = random.Random(21)
    good = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    texts = [(k, good(60) if k % 4 else "!! " + " ".join(w.upper() + "$$$" for w in good(60).split())) for k in range(160)]
    texts += [(200 + k, texts[k][1] + " end") for k in (1, 2, 3)] + [(300, texts[5][1] + " mail a@b.cd"), (301, None), (302, "")]
    docs = _docs(spark, texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, 1 if k % 4 else 0, 0) for k in range(160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = cp.STAGES[0][1](spark, docs, str(tmp_path))
    ids = {r["doc_id"] for r in kept.collect()}
    scored = {r["doc_id"]: r["predicted"] for r in quality.scored(docs, labels).collect()}
    assert ids == {i for i, p in scored.items() if p} and ids >= {k for k in range(160) if k % 4} and not ids & {k for k in range(160) if k % 4 == 0}
    out = cp.run(spark, str(tmp_path)).collect()
    sets = {i: _sets(t) for i, t in texts if i in ids}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expect = {i for i, root in _roots(sorted(sets), links).items() if i == root}
    assert {r["doc_id"] for r in out} == expect and not expect & {201, 202, 203, 300}
    own, clean = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), dict(texts)
    assert {r["doc_id"]: r["length"] for r in out} == {i: len(own.encode(clean[i] or "", add_special_tokens=False).ids) + 1 for i in expect}
    assert len({r["sequence_id"] for r in out}) == -(-sum(r["length"] for r in out) // 4096)


def test_held_out_accuracy(spark):
    """The README's figures at sf0.1, or better."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.scored(docs, labels).where("held_out").join(labels.where("quality in (0, 1)"), "doc_id").select("score", "predicted", "quality").toPandas()
    p, y = rows["score"].to_numpy(), rows["quality"].to_numpy()
    rank = p.argsort().argsort() + 1
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > 0.999
    assert rows["predicted"][y == 1].mean() > 0.99 and rows["predicted"][y == 0].mean() < 0.03


def test_quality_learns_from_its_folds_only(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(["the", "house", "of", "river", "stone", "and", "walks"], k=40))
    texts = [(k, good() if k % 3 else good().upper().replace(" ", "!! ")) for k in range(150)] + [(500, None), (501, ""), (None, "x")]
    docs = _docs(spark, texts)
    fold = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    labels = spark.createDataFrame([(k, (1 if k % 3 else 0) if not fold(k) else 1 - (1 if k % 3 else 0), 0) for k in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    right = [r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 150]
    assert np.mean(right) > 0.97
    assert all(r["held_out"] == (r["doc_id"] is not None and fold(r["doc_id"])) for r in rows)
    assert quality.scored(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.union(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 900_000))
    kept = cp.STAGES[1][1](spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900000").count() == 0
    assert cp.STAGES[2][1](spark, docs, sf_dir).columns == docs.columns
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "near duplicates", "personal data", "packing"]


def test_tables_that_are_not_there_fail_loudly(spark, tmp_path):
    import corpus_pipeline as cp

    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cp.run(spark, str(tmp_path))
