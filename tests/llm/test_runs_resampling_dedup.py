import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from wayfold.llm import exact_dedup, resampling, runs
from wayfold.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, kept string, rank long, run string, weight string, sha string, size int"


def rows(r):
    vocabulary = ["the", "The", "a", "été", "road", "x1", "don't", "…", "ROAD", "9", "世界"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 80))) for _ in range(150)]
    texts += [(" ".join(r.choice("abc") for _ in range(r.randint(1, 5))) + r.choice([" ", "\n", "\x0b", "  "])) * r.randint(3, 30) for _ in range(80)]
    texts += ["", " \t\r\n\x0b\x0c ", "z" * 3000, "    \u0085", "word " * 30_000, " ".join(str(i % 700) for i in range(9000)), texts[0], texts[0], texts[3]]
    out = [(i, t, "clash", 7, "clash", "clash", "clash", 1) for i, t in enumerate(texts)]
    return out + [(900, None, None, None, None, None, None, None), (None, "no id " * 9, None, 1, None, None, None, None), (None, texts[0], None, 1, None, None, None, None), (3, texts[3], "again", 2, None, None, None, None), (3, "other text", None, 2, None, None, None, None), (-5, texts[0], None, 2, None, None, None, None)]


@pytest.fixture(scope="module")
def data():
    return rows(random.Random(4))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(w):
    best = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p) and (s, i + p) not in best:
                best[s, i + p] = p
            i = max(i, s + 1)
    return sorted((s, e, p) for (s, e), p in best.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda x: (-Fraction(x[1] - x[0], x[2]), x[0], x[2])) if found else None
    kept = [x for i, x in enumerate(w) if not any(s + p <= i < e for s, e, p in found)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[0], best[1] - best[0], best[2], (best[1] - best[0]) * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), digest(" ".join(kept)))


def test_runs_equal_brute_force():
    r = random.Random(11)
    for k in range(4000):
        if k % 3 == 0:
            w = [r.randrange(2) for _ in range(r.randint(0, 70))]
        elif k % 3 == 1:
            w = [x for _ in range(r.randint(1, 6)) for x in [r.randrange(r.choice([1, 2, 9])) for _ in range(r.randint(1, 7))] * r.randint(1, 7)]
        else:  # repetitions of repetitions, and stretches that are copied from far away
            u = [r.randrange(2) for _ in range(r.randint(1, 4))] * r.randint(1, 6) + [2]
            w = u * r.randint(1, 6) + [r.randrange(3) for _ in range(9)] + u * r.randint(1, 3)
        assert runs.runs(w) == brute_runs(w), w
        ids, at = np.array(w, np.int64), np.array([0, len(w)])
        assert sorted((s + a, e + a, p) for a, b in runs.islands(ids, at) for s, e, p in runs.runs(ids[a:b].tolist())) == brute_runs(w), w


def test_factors_are_longest_earlier_occurrences():
    r = random.Random(12)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randint(1, 40))]
        i = 0
        for start, size, source in runs.factors(w):
            longest = max((k for j in range(i) for k in range(len(w) - i + 1) if w[j : j + k] == w[i : i + k]), default=0)
            assert (start, size) == (i, max(1, longest)) and (source == -1) == (longest == 0)
            assert source == -1 or source < i and w[source : source + size] == w[i : i + size]
            i += size
        assert i == len(w)


def test_islands_do_not_reach_into_other_texts():
    r = random.Random(13)
    for _ in range(300):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] * r.randint(1, 5) for _ in range(6)]
        got = list(runs._rows([[x.encode() for x in t] for t in texts]))
        assert [g[0] for g in got] == [len(brute_runs(t)) for t in texts]


def test_word_runs(docs, data, empty):
    got = sorted(map(tuple, runs.word_runs(docs).collect()), key=repr)
    assert got == sorted((brute_row(i, t) for i, t, *_ in data), key=repr)
    assert any(x[1] for x in got) and any(zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in got)
    assert runs.word_runs(empty).count() == 0


def test_checksums_of_features():
    r = random.Random(14)
    data = bytes(r.randrange(256) for _ in range(3000))
    b = np.array([r.randrange(2900) for _ in range(200)] + [0, 5, 7])
    e = np.array([x + r.choice([0, 1, 3, 30, 64, 65, 90]) for x in b[:-3]] + [3000, 5, 71])
    assert resampling.crc32s(np.frombuffer(data, np.uint8), b, e).tolist() == [zlib.crc32(data[x:y]) for x, y in zip(b, e)]
    assert len(resampling.crc32s(np.frombuffer(data, np.uint8), b[:0], e[:0])) == 0


def brute_resample(data, target, most, buckets, percent, least):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1))
    of, words, s, t = defaultdict(Counter), Counter(), Counter(), Counter()
    for i, text, *_ in data:
        w = cut(text)
        of[i] += grams(w)
        words[i] += len(w)
        s += grams(w)
    for x in target:
        t += grams(cut(x))
    sums, sumt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sums + buckets) / ((s[b] + 1) * (sumt + buckets)))) for b in s}
    out = []
    for i, c in of.items():
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if words[x[0]] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    rank = {x[0]: k + 1 for k, x in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(((*x, rank.get(x[0])) for x in out), key=repr)


@pytest.mark.parametrize(("most", "buckets", "block"), [(1, 10_000, 1024), (2, 50, 3), (3, 10_000, 1024)])
def test_resampling_equals_brute_force(spark, docs, data, empty, monkeypatch, most, buckets, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    target = ["the road to x1", None, "ROAD été 世界 9 the the", ""]
    t = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id long")
    got = resampling.resample(docs, t, most=most, buckets=buckets, percent=30, least=20)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(data, target, most, buckets, 30, 20)
    if most == 1:
        assert sorted(map(tuple, resampling.resample(docs, t.where("text = '?'")).collect()), key=repr) == brute_resample(data, [], 1, 10_000, 10, 20)
        assert resampling.resample(empty, t).count() == 0


def test_equal_scores_go_to_the_smaller_id(spark):
    d = spark.createDataFrame([(i, 40, 5 if i % 3 else 9) for i in range(200, 0, -1)] + [(500, 3, 99), (None, 30, 9)], "doc_id long, n_words long, score long").repartition(7)
    got = {r.doc_id: r["rank"] for r in resampling._ranked(d, 50, 20, Scratch(spark)).collect()}
    order = sorted([*range(1, 201), None], key=lambda i: (i is not None and i % 3 > 0, i is None, i or 0))
    assert got == {i: k + 1 if k < 100 else None for k, i in enumerate(order)} | {500: None}


def brute_exact(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, top[t or ""], len(groups[t or ""]), i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in data), key=repr)


@pytest.mark.parametrize(("fan_runs", "large"), [(1, 1000), (40, 2), (300, 10**9)])
def test_exact_dedup_equals_brute_force(spark, data, empty, monkeypatch, fan_runs, large):
    monkeypatch.setattr(exact_dedup, "LARGE", large)
    d = spark.createDataFrame(data, SCHEMA).repartition(fan_runs)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(d).collect()), key=repr) == brute_exact(data)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_texts_that_share_one_digest_stay_apart(spark):
    d = spark.createDataFrame([(1, "aa", "x", 3, 0), (2, "aa", "y", 3, 300), (3, "aa", "x", 3, 17), (4, "aa", "x", 4, 1)], "doc_id long, sha string, md string, n int, run long")
    got = exact_dedup.merged_digests(d.selectExpr("doc_id", "unhex(sha) sha", "cast(md as binary) md", "n", "run"), Scratch(spark)).collect()
    assert sorted((r.keep_id, r.size) for r in got) == [(2, 1), (3, 2), (4, 1)]


@pytest.mark.parametrize("name", ["op12_resampling", "op13_exact_dedup"])
def test_new_queries_equal_their_sql(spark, name):
    import duckdb

    from wayfold.llm import queries

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for table in ("documents", "benchmark"):
        c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert got == sorted(c.sql(queries.oracle_sql()[name]).select(*sorted(df.columns)).fetchall(), key=repr)


def test_scratch_stays_in_shared_folders(spark):
    from wayfold.llm import scratch

    assert scratch.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    kept = spark.conf.get("spark.checkpoint.dir")

    class Unset:
        class conf:
            get = staticmethod(lambda k, *d: {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}.get(k, *d))

    assert kept and scratch.shared_dir(Unset) == "hdfs://x/warehouse/scratch"


def test_token_counts_of_one_repeated_id(spark):
    import public_tokenizers
    import sentencepiece

    from wayfold.llm import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [f"road number {i % 9}  turns\nleft {'é' * (i % 4)}" for i in range(5000)]
    d = spark.createDataFrame([(7, t) for t in texts], "doc_id long, text string")
    got = sorted(r.n_tokens for r in token_counts.token_counts(d, path).collect())
    assert got == sorted(len(model.encode(t)) for t in texts)
