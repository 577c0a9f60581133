import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import bytes_np, embedding_dedup, graph, language_id, line_dedup, mixing, ngram_join, packing, pii, progressive_jpeg, quality, queries, token_counts
from wayfold.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, root long"


def sentence(r, n):
    return " ".join("".join(r.choice(["th", "an", "er", "in", "re", "la", "ción", "É"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus():
    r = random.Random(1)
    texts = [sentence(r, r.randint(1, 90)) for _ in range(40)]
    base = [sentence(r, 60) for _ in range(4)]
    for b in base:  # near copies around the threshold, and copies
        w = b.split()
        for k in range(1, 7):
            v = list(w)
            for _ in range(k // 2):
                v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [base[0]] * 5 + ["", "  \n\t ", "one", "One", "a b c d", "a b c d e", "A B c D e f", "x" * 5000, sentence(r, 4000), "line\n" * 9, "<|endoftext|> a  b\u0000c\t", "▁ 世界   ﬁ"]
    docs = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t), "clash", 1) for i, t in enumerate(texts)]
    docs += [(900, None, None, None, None, None, None), (None, "no id here at all", "en", "s1", 3, "x", 2), (3, texts[3], "en", "s1", 4, "again", 3)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingle_set(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def union(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def test_word_hashes_and_shingles():
    texts = [t for _, t, *_ in corpus()]
    x, of, n = bytes_np.shingles(*bytes_np.words(*bytes_np.texts(pa.array(texts))))
    assert n.tolist() == [len(shingle_set(t)) for t in texts]
    old, bytes_np.CHUNK = bytes_np.CHUNK, 64  # a long text in parts
    try:
        t = texts[-6] if len(texts[-6]) > 1000 else "a bc  d\n" * 400
        h, _ = bytes_np.words(*bytes_np.texts(pa.array([t])))
    finally:
        bytes_np.CHUNK = old
    assert (h == bytes_np._words(*bytes_np.texts(pa.array([t])))[0]).all()


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, None)]
    parent = {}
    for a, b in links:
        if b is not None and a != b:
            union(parent, a, b)
    got = {x.id: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: find(parent, k) for k in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_ngram_components_equal_brute_force(docs, empty):
    rows = [(i, t) for i, t, *_ in corpus()]
    sets, parent = [shingle_set(t) for _, t in rows], {}
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if i is not None and rows[b][0] is not None and k and 100 * k >= 75 * len(sets[a] | sets[b]):
                union(parent, i, rows[b][0])
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    assert got == sorted((str(i), len(s), None if i is None else find(parent, i)) for (i, _), s in zip(rows, sets))
    assert ngram_join.ngram_components(empty).count() == 0


def test_ngram_components_across_blocks(spark, monkeypatch):
    """A clump whose buckets are far above JOINED sets, around the threshold: blocks are held against blocks, and nothing is lost or added."""
    monkeypatch.setattr(ngram_join, "JOINED", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(12)
    base, texts = sentence(r, 160).split(), []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([3, 4, 5, 6])):
            w[r.randrange(len(w))] = f"changed{i}"
        texts.append(" ".join(w))
    sets, parent = [shingle_set(t) for t in texts], {}
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                union(parent, a, b)
    expected = {i: find(parent, i) for i in range(len(texts))}
    assert 5 < len(set(expected.values())) < 85
    ran, crossing = spark.sparkContext.accumulator(0), ngram_join._crossing

    def counted(percent):
        rows = crossing(percent)

        def run(f):
            ran.add(1)
            return rows(f)

        return run

    monkeypatch.setattr(ngram_join, "_crossing", counted)
    found = ngram_join.ngram_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == expected
    assert ran.value > 1


def test_signatures_meet_for_every_similar_pair():
    """Any two sets that reach the similarity share a signature, at all sizes and with hot shingles."""
    r = np.random.default_rng(4)
    hot = np.zeros(1 << ngram_join.HOT_BITS, bool)
    hot[r.integers(0, len(hot), len(hot) // 2)] = True
    for n in (1, 2, 3, 4, 7, 40, 127, 380, 510, 512, 513, 690, 2100, 3000):
        for _ in range(6):
            x = r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
            y = np.concatenate([x[: n - n // 8], r.integers(0, 2**63, r.integers(0, n // 8 + 1)).astype(np.uint64)])
            i = len(np.intersect1d(x, y))
            if 100 * i < 75 * (len(x) + len(y) - i):
                continue
            h, of = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
            o = np.lexsort((h, of))
            sig, own, small = ngram_join.signatures(h[o], of[o], np.array([len(x), len(y)]), hot, 75)
            both = set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())
            assert both and any(small[sig == s].any() for s in both)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m, both in ((90, 100, 80), (400, 500, 380), (700, 900, 500), (3, 3, 2), (70_000, 80_000, 69_000)):
        x, y = (r.integers(0, 2**63, k).astype(np.uint64) for k in (n, m))
        y[:both] = x[:both]
        a, b = (ngram_join._stacked(ngram_join._bitmaps(v, np.array([len(v)]))) for v in (x, y))
        words = min(a.shape[1], b.shape[1])
        differ = int(np.bitwise_count(ngram_join._folded(a, words) ^ ngram_join._folded(b, words)).sum())
        assert 0 < differ <= n + m - 2 * both


def test_line_dedup(spark, empty):
    r = random.Random(5)
    a, b = sentence(r, 30), sentence(r, 30)
    near = a.replace(a.split()[10], "other", 1)
    d = spark.createDataFrame([(1, f"{a}\n{b}\n\n{a}", "x"), (2, f"  {a}\nnew line\n", "y"), (3, near, "z"), (4, None, "n"), (None, a, "free"), (5, "", "e"), (2, f"  {a}\nnew line\n", "y")], "doc_id long, text string, extra string")
    got = [(x.doc_id, x.text, x.extra, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(d).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, f"{a}\n{b}\n", "x", 4, 1), (2, "new line\n", "y", 3, 1), (2, "new line\n", "y", 3, 1), (3, "", "z", 1, 1), (4, None, "n", 0, 0), (None, a, "free", 1, 0), (5, "", "e", 1, 0)]))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_pairs_in_crowded_buckets(spark):
    """Near pairs are found where their buckets hold many variants of one template that match neither of them."""
    r = random.Random(9)
    slots = [[" ".join(f"{sentence(r, 1)}{r.randrange(10**6)}" for _ in range(3)) for _ in range(2)] for _ in range(60)]
    lines = []
    for _ in range(300):
        picks = [r.random() < 0.3 for _ in slots]
        swapped = r.sample(range(60), 3)
        near = [x != (i in swapped) for i, x in enumerate(picks)]
        lines += [" ".join(s[x] for s, x in zip(slots, p, strict=True)) for p in (picks, near)]
    got = {x.line_no for x in line_dedup.duplicate_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert 290 <= len(got) <= 310


def test_line_dedup_compares_every_line_of_a_crowded_bucket(spark, monkeypatch):
    """Lines that are like neither end of any of their buckets take part as well; buckets are dealt by one exchange; sizes exclude no similar pair."""
    r = random.Random(12)
    slots = [[" ".join(f"{sentence(r, 1)}{r.randrange(10**6)}" for _ in range(3)) for _ in range(2)] for _ in range(40)]
    lines = [" ".join(s[r.random() < 0.3] for s in slots) for _ in range(300)]
    across, save, seen = line_dedup._across, Scratch.save, {}

    def spied(members, roots, texts, *rest):
        ids = members.select("id").distinct()
        seen.update(members=ids.count(), left_out=ids.join(texts, "id", "left_anti").count())
        return across(members, roots, texts, *rest)

    def saved(self, df, name):
        if name == "inner":
            df.collect()
            seen["plan"] = df._jdf.queryExecution().executedPlan().toString()
        return save(self, df, name)

    monkeypatch.setattr(line_dedup, "_across", spied)
    monkeypatch.setattr(Scratch, "save", saved)
    line_dedup.duplicate_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    assert seen["members"] > 200 and seen["left_out"] == 0
    assert "ReusedExchange" in seen["plan"]
    d = spark.createDataFrame(list(enumerate(["abcdefgh" * 9, "abc", "", *lines[:5]])), "id long, clean string")
    for row in line_dedup._lows(d).join(d, "id").collect():
        true = {row.clean[i : i + 7] for i in range(max(1, len(row.clean) - 6))}
        assert row.fewest <= len(true) <= row.most == max(1, len(row.clean) - 6)


def test_line_dedup_deals_crowded_buckets_in_turns(spark, monkeypatch):
    """Buckets of several blocks give all similar pairs, in turns as at once; both sides of the comparison share an exchange; a long line's sketch is of fixed size."""
    r = random.Random(13)
    base = [[sentence(r, 1) + str(r.randrange(10**6)) for _ in range(k)] for k in (2, 8, 20, 60)]
    lines = sorted({" ".join(w if r.random() < 0.97 else str(r.randrange(10**6)) for w in words) for words in base for _ in range(50)})
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, clean string").cache()
    members = spark.range(40).select((F.col("id") * 16 + 11).alias("bucket")).crossJoin(texts.select("id")).where("bucket div 16 = id % 40 or bucket < 16")
    minima = texts.select("id", *(F.col("id").alias(f"m{j}") for j in range(line_dedup.MINIMA)))
    roots = spark.createDataFrame([], "id long, root long")
    save, plans, columns = Scratch.save, [], {}

    def saved(self, df, name):
        if name == "across" and "repartition" in df._jdf.queryExecution().logical().toString().lower():
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        columns[name] = df.columns
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    links = lambda: {(x.a, x.b) for x in line_dedup._across(members, roots, texts, minima, 75, Scratch(spark)).collect()}
    once = links()
    assert len(plans) == 1 and "ReusedExchange" in plans[0]
    monkeypatch.setattr(line_dedup, "TURN", 100)
    monkeypatch.setattr(line_dedup, "SHARE", 10**6)
    assert links() == once and len(plans) > 2
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in lines]
    alike = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if 100 * len(x & y) >= 75 * len(x | y)}
    assert once == alike and len(alike) > 300
    long = texts.where(F.length("clean") >= line_dedup.LOW)
    assert long.count() > 50 and line_dedup._lows(long).where("low.whole is not null").isEmpty()


def test_line_dedup_equals_brute_force_on_character_shingles(spark):
    """Lines of a few words with one edited character or another letter case; the brute force cuts its own shingles."""
    r = random.Random(11)
    lines = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(r.randint(5, 20))) for _ in range(80)]
    for k in range(60):
        i = r.randrange(len(lines[k]))
        lines.append(lines[k][:i] + "9" + lines[k][i + 1 :])
    lines += [lines[k].title() for k in range(60, 80)] + ["a", "A", "abcd", "ABCD", "a\rbcdef", "a\rBCDEF", "\t\t", "\t\t"]
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in (x.lower() for x in lines)]
    parent = {i: i for i in range(len(lines))}
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                union(parent, i, j)
    true = {i for i in parent if find(parent, i) != i}
    got = {x.line_no for x in line_dedup.duplicate_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert len(true) > 60 and got <= true and len(got) >= 0.95 * len(true)


def test_line_dedup_excludes_short_lines_by_their_hashes(spark):
    """Lines with all their hashes at hand are held against each other's whole sets, not taken as likely for their shortness."""
    letters = "".join(chr(0x4E00 + k) for k in range(80)) + "🙂" * 9
    lines = [letters, letters[:-3] + "xyz", letters[:40] + letters[:39:-1], "abc", "abc\r", "abcdefg🙂", "🙂"]
    d = spark.createDataFrame(list(enumerate(lines)), "id long, clean string")
    lows = line_dedup._lows(d).join(d, "id")
    both = lows.alias("a").crossJoin(lows.alias("b")).select("a.id", F.col("b.id").alias("other"), line_dedup._likely(F.col("a.low"), F.col("b.low"), 75).alias("likely"), line_dedup._similar("a.clean", "b.clean", 75).alias("similar"))
    sets = [{t[i : i + 7] for i in range(max(1, len(t) - 6))} for t in lines]
    for r in both.collect():
        x, y = sets[r.id], sets[r.other]
        assert r.likely == r.similar == (100 * len(x & y) >= 75 * len(x | y)), (r.id, r.other)


def test_token_counts_equal_the_library(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect())
    assert got == sorted((str(i), len((t or "").encode()), n := len(m.encode(t or "")), n > 4096) for i, t, *_ in corpus())
    assert token_counts.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("text", ["a b", "  a", "a  ", "a\nb", "a \n b", "\n\n", "a\n\n  b c", " ", "ab  cd\n", "e\r\nf", "🙂 a", "x" * 300])
def test_token_units(text):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = token_counts._Lengths(m, {})
    if not token_counts._ODD.search(text):
        assert sum(n[u] for u in token_counts.units(text)) == len(m.encode(text))


def test_packing_round_trip(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, **queries.byte_bpe()).toPandas()
    ids = {}
    for i, text, *_ in corpus():
        ids[-1 if i is None else i] = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    rows["doc_id"] = rows.doc_id.fillna(-1).astype(int)
    assert set(rows.doc_id) == set(ids)
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, g in rows.groupby("doc_id"):
        times = 2 if i == 3 else 1  # the repeated row is packed as a document of its own
        assert g.length.sum() == times * len(ids[i])
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(empty, **queries.byte_bpe()).count() == 0


def test_texts_that_the_fast_encoder_refuses():
    from tokenizers import Tokenizer

    p = queries.byte_bpe()
    encode = packing.encoder(p["ranks_path"], p["pattern"], p["specials"], p["exact_path"])
    for t in (" " * 1_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert encode(t).tolist() == Tokenizer.from_file(p["exact_path"]).encode(t, add_special_tokens=False).ids


def test_windows_hold_lexical_neighbours_and_little_padding(spark):
    """Documents of 60 topics with words of their own, in shards far smaller than the corpus."""
    r = random.Random(8)
    own = [[sentence(r, 1) + str(k) + sentence(r, 1) for _ in range(40)] for k in range(60)]
    rows = [(i, " ".join(r.choice(own[i % 60]) if r.random() < 0.3 else sentence(r, 1) for _ in range(70))) for i in range(1800)]
    r.shuffle(rows)
    old, packing.SHARD = packing.SHARD, 200
    try:
        out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), **queries.byte_bpe()).toPandas()
    finally:
        packing.SHARD = old
    out["topic"] = out.doc_id % 60
    share = out.groupby("sequence_id").topic.agg(lambda v: v.value_counts().iloc[0] / len(v))
    assert share.mean() > 0.5
    full = out.groupby("sequence_id").length.sum()
    assert (full >= 2048 - packing.UNIT).mean() > 0.85


def test_checksums_of_parts():
    d = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes()
    for cut in (0, 1, 64, 4999):
        assert packing.crc_after(zlib.crc32(d), zlib.crc32(d[:cut]), len(d) - cut) == zlib.crc32(d[cut:])


def test_mixing(docs, empty):
    got = mixing.mix(docs, keep=("source",)).toPandas()
    assert sorted(got["size"]) == sorted(len(words(t)) for _, t, *_ in corpus())
    for _, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= 0.5
        assert g.target.iloc[0] <= 2 * g.source_size.iloc[0]
    assert (got.taken <= 2 * got["size"]).all()
    assert got.drop_duplicates("source").target.sum() == pytest.approx(1.5 * got["size"].sum())
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].fillna(got.doc_id).values.tolist() or got.taken.sum() == again.taken.sum()
    assert mixing.mix(empty).count() == 0


def test_targets_share_the_excess(spark):
    s = spark.createDataFrame([("a", 1, 10), ("b", 1, 1000), ("c", 1, 1000), (None, 1, 1000), ("Z", 1, 0)], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    w, size = {"Z": 3, "a": 1, "b": 2, "c": 3, None: 1}, {"Z": 0, "a": 10, "b": 1000, "c": 1000, None: 1000}
    t, full = {}, set()
    while True:  # the rule as stated, round by round
        left = 1.5 * 3010 - sum(2 * size[k] for k in full)
        total = sum(w[k] for k in w if k not in full)
        t = {k: 2 * size[k] if k in full else left * w[k] / total for k in w}
        over = {k for k in w if t[k] > 2 * size[k]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(t)


def test_language_id(spark, empty):
    r = random.Random(3)
    parts = {"en": ["th", "wh", "sh", "ing", "ed"], "de": ["sch", "ung", "ü", "ß", "cht"], "fr": ["eau", "é", "oi", "ç", "qu"], "es": ["ción", "ñ", "rr", "ll", "ado"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(40)), k, "clash") for i in range(240) for k in [list(parts)[i % 4]]]
    rows += [(900, None, "en", ""), (901, "123 !?", "en", ""), (902, "", None, ""), (903, "世界", None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {x.doc_id: x for x in language_id.predict(d, language_id.train(d, ~language_id.held_out(F.col("doc_id")))).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[903].lang_pred != "und"
    assert np.mean([out[i].lang_pred == k for i, _, k, _ in rows[:240]]) > 0.98
    assert all(0 <= x.score <= 1 for x in out.values())
    assert language_id.predict(empty, language_id.train(empty, F.lit(True))).count() == 0
    assert {x.lang_pred for x in language_id.predict(d, None).collect()} == {"und"}


def base_by_pattern(t):
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 12 <= len(d := re.sub("[ -]", "", s)) <= 19 and pii._luhn(d), "phone": lambda s: 9 <= sum(c.isdigit() for c in s) <= 15}
    pat = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return sorted(((k, *m.span()) for k in pat for m in re.finditer(pat[k], t) if ok[k](m[0])), key=lambda s: (s[1], list(pat).index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(7)
    for _ in range(3000):
        t = "".join(r.choice(["1", "25", "255.", ".", "@", "a", "a.b", "-", " ", "+", "(", "4111 1111 1111 1111", "é", "%", "@x.y", "0"]) for _ in range(r.randint(1, 25)))
        assert pii.base_spans(t) == base_by_pattern(t), t


def test_tagger_finds_what_patterns_do_not():
    """Recall of the labelled spans that no pattern finds; zero without the tagger. Few others are added."""
    tagger = pii.default_tagger()
    lines = labelled = pii.labelled_lines(150, 77)
    hit = total = wrong = 0
    for (text, spans), found in zip(lines, pii.tag_texts(tagger, [t for t, _ in labelled]), strict=True):
        base = pii.base_spans(text)
        got = pii.reconcile(text, base, found, tagger.margin)
        assert set(base) <= set(got)
        more = set(spans) - set(base)
        hit, total, wrong = hit + len(more & set(got)), total + len(more), wrong + len(set(got) - set(base) - set(spans))
    assert total > 100 and hit / total > 0.7 and wrong < 0.1 * hit


def test_spans_of_any_length_and_place():
    """A stub that marks digits: spans longer than windows, at window borders and at a text's end come out whole."""
    class Stub(pii.Tagger):
        def read(self, x):
            digit = np.isin(x, [pii._CODE[c] for c in "0123456789"])
            em = np.zeros((*x.shape, pii._TAGS), np.float32)
            em[..., 0], em[..., 2] = np.where(digit, 0, 50), np.where(digit, 20, 0)
            return em

    stub = Stub()
    texts = ["a" * k + "5" * n + "b" * m for k in (0, 1, 170, 191, 192) for n in (3, 64, 500) for m in (0, 1, 200)]
    for t, found in zip(texts, pii.tag_texts(stub, texts), strict=True):
        assert [(f[2], f[3]) for f in found] == [(t.index("5"), t.rindex("5") + 1)]


def test_decoding_and_gradients_by_brute_force():
    from itertools import product

    r = np.random.default_rng(4)
    tagger = pii.Tagger()
    tagger.p["t"] = r.standard_normal((pii._TAGS, pii._TAGS)).astype(np.float32)
    em = r.standard_normal((4, 2, pii._TAGS)).astype(np.float32)
    tags = tagger.decode(em)
    total = lambda n, path: sum(em[i, n, k] for i, k in enumerate(path)) + sum(tagger.p["t"][a, b] for a, b in zip(path, path[1:]))
    paths = list(product(range(pii._TAGS), repeat=4))
    for n in range(2):
        assert tuple(tags[n]) == max(paths, key=lambda p: total(n, p))
    y = r.integers(0, pii._TAGS, (2, 4))
    loss = lambda: np.mean([np.log(sum(np.exp(total(n, p)) for p in paths)) - total(n, y[n]) for n in range(2)])
    ge, gt = tagger._crf(em.transpose(1, 0, 2).astype(float), y)
    for where in ((1, 0, 3), (2, 1, 5)):
        em = em.astype(float)
        em[where] += 1e-3
        up = loss()
        em[where] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(ge[where[1], where[0], where[2]], abs=1e-3)
        em[where] += 1e-3
    before = loss()
    tagger.p["t"] = tagger.p["t"].astype(float)
    tagger.p["t"][2, 3] += 1e-3
    assert (loss() - before) / 1e-3 == pytest.approx(gt[2, 3], abs=1e-3)
    assert np.allclose(tagger.read(np.arange(40).reshape(20, 2)), tagger.emissions(np.arange(40).reshape(20, 2).T).transpose(1, 0, 2), atol=1e-4)


def test_personal_data(spark, docs, empty):
    d = spark.createDataFrame([(1, "write to ann.b@mail.example.com or 10.0.0.1", "x"), (2, None, "y"), (3, "clean words and no more of it", "z"), (4, 'here is token = "0123456789abcdef0123456789abcdef01234567" and', "s")], "doc_id long, text string, n_email string")
    out = {r.doc_id: r for r in pii.find_personal_data(d).collect()}
    assert out[1].spans == "email:9:31,ip:35:43" and out[1].n_email == out[1].n_ip == 1
    assert out[1].base_sha256 == hashlib.sha256(out[1].spans.encode()).hexdigest() and out[2].spans == out[3].spans == ""
    assert out[4].n_secret == 1 and out[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(docs).count() == docs.count() and pii.find_personal_data(empty).count() == 0


def test_media_round_trip(docs, empty):
    rows = progressive_jpeg.store_texts(docs, keep_tensor=True).collect()
    want = {}
    for i, t, *_ in corpus():
        b = (t or "").encode()
        want[i] = b, b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
    assert len(rows) == len(corpus())
    for r in rows:
        raw, padded = want[r.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and len(r.rgb) == 3 * r.height * r.width
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in rows}) == len({p for _, p in want.values()})
    assert progressive_jpeg.store_texts(empty).count() == 0


def test_decoder_refines_new_coefficients_and_end_runs():
    """A hand-made image: three blocks in one interval, an end-of-block run, and a refinement that finds a new coefficient."""
    seg = progressive_jpeg._segment
    bits = lambda s: bytes(int(s.ljust(-(-len(s) // 8) * 8, "1")[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, b"\x08\0\x08\0\x18\x01\x01\x11\0")
    dc = seg(0xC4, b"\0" + bytes([0, 2] + [0] * 14) + bytes([0, 3]))  # 00: size 0, 01: size 3
    ac = seg(0xC4, b"\x10" + bytes([0, 3, 0, 0] + [0] * 12) + bytes([0x01, 0x10, 0x00]))  # 00: one coefficient, 01: end of two or three blocks, 10: end of block
    sos = lambda ss, se, a: seg(0xDA, bytes([1, 1, 0, ss, se, a]))
    data = head + dc + ac
    data += sos(0, 0, 0) + bits("01" "101" "00" "01" "010")  # 5, then 0, then -5
    data += sos(1, 63, 1) + bits("00" "1" "10" "01" "0")  # block 0: coefficient 1 = +1 << 1, end; blocks 1 and 2 end in a run of two
    data += sos(1, 63, 0x10) + bits("00" "0" "1" "10" "01" "0")  # block 0: coefficient 1 corrected by 1, then a new one, -1
    im = progressive_jpeg.Image(data + b"\xff\xd9")
    c, first = progressive_jpeg.coefficients([im])
    assert c[:, 0].tolist() == [5, 5, 0] and c[0, 1:4].tolist() == [3, -1, 0] and not c[1:, 1:].any()
    assert progressive_jpeg.rgb([im], c, first)[0].shape == (8, 24, 3)


def test_media_column(spark):
    good = progressive_jpeg.store([np.arange(128, dtype=np.uint8)])[0]
    r = np.random.default_rng(5)
    bad = [bytearray(good) for _ in range(60)]
    for b in bad:  # damage anywhere, frames of any size and components that aren't there among it
        for _ in range(4):
            b[r.integers(2, len(b))] = r.integers(0, 256)
    frame = good.index(b"\xff\xc2")
    bad.append(bytearray(good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :]))
    d = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), *((10 + i, bytes(b)) for i, b in enumerate(bad))], "id long, media binary")
    out = {r.id: r for r in progressive_jpeg.decode_column(d).collect()}
    assert len(out) == 3 + len(bad) and out[10 + len(bad) - 1].rgb is None
    assert (out[1].height, out[1].width) == (16, 16) and len(out[1].rgb) == 768 and out[2].rgb is None and out[3].rgb is None


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


def test_embedding_dedup_equals_brute_force(spark):
    r = np.random.default_rng(8)
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(120):
            rows.append((k, r.standard_normal(16), label))
            k += 1
        centre = r.standard_normal(16)
        for _ in range(90):
            rows.append((k, centre + 0.12 * r.standard_normal(16), label))
            k += 1
        rows += [(k + i, centre, label) for i in range(5)]
        k += 5
    data = [(i, [float(x) for x in v], c, "clash") for i, v, c in rows]
    odd = [(1000, None, 1, ""), (1001, [0.0] * 16, 1, ""), (1002, [float("nan")] * 16, 1, ""), (1003, [], 1, ""), (1004, data[0][1], None, ""), (1005, [None] * 16, 1, ""), (1006, [1.0], 1, "")]
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(vectors(spark, data + odd)).collect()}
    x = np.array([d[1] for d in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([d[2] for d in data])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    found = np.array([got[d[0]].n_links for d in data])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1007))
    assert all((g.component_id == g.vec_id) == g.kept for g in got.values())
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_windows_hand_on_a_spanning_forest():
    r = np.random.default_rng(3)
    for _ in range(20):
        i, j = r.integers(0, 50, (2, 30))
        parent = {k: k for k in range(50)}
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            union(parent, a, b)
        assert embedding_dedup._joined(50, i, j).tolist() == [find(parent, k) for k in range(50)]


def test_embedding_recall_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95 among unrelated vectors."""
    r = np.random.default_rng(12)
    rows = []
    for k in range(400):
        x, y = r.standard_normal((2, 24))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = r.uniform(0.931, 0.95)
        rows += [(2 * k, x.tolist(), 1, ""), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), 1, "")]
    got = {x.vec_id: x.component_id for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")).collect()}
    assert np.mean([got[2 * k] == got[2 * k + 1] for k in range(400)]) >= 0.9


def test_embedding_recall_in_a_clump(spark, monkeypatch):
    """A third of a label lies in a clump of loosely similar vectors: without more passes than even bits need, links are lost."""
    r = np.random.default_rng(21)
    d, n = 32, 2400
    centre = r.standard_normal(d)
    x = r.standard_normal((n, d))
    x[: n // 3] = centre / np.linalg.norm(centre) + 0.5 * x[: n // 3] / np.sqrt(d)
    near = r.integers(0, n // 3, 300)
    x[n // 3 : n // 3 + 300] = x[near] + 0.30 * r.standard_normal((300, d)) / np.sqrt(d)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = np.triu(x @ x.T >= 0.93, 1)
    rows = [(i, v.tolist(), 1, "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    got = {y.vec_id: y for y in embedding_dedup.near_duplicates(df).collect()}
    a, b = np.nonzero(true)
    assert len(a) > 300 and sum(y.n_links for y in got.values()) >= 2 * 0.95 * len(a)
    assert sum(y.n_links for y in got.values()) <= 2 * len(a)


def test_more_passes_follow_the_measured_recall():
    more = embedding_dedup.more_passes
    assert more(5, 0, 0) == 0 and more(5, 100, 97) == 0 and more(64, 100, 1) == 0
    assert more(5, 100, 90) == 3 and more(5, 100, 0) == 10 and more(60, 100, 10) == 4


def test_quality(spark, empty):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = sentence(r, 80) if good else " ".join(r.choice(["$$$", "!!", "BUY", "###"]) for _ in range(80))
        rows.append((i, t, "en", "good" if good and i % 5 else "mixed", len(t)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(900, None, None, None, None), (None, "text", "en", "x", 4), (5, rows[5][1], "en", "mixed", 9)]
    labels += [(900, 0, 0), (None, 1, 0), (7, None, 0), (1, 1, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(d, quality.train(d, y)).toPandas()
    seen = out[out.doc_id < 300]
    assert len(out) == len(rows) and (seen.kept == (seen.doc_id % 3 > 0)).mean() > 0.95
    assert quality.score(empty, quality.train(empty, y)).count() == 0
    assert set(quality.score(d, None).toPandas().score) == {0.5}


def test_stages(spark, docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    d = docs.select(*names)
    kept = corpus_pipeline.language_id(spark, d, "")
    rejected = {r.doc_id for r in d.collect()} - {r.doc_id for r in kept.collect()}
    assert kept.columns == names and rejected >= {i for i, t, *_ in corpus() if i is not None and not any(c.isalpha() for c in t or "")} and len(rejected) < 15
    assert all(r.lang for r in kept.collect())
    lines = corpus_pipeline.line_dedup(spark, kept, "")
    assert lines.columns == names and all(r.text.strip() for r in lines.collect())
    joined = corpus_pipeline.ngram_join(spark, kept, "")
    c = {r.doc_id for r in ngram_join.ngram_components(kept).collect() if r.doc_id == r.component_id}
    assert joined.columns == names and {r.doc_id for r in joined.collect()} == c | {None}
    mixed = corpus_pipeline.mixing(spark, joined, "")
    assert mixed.columns == names and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in joined.collect()}
    assert corpus_pipeline.packing(spark, mixed, "").count() > 0


@pytest.mark.parametrize("name", ["op8_mixing"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    got = sorted(tuple(round(float(x), 3) for x in r) for r in df.select(*sorted(df.columns)).collect())
    r = c.execute(queries.oracle_sql()[name])
    order = sorted(range(len(r.description)), key=lambda i: r.description[i][0])
    assert got == sorted(tuple(round(float(row[i]), 3) for i in order) for row in r.fetchall())


def test_pipeline_batches_are_bounded(spark):
    """Stages that read whole texts in Python get them in batches of BATCH rows, and a smaller setting stays; a worker has one encoder."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, docs = spark.conf.get(key), spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words of a text").alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.ngram_join, corpus_pipeline.packing):
            spark.conf.set(key, "10000")
            stage(spark, docs, "")
            assert docs.coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] == corpus_pipeline.BATCH
        spark.conf.set(key, "500")
        corpus_pipeline._batches(spark)
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, old)
    p = queries.byte_bpe()
    one = packing._fast(p["ranks_path"], p["pattern"], tuple(p["specials"].items()))
    assert one is packing._fast(p["ranks_path"], p["pattern"], tuple(p["specials"].items()))
