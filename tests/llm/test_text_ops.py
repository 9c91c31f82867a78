"""Language, quality, leaks, token counts and packing."""

import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexiclust.llm import decontaminate, langid, packing, quality, tokencount
from lexiclust.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"
ODD = ["", None, "\n", "x" * 30_000, "a  b\t\tc", "<|endoftext|>a<|startoftext|>", "it's WE'LL 1½",
       "日本語 テスト 🙂", "e\u0301 E\u0301 \u0130 \u03a3 \u212a", "***", "a\x1cb\x00c"]


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


# --- token counts -----------------------------------------------------------


def library_counts(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in rows], add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    random.seed(5)
    letters = ["a", "aa", "Ab", " ", "  ", "\n", "'s", "1", "½", "é", "日", "<|endoftext|>", "!!"]
    rows = ODD + ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(400)]
    df = texts(spark, rows).withColumn("tokens", F.lit("clash"))
    got = tokencount.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.tokens for r in got.collect()}
    for i, n in enumerate(library_counts(rows)):
        assert got[i].n_tokens == n, rows[i]
        assert got[i].n_bytes == len((rows[i] or "").encode())


def test_token_counts_with_a_tiny_cache():
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        table = tokencount.MergeTable(json.load(f))
    rows = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:40]
    counter = tokencount.Counter(table, cache_tokens=50)
    assert [n for t in rows for n in counter.counts([t])] == library_counts(rows)


# --- packing ----------------------------------------------------------------


def library_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_equal_the_library():
    random.seed(7)
    parts = ["a", "B", "é", "É", "Σ", "σ", "İ", "'", "'S", '"', ",", ".", "!", "***", " ", "\n", "\t",
             "<|startoftext|>", "<|STARTOFTEXT|>", "|", "1", "½", "\u0301", "\xa0", "_", "日", "\x1c"]
    rows = [t for t in ODD if t] + ["".join(random.choices(parts, k=25)) for _ in range(3000)]
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = f.read()
    whole = Tokenizer.from_str(spec).encode_batch(rows, add_special_tokens=False)
    for limit in (500_000, 64):
        got = packing.WordIds(spec, limit).encode(rows)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in whole]


def test_a_worker_keeps_the_words_it_met_last():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = f.read()
    words = packing.WordIds(spec, 64)
    letters = "abcdefghijklmnop"
    rows = [f"often {a}{b}q {b}{a}z" for a in letters for b in letters]
    asked, single = [], words._encode_single
    words._encode_single = lambda new: (asked.extend(new), single(new))[1]
    whole = Tokenizer.from_str(spec).encode_batch(rows, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for r in rows for g in words.encode([r])] == [
        e.ids for e in whole]
    assert len(words) <= words.limit and asked.count("often") == 1
    # a worker's share of an executor: two of them stand beside a full JVM
    assert packing.CACHE_WORDS <= 120_000


def test_words_of_plain_letters_skip_the_full_tokenizer():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        words = packing.WordIds(f.read())
    asked, tokenizer = [], words.tokenizer

    class Watched:
        model = tokenizer.model

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **more)

    words.tokenizer = Watched()
    rows = ["Zwölf quorbel, été!\nquorbel quorbel", "straße \u0142\u00f3d\u017a", None]
    got = [np.frombuffer(g, "<u4").tolist() for g in words.encode(rows)]
    assert [[*g, 1] for g in got] == [library_ids(t) for t in rows]
    assert asked and not any("quorbel" in t or "été" in t for t in asked)
    ids, ends = words.encode_flat(rows)
    assert ends.tolist() == np.cumsum([len(g) for g in got]).tolist() and len(ids) == ends[-1]


def test_patterns_place_every_length():
    random.seed(3)
    for cap in (8, 64, 2048):
        for _ in range(20):
            lengths = random.sample(range(1, cap + 1), k=min(cap, 40))
            histogram = {n: random.choice([1, 3, 1000]) for n in lengths}
            patterns = packing.shortest_pack_first(histogram, cap)
            placed = dict.fromkeys(histogram, 0)
            for p in patterns:
                assert p.count > 0 and sum(n * c for n, c in p.runs) <= cap
                for n, c in p.runs:
                    placed[n] += c * p.count
            assert placed == histogram
            assert len(patterns) <= 2 * len(histogram) + 1
    assert packing.shortest_pack_first({}, 8) == []
    # a lone short length shares sequences with itself
    assert sum(p.count for p in packing.shortest_pack_first({2: 1000}, 2048)) == 1


def check_packed(rows, cap=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap
    return by_sequence


def test_pack_documents_round_trip(spark):
    rows = ODD + ["word " * 5000, "same text", "same text", None]
    df = texts(spark, rows).withColumn("sequence_id", F.lit("clash"))
    df = df.unionByName(spark.createDataFrame([(None, "no key", "")],
                                              "doc_id long, text string, sequence_id string"))
    packed = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"))
    got = packed.collect()
    check_packed(got)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for i, t in [*enumerate(rows), (None, "no key")]:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()
        assert ids == library_ids(t) and {p.doc_tokens for p in pieces} == {len(ids)}
    sequences = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for sid, pieces in check_packed(got).items():
        used = sum(n for _, n in pieces)
        whole = sequences[sid]
        assert whole.tokens == used
        assert len(whole.ids) == 4 * (used if used & (used - 1) == 0 else 2048)


def test_pack_query_and_stage_carry_ids(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 40)
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs.to_pylist()],
                               "doc_id long, text string")
    packed = corpus_pipeline.pack(spark, df, SF)
    pieces = packed.collect()
    by_sequence = check_packed(pieces)
    got = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert got.keys() == by_sequence.keys()
    for r in pieces:
        whole = bytes(got[r.sequence_id].ids)
        assert whole[4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    for r in docs.to_pylist():
        mine = sorted((p for p in pieces if p.doc_id == r["doc_id"]), key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in mine), "<u4").tolist()
        assert ids == library_ids(r["text"])
    plan = QUERIES["op6_pack"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "crc32(ids" in plan.splitlines()[0]


def test_pack_one_hot_length_and_an_empty_table(spark):
    hot = spark.range(5000).select(F.col("id").alias("k"), F.lit(700).cast("long").alias("length"))
    got = packing.pack(hot, ["k"]).collect()
    assert len(got) == 5000 and len(check_packed(got)) == 2500
    assert packing.pack(hot.limit(0), ["k"]).collect() == []
    with pytest.raises(ValueError):
        packing.pack(hot.withColumn("length", F.lit(0).cast("long")), ["k"])


# --- leaks ------------------------------------------------------------------


def brute_leaks(docs, items, window=10):
    windows = {}
    for item_id, t in items:
        w = decontaminate.words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i:i + window]), set()).add(item_id)
    out = []
    for t in docs:
        w = decontaminate.words(t)
        hit, names = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i:i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), len(hit), sorted(x for x in names if x is not None)))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_leaks_equal_brute_force(spark, shard_bytes):
    random.seed(11)
    vocab = [f"w{i}" for i in range(12)] + ["É", "x1"]
    say = lambda n: random.choice([" ", "--", "\n"]).join(random.choices(vocab, k=n))
    items = [("1", say(25)), ("2", say(12)), ("3", "short one"), ("4", None), ("5", "..."),
             ("1", say(11)), (None, "null id item"), ("6", say(10))]
    docs = [None, "", "Short, ONE! and short one", "a null id item", "x" * 20_000]
    docs += [f"{say(5)} {random.choice(items[:3])[1]} {say(3)} W3" for _ in range(60)]
    docs += [say(400) for _ in range(10)]
    df = texts(spark, docs).withColumn("leaks", F.lit("clash")).withColumn("leak_row", F.lit("mine"))
    item_df = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find_leaks(df, item_df, shard_bytes=shard_bytes).orderBy("doc_id").collect()
    want = brute_leaks(docs, items)
    assert [(r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) for r in got] == want
    assert {r.leak_row for r in got} == {"mine"}
    again = decontaminate.find_leaks(df.unionByName(df), item_df, shard_bytes=shard_bytes)
    assert again.count() == 2 * len(docs)
    assert again.distinct().count() == len(docs)
    for r, t in zip(got, docs, strict=True):
        marked = sum(len(decontaminate.words(t[s.start:s.end])) for s in r.leaks.spans)
        assert marked == r.leaks.n_hit


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    docs = texts(spark, ["a b c", None])
    assert [r.leaks.n_hit for r in decontaminate.find_leaks(docs, none).collect()] == [0, 0]
    assert decontaminate.find_leaks(docs.limit(0), none).count() == 0


# --- language ---------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_backoff_and_odd_rows(spark):
    rows = [(i, "der hund und die katze schlafen" if i % 2 else "the dog and the cat sleep",
             "de" if i % 2 else "en") for i in range(1, 60)]
    rows += [(100, None, "de"), (101, "text without language", None), (None, "the dog", "en")]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.fit(docs)
    assert model.langs == ["de", "en"] and "hund" in model.words
    asked = spark.createDataFrame(
        [(0, None), (1, ""), (2, "1234 ..."), (3, "hunde schlafend"), (4, "sleeping dogs and cats"),
         (5, "the " * 30_000), (6, "żółć")], "doc_id long, text string").withColumn(
        "language", F.lit("clash"))
    got = {r.doc_id: r.language for r in langid.predict(asked, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und", "und", "und", "de", "en", "en"]
    assert got[0].score == 0.0 and got[5].score > 0.99
    assert got[6].lang_pred in ("de", "en")
    # an unseen word: the mean over its longest known n-grams, checked by hand
    grams = {g: model.gram_rows[n] for g, n in model.grams.items()}
    known = [grams[f"_{'hunde'}_"[i:i + 4]] for i in range(4) if "_hunde_"[i:i + 4] in grams]
    assert np.allclose(model.backoff(["hunde"])[0], np.mean(known, axis=0))


def plain_language_scores(train, texts):
    """Word-first backoff spelled out: natural logs of smoothed frequencies, a word
    met less than twice takes the mean over its longest n-grams that are known."""
    find = regex.compile(langid.WORD).findall
    langs = sorted({x for _, x in train})
    words = {x: Counter() for x in langs}
    for text, x in train:
        words[x].update(find(text.lower()))
    grams = {x: [Counter() for _ in range(langid.MAX_GRAM + 1)] for x in langs}
    for x in langs:
        for w, n in words[x].items():
            e = f"_{w}_"
            for size in range(1, langid.MAX_GRAM + 1):
                for i in range(len(e) - size + 1):
                    grams[x][size][e[i:i + size]] += n

    def logs(tables):
        known = {k for t in tables for k in t if sum(u[k] for u in tables) >= langid.MIN_COUNT}
        sums = [sum(t[k] + langid.SMOOTHING for k in known) for t in tables]
        return {k: [math.log((t[k] + langid.SMOOTHING) / s)
                    for t, s in zip(tables, sums, strict=True)] for k in known}
    by_word = logs([words[x] for x in langs])
    by_size = [logs([grams[x][size] for x in langs]) for size in range(langid.MAX_GRAM + 1)]

    def of_word(w):
        if w in by_word:
            return by_word[w]
        e = f"_{w}_"
        for size in range(min(langid.MAX_GRAM, len(e)), 0, -1):
            got = [by_size[size][e[i:i + size]] for i in range(len(e) - size + 1)
                   if e[i:i + size] in by_size[size]]
            if got:
                return [sum(v) / len(got) for v in zip(*got, strict=True)]
        return [0.0] * len(langs)
    out = []
    for text in texts:
        found = find(text.lower()) if text else []
        if not found:
            out.append(("und", 0.0))
            continue
        total = [sum(v) for v in zip(*map(of_word, found), strict=True)]
        best = max(range(len(langs)), key=lambda n: (total[n], -n))
        out.append((langs[best], 1 / sum(math.exp(v - total[best]) for v in total)))
    return out


def test_language_equals_a_plain_scorer(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    train = [(r["text"], r["lang"]) for r in rows
             if not held(r) and r["lang"] is not None and r["text"] is not None]
    want = plain_language_scores(train, [r["text"] for r in rows])
    got = {r.doc_id: r for r in QUERIES["op3_language"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (lang, score) in zip(rows, want, strict=True):
        assert got[r["doc_id"]].lang_pred == lang
        assert got[r["doc_id"]].score == pytest.approx(score, abs=1e-6)


def test_rare_languages_are_learnt_from_large_tables(spark):
    assert langid.even_shares({"a": 3, "b": 1000, "c": 4000}, 103) == {
        "a": 1.0, "b": 0.05, "c": 0.0125}
    assert langid.even_shares({"a": 3, "b": 7}, 100) == {"a": 1.0, "b": 1.0}
    rows = [(i, f"the dog number w{i % 50} and the cat sleep", "en") for i in range(3000)]
    rows += [(i, "kissa ja koira nukkuvat kissa ja koira", "fi") for i in range(3000, 3006)]
    docs = spark.createDataFrame(rows + rows[:5], DOC)  # repeated rows count each time
    model = langid.fit(docs, train_rows=60, max_words=12, max_grams=40)
    assert model.langs == ["en", "fi"]
    assert {"kissa", "koira", "the", "and"} <= set(model.words)
    asked = spark.createDataFrame([(0, "koira nukkuu"), (1, "dogs sleep")], "doc_id long, text string")
    got = {r.doc_id: r.language.lang_pred for r in langid.predict(asked, model).collect()}
    assert got == {0: "fi", 1: "en"}


def test_language_without_rows(spark):
    docs = spark.createDataFrame([(1, "a word", None)], DOC)
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert got[0].language.lang_pred == "und"
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


# --- quality ----------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op1_quality"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_quality_votes_equal_brute_force():
    rows = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()
    counts = quality.term_counts(rows[:120])
    model = quality.LatentModel(counts, np.arange(120) % 3 == 0, dimensions=16)
    got = model.scores(rows[120:160], neighbours=7, power=2.0)
    vectors = model.embed(quality.term_counts(rows[120:160]))
    for v, s in zip(vectors, got, strict=True):
        cosines = np.maximum(model.vectors @ v, 0).astype(float)
        best = np.argsort(-cosines)[:7]
        assert s == pytest.approx((cosines[best] ** 2 * model.labels[best]).sum()
                                  / (cosines[best] ** 2).sum(), abs=1e-5)


def test_quality_of_odd_rows(spark):
    docs = texts(spark, [None, "", "good plain words here", "X!! X!! X!!", "a " * 40_000]
                 + ["good plain words"] * 20 + ["BAD!! BAD!!"] * 20).withColumn(
        "quality_score", F.lit("clash"))
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(5, 25)] + [(i, 0, 0) for i in range(25, 45)]
        + [(2, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert got[0] == got[1] == pytest.approx(model.prior)
    assert got[2] > 0.5 > got[30] and all(0 <= s <= 1 for s in got.values())
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.quality_score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), nothing).count() == 0
