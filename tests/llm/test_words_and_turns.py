"""Spelling variants, conversation repair and language-model scores against brute force."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.llm import lm, repair, variants
from lexiclust.llm.wordhash import mix

# --- spelling variants ------------------------------------------------------


def one_edit(a, b):
    """By trying every edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(texts, min_length=6, min_count=5, ratio=5, damage_every=None):
    counts = Counter()
    for doc_id, t in texts:
        run = ""
        for ch in [*(t or ""), " "]:
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if damage_every and h % damage_every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                counts[run] += 1
            run = ""
    vocab = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    form, near = {}, {}
    for w, n in vocab.items():
        around = [v for v in vocab if one_edit(w, v)]
        near[w] = len(around)
        best = min(around, key=lambda v: (-vocab[v], v), default=None)
        if best is not None and vocab[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (n, near[w], form.get(w), vocab.get(form.get(w)), root(w)) for w, n in vocab.items()}


def found_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def letters_of(word, symbols):
    return tuple(int(mix(np.array([ord(c)], dtype=np.uint64))[0] % np.uint64(symbols)) + 1 for c in word)


def test_neighbourhood_is_every_reduced_word_within_one_edit():
    symbols, base = 3, 0x9E3779B97F4A7C15
    words = ["a", "bb", "abcdef", "éèé", "zzzzzzzz", "日本語abc"]
    ix, keys = variants.neighbourhood(words, symbols)
    for i, w in enumerate(words):
        r = letters_of(w, symbols)
        around = {r}
        for at in range(len(r) + 1):
            around |= {r[:at] + (c,) + r[at:] for c in range(1, symbols + 1)}
        for at in range(len(r)):
            around |= {r[:at] + r[at + 1:]} | {r[:at] + (c,) + r[at + 1:] for c in range(1, symbols + 1)}
        want = {sum(s * pow(base, j, 1 << 64) for j, s in enumerate(x)) % (1 << 64) for x in around}
        got = keys[ix == i].tolist()
        assert set(got) == want and len(got) == len(want)
        assert variants.reduced_keys([w], symbols)[0] in want


@pytest.mark.parametrize("options", [{}, {"bits": 6}, {"symbols": 2}, {"damage_every": 3}])
def test_variants_equal_brute_force(spark, options):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(25)]
    rows = []
    for i in range(120):
        said = []
        for _ in range(30):
            w = rng.choice(stems[:rng.choice([3, 25])])
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "À" + w[at + 1:]])
            said.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((i, " ".join(said)))
    rows += [(None, "aaaaaaa " * 6), (7, None), (8, ""), (9, rows[0][1]), (9, rows[0][1]),
             (10, "x" * 50_000 + " ×÷×÷×÷ ﬁﬁﬁﬁﬁﬁ 日本語日本語 " * 6)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows],
                               "doc_id long, text string, word string, n int").repartition(5)
    got = found_variants(variants.group_variants(df, **options))
    want = plain_variants(rows, damage_every=options.get("damage_every"))
    assert got == want and any(v[2] for v in got.values())


def test_variants_follow_chains_and_break_ties(spark):
    said = {"planter": 125, "plantor": 25, "plantir": 5, "blanter": 125, "flanter": 125}
    df = spark.createDataFrame([(i, " ".join([w] * n)) for i, (w, n) in enumerate(said.items())],
                               "doc_id long, text string")
    got = found_variants(variants.group_variants(df))
    assert got["plantir"][2:] == ("planter", 125, "planter")
    assert got["plantor"][2:] == ("planter", 125, "planter")
    assert got["planter"][2:] == (None, None, "planter") and got["planter"][1] == 4
    far = variants.roots(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)],
                                               "word string, form string"))
    assert {r.word: r.root for r in far.collect()} == {f"w{i}": "w9" for i in range(9)}


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(none).collect() == []
    short = spark.createDataFrame([(1, "abc " * 9), (2, None)], "doc_id long, text string")
    assert variants.group_variants(short).collect() == []
    with pytest.raises(ValueError):
        variants.group_variants(short, ratio=1)


# --- conversation repair ----------------------------------------------------

TURN = "conv_id long, turn long, role string, text string"


def plain_audit(rows):
    """Least cost, then least initials, by plain strings; rows are ``(initial, fault)``."""
    best = {0: (0, "")}

    def put(states, state, way):
        if state not in states or way < states[state]:
            states[state] = way

    def inserts(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                put(states, 3 if s == 2 else 2, (c + 2, a + "I"))
    inserts(best)
    for initial, fault in rows:
        after = {}
        for s, (c, a) in best.items():
            put(after, s, (c + 3, a + "D"))
            if fault in ("blank", "duplicate"):
                continue
            t = fault == "truncated"
            to = {"s": 1 if s == 0 else None, "u": 2 if s in (0, 1, 3) else None,
                  "a": 3 if s == 2 else None}.get(initial)
            if to:
                put(after, to, (c + t, a + "K"))
            put(after, 3 if s == 2 else 2, (c + 2 + t, a + "R"))
        inserts(after)
        best = after
    return min(best[s] for s in (0, 3) if s in best)


def run_repair(rows, decide_every):
    job, given = repair.Repair(), []
    for i, (initial, fault) in enumerate(rows):
        job.feed((i,), initial, fault)
        if (i + 1) % decide_every == 0:
            given += job.decided()
    cost, rest = job.finish()
    given += rest
    assert [r[0] for _, _, r in given if r is not None] == list(range(len(rows)))
    return cost, "".join(e for e, _, _ in given)


@pytest.mark.parametrize("collide", [False, True])
def test_audits_equal_brute_force(monkeypatch, collide):
    if collide:  # all hashes equal: every common prefix found must be put right by the walk
        monkeypatch.setattr(repair, "_MODULUS", 1)
    rng = random.Random(11)
    for n in [*range(9)] * 40 + [60, 200]:
        rows = [(rng.choice("suat "), rng.choice([None, None, None, "truncated", "blank", "duplicate"]))
                for _ in range(n)]
        assert run_repair(rows, rng.choice([1, 3, 1000])) == plain_audit(rows), rows


def test_all_short_conversations():
    kinds = [("s", None), ("u", None), ("a", None), ("u", "truncated"), ("a", "blank")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            assert run_repair(rows, 1) == plain_audit(rows)


def test_a_long_conversation_is_decided_as_it_goes():
    job, held = repair.Repair(), 0
    for i in range(20_000):
        job.feed((i,), "uaau"[i % 4], "truncated" if i % 3 else None)
        if i % 64 == 63:
            job.decided()
        held = max(held, len(job.rows))
    assert held <= 200


def test_paths_find_their_common_node():
    rng = random.Random(2)
    nodes = [repair.Node(None)]
    for _ in range(400):
        nodes.append(repair.Node(rng.choice(nodes[-40:]), rng.choice("KRDI")))

    def spelt(x):
        return "".join(y.edit for y in x.path(nodes[0]))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert repair.precedes(a, b) == (spelt(a) < spelt(b))
        pa, pb = a.path(nodes[0]), b.path(nodes[0])
        shared = [x for x, y in zip(pa, pb) if x is y]
        assert repair.common(a, b) is ([nodes[0]] + shared)[-1]


def test_repair_reports_and_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."),
            (1, 5, "user", "And"), (1, 6, "user", " \n"),
            (2, 0, "user", "Hi."), (2, 1, "assistant", "Yes!"),
            (3, None, None, None), (None, 2, "user", "lost?"), (4, 1, "", "x" * 100_000 + ".")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN + ", audit string, place int")
    edits = repair.repair(df).cache()
    got = {r.conv_id: r for r in repair.summaries(edits).collect()}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal) == (3, 1, 1, 1, 3)
    # s, (a), a repeated, u truncated, blank: an assistant's turn needs a user's before it
    assert (one.cost, one.audit) == plain_audit([("s", None), ("a", None), ("a", "duplicate"),
                                                 ("u", "truncated"), ("u", "blank")])
    turns = [(r.place, r.role, r.text) for r in repair.repaired(edits).where("conv_id = 1")
             .orderBy("place").collect()]
    said = "\n".join(f"{role}:{text}" for _, role, text in turns)
    assert hashlib.sha256(said.encode()).hexdigest() == one.repaired_sha256
    assert [t[1] for t in turns][0] == "system" and len(turns) % 2 == 1
    assert (got[2].cost, got[2].audit, got[2].illegal) == (0, "KK", 0)
    assert (got[3].gaps, got[3].blank, got[3].audit) == (0, 1, "D")
    assert got[None].truncated == 0 and got[None].audit == plain_audit([("u", None)])[1]
    assert got[4].audit == plain_audit([("", None)])[1]
    edits.unpersist()


def test_damage_and_conversations_of_which_nothing_is_left(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", "One. Two!") for i in range(300) for t in range(2)]
    bad = repair.damaged(spark.createDataFrame(rows, TURN))
    per_row = {(r.conv_id, r.turn): r for r in bad.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n"), F.first("text").alias("text"), F.first("role").alias("role"),
        F.first("present").alias("present")).collect()}
    for i, t, role, text in rows:
        h, r = zlib.crc32(f"{i}:{t}".encode()) % 20, per_row[i, t]
        assert r.present == (h != 0) and r.n == (2 if h == 3 else 1)
        assert r.text == ("" if h == 1 else "One Two" if h == 2 else text)
        assert r.role == ("user" if h == 4 else role)
    got = {r.conv_id: r for r in repair.summaries(repair.repair(bad, present="present")).collect()}
    assert set(got) == set(range(300))
    gone = [i for i in range(300) if not any(per_row[i, t].present for t in range(2))]
    for i in gone:
        assert got[i][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = repair.repair(spark.createDataFrame([], TURN))
    assert none.collect() == []


# --- language-model scores --------------------------------------------------


def plain_score(train, text, order, contexts=None):
    """Method D with exclusion, byte by byte, from dictionaries."""
    seen = {}
    for t in train:
        data = lm._framed(lm.words(t), order)
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen.setdefault(data[i - k:i], Counter())[data[i]] += 1
    if contexts is not None and len(seen) > contexts:
        totals = sorted((sum(c.values()) for c in seen.values()), reverse=True)
        seen = {x: c for x, c in seen.items() if sum(c.values()) > totals[contexts]}
    data, out = lm._framed(lm.words(text), order), 0.0
    for i in range(order, len(data)):
        excluded, found = set(), False
        for k in range(order, -1, -1):
            left = {b: n for b, n in seen.get(data[i - k:i], {}).items() if b not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if data[i] in left:
                out += math.log10((left[data[i]] - 0.5) / total)
                found = True
                break
            out += math.log10(0.5 * len(left) / total)
            excluded |= set(left)
        if not found:
            out -= math.log10(256 - len(excluded))
    return out


def some_texts(rng, n):
    known = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(30)] + ["Éa", "日本", "X-y."]
    return [" ".join(rng.choices(known, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("order,contexts", [(5, 1 << 16), (3, 1 << 16), (4, 60), (1, 5)])
def test_scores_equal_a_plain_model(spark, order, contexts):
    rng = random.Random(order)
    rows = [(i, t) for i, t in enumerate(some_texts(rng, 60))]
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, "unseen wörds"), (64, rows[0][1]), (64, rows[0][1]),
             (None, "abc"), (65, "ab " * 3000), (66, "a\x00b\x1cc")]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows],
                               "doc_id long, text string, word string, row int").repartition(3)
    got = lm.score_documents(df, F.col("doc_id") % 7 != 2, order=order, contexts=contexts).collect()
    assert len(got) == len(rows)
    train = [t for i, t in rows if i is not None and i % 7 != 2]
    counts = Counter(w for t in train for w in [*lm.words(t), b""])
    total, different = sum(counts.values()), len(counts)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        r = by_id[i][0]
        said = [*lm.words(t), b""]
        assert r.held_out == (i is None or i % 7 == 2)
        assert (r.n_tokens, r.train_tokens) == (len(said), total)
        assert r.n_known == sum(counts[w] > 0 for w in said)
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in said)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score == pytest.approx(plain_score(train, t, order, contexts), rel=1e-5, abs=1e-4)
    assert len(by_id[64]) == 2 and by_id[64][0].score == by_id[64][1].score


def test_a_context_leaves_no_probability_over():
    texts = [lm._framed(lm.words(t), 3) for t in some_texts(random.Random(1), 40)]
    keys, counts = np.unique(lm.grams(texts, 3), return_counts=True)
    ks, codes, ns = [], [], []
    for k in range(4):
        code, n = lm._merged([(keys & ((1 << 8 * (k + 1)) - 1), counts)])
        ks.append(np.full(len(code), k))
        codes.append(code)
        ns.append(n)
    trie = lm.build_trie(*map(np.concatenate, (ks, codes, ns)))
    assert np.allclose((10.0 ** trie.cost.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_building_the_trie_lays_out_only_the_bytes_that_occur():
    rng = random.Random(2)
    texts = [lm._framed([bytes(rng.choices(b"abcdefghijklmnop", k=30))], 3) for _ in range(1500)]
    keys, counts = np.unique(lm.grams(texts, 3), return_counts=True)
    levels = [lm._merged([(keys & ((1 << 8 * (k + 1)) - 1), counts)]) for k in range(4)]
    entries = (np.concatenate([np.full(len(c), k) for k, (c, _) in enumerate(levels)]),
               np.concatenate([c for c, _ in levels]), np.concatenate([n for _, n in levels]))
    tracemalloc.start()
    trie = lm.build_trie(*entries)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trie.step) > 4000 and trie.cost.shape == (len(trie.step), 256)
    assert peak < 8 * 256 * len(trie.step)
    assert trie.costs.nbytes + trie.step.nbytes < 256 * len(trie.step)


def test_postings_leave_in_small_batches(monkeypatch):
    monkeypatch.setattr(lm, "OUT_ROWS", 4)
    ends = np.array([0, 1, 2, 9, 10, 13, 14])
    parts = list(lm._slices(ends))
    assert [(p.start, p.stop) for p in parts] == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_scores_without_texts_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score_documents(rows, F.lit(None).cast("boolean")).collect()}
    assert got[1].score == pytest.approx(-5 * math.log10(256), rel=1e-6)
    assert (got[1].train_tokens, got[1].n_known, got[1].base_score) == (0, 0, 0.0)
    assert got[2].n_tokens == 1
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none, F.lit(True)).collect() == []
    with pytest.raises(ValueError):
        lm.score_documents(rows, F.lit(True), order=7)


def test_scores_learn_from_every_context(spark):
    rng = random.Random(11)  # more different contexts than any bound on a model's size had been
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(25)))
            for i in range(300)]
    rows += [(300, "qqqq " + rows[0][1][:200]), (301, rows[1][1]), (302, "zzz\x01 " + rows[2][1][100:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if i % 7 != 2]
    framed = [lm._framed(lm.words(t), 5) for t in train]
    assert len({f[i - k:i] for f in framed for i in range(5, len(f)) for k in range(6)}) > 1 << 16
    got = {r.doc_id: r.score for r in lm.score_documents(df, F.col("doc_id") % 7 != 2).collect()}
    for i in (2, 9, 300, 302):
        assert got[i] == pytest.approx(plain_score(train, rows[i][1], 5), rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("order", [5, 3, 1])
def test_scores_do_not_depend_on_the_tables_sent(spark, monkeypatch, order):
    rng = random.Random(order)
    rows = list(enumerate(some_texts(rng, 60))) + [(60, None), (61, ""), (63, "unseen wörds"), (None, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [t for i, t in rows if i is not None and i % 7 != 2]
    monkeypatch.setattr(lm, "PART_GRAMS", 100)
    monkeypatch.setattr(lm, "CHUNK", 500)
    got = {r.doc_id: r.score for r in lm.score_documents(df, F.col("doc_id") % 7 != 2, order=order).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(plain_score(train, t, order), rel=1e-5, abs=1e-4)


def test_a_table_of_costs_finds_what_it_holds():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    costs = rng.random(len(keys)).astype(np.float32)
    table = lm.cost_table(keys[::2], costs[::2])
    assert (lm.look_up(table, keys) == np.where(np.arange(len(keys)) % 2 == 0, costs, 0)).all()
    none = lm.cost_table(keys[:0], costs[:0])
    assert (lm.look_up(none, keys) == 0).all()


def test_no_table_of_words_is_broadcast_by_its_files_size(spark):
    words = [(f"{a}{b}{c}word", 9) for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    vocab = spark.createDataFrame(words, "word string, n long")
    docs = spark.createDataFrame([(1, " ".join(w for w, n in words for _ in range(n)))], "doc_id long, text string")
    for found in (variants.near_words(vocab), variants.group_variants(docs)):
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
