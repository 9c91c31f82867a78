"""Near duplicates, neighbours, pages, urls, chats and the pipeline."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiclust.llm import chat, extract, neardup, neighbours, urlfilter
from lexiclust.llm.components import connected_components

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------


def brute_groups(rows, threshold=85):
    sets = [set(s.tolist()) for s in neardup.shingle_sets([t for _, t in rows])]
    parent = {k: k for k, _ in rows if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(k, len(s), root(k) if k is not None else None)
            for (k, _), s in zip(rows, sets, strict=True)]


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10 ** 6)}"
    return " ".join(out)


@pytest.mark.parametrize("list_length", [128, 4])
def test_near_duplicates_equal_brute_force(spark, list_length):
    rng = random.Random(2)
    fresh = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    base, passage = fresh(150), fresh(60)
    rows = [(None, "no key at all"), (0, None), (1, ""), (2, " \n\t"), (3, "two words"),
            (4, "Two  WORDS"), (5, "two words more"), (6, "x " * 20_000)]
    texts = [edited(base, rng.randrange(0, 8), rng) for _ in range(60)]  # a group of near copies
    texts += [" ".join(base)] * 10  # of exact copies
    texts += [" ".join(passage + fresh(rng.randrange(2, 60))) for _ in range(40)]  # a shared passage
    texts += [" ".join(fresh(80)) for _ in range(30)]
    rng.shuffle(texts)
    rows += [(100 + 7 * i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "component_id", F.lit("clash"))
    got = neardup.near_duplicates(df.repartition(5), list_length=list_length).collect()
    want = brute_groups(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == \
        sorted(want, key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("threshold", [80, 50])
def test_near_duplicates_at_lower_thresholds(spark, threshold):
    rng = random.Random(threshold)
    base = [f"b{i}" for i in range(120)]
    texts = [edited(base, rng.randrange(0, 12), rng) for _ in range(60)]
    for k in range(40):  # pairs about the threshold
        one = [f"w{k}_{i}" for i in range(100)]
        texts += [" ".join(one), edited(one, 1 + k % 9, rng)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for list_length in (128, 4):
        got = neardup.near_duplicates(df, threshold=threshold, list_length=list_length).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == \
            sorted(brute_groups(rows, threshold))


def test_near_duplicate_parameters_follow_the_threshold(spark):
    least = lambda t, n=32: neardup.shared_at_least(n, t, neardup.MISSED_MATCHES)
    assert least(85) == 15 and neardup.later_rounds(85) == [(20, 3), (60, 8)]
    assert neardup.shared_at_least(18, 85, neardup.MISSED_LISTS) == 5
    for t in (40, 50, 60, 70, 80, 85, 90, 99):
        m = least(t)
        p = t / 100
        assert 1 <= m <= least(min(99, t + 5))
        assert sum(math.comb(32, n) * p ** n * (1 - p) ** (32 - n) for n in range(m)) <= 1e-7
        assert all((1 - p ** w) ** n <= 5.4e-9 for n, w in neardup.later_rounds(t))
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"),
                                threshold=10)


def test_near_duplicates_of_repeated_keys_and_no_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (2, b), (9, a), (9, b), (5, c), (5, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (5, 5), (5, 5), (9, 1), (9, 1)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    loops = path.union(path.select("b", "a")).union(path.select("a", "a"))
    got = connected_components(loops).collect()
    assert len(got) == 201 and {r.component for r in got} == {0}
    assert connected_components(path.limit(0)).count() == 0


# --- neighbours -------------------------------------------------------------


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        scored = []
        for i, v in rows.items():
            if i != q and len(v) == len(rows[q]):
                s = 0.0
                for x, y in zip(rows[q], v, strict=True):
                    s += float(np.float32(x)) * float(np.float32(y))
                scored.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = {i: rng.normal(size=8).round(2).tolist() for i in range(300)}
    for i in range(100, 180):
        rows[i] = rows[0]  # ties
    rows |= {500 + i: rng.normal(size=5).tolist() for i in range(4)}  # another dimension
    bad = [(600, None), (620, [0.0] * 8), (640, [1.0, None] + [0.0] * 6),
           (660, [float("nan")] + [1.0] * 7), (680, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([*rows.items(), *bad, (7, rows[7])],
                               "vec_id long, embedding array<float>")
    df = df.withColumn("score", F.lit("clash"))
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=6, block=block, query_block=7,
                             parts=3).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(by_query[r.query_id])
    assert by_query == brute_nearest(rows, [i for i in rows if i % 20 == 0], 6)


def test_nearest_among_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


# --- pages ------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">home</a></li></ul></nav><!-- <article>no</article> -->
<div class="ad">buy this now please</div><article><h1>Head &amp; line</h1><p>First   <b>bo</b>ld<br>next
&#233;&nbsp;x<p>a < b<aside>not this</aside></p><ul><li>one<li>two <a href='x>y'>link</a></ul>
<form>mail <input></form><div class="comments"><p>reader said</p></div><p>Last.</p></article>
<div class="sidebar"><p>more of it</p></div><footer>&copy; all rights and many more words</footer>"""


def labelled(n):
    return [f"<html><body><nav><a>menu {i} here now</a></nav><div class='ad'>advert text is here</div>"
            f"<article><h1>h {i}</h1><p>words of the article {i}</p><p>and more</p></article>"
            "<footer>foot line here</footer></body></html>" for i in range(n)]


def test_extract_main_text(spark):
    pages = [PAGE, None, "", "plain &lt;text&gt;", "<p>only", "<script>x", PAGE, "<nav>a b</nav>",
             "<article>" + "w " * 20_000 + "</article><footer>x</footer"] + labelled(30)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    df = df.withColumn("main_text", F.lit("clash"))
    model = extract.fit(df)
    assert model.words["nav"] < 0 < model.words["article"] and model.words["div.ad"] < 0
    got = {r.page_id: r.main_text for r in extract.extract(df, model).collect()}
    assert got[0] == got[6] == ("Head & line\nFirst bold\nnext é x\na < b\none\ntwo link\nLast.")
    assert [got[i] for i in (1, 2, 3, 4, 5, 7)] == ["", "", "plain <text>", "only", "", ""]
    assert got[8] == " ".join(["w"] * 20_000)
    assert got[9] == "h 0\nwords of the article 0\nand more"


def test_extract_without_labels(spark):
    df = spark.createDataFrame([(1, "<div class='menu'>a b</div><div><p>text here</p></div>")],
                               "page_id long, html string")
    model = extract.fit(df.limit(0))
    assert [r.main_text for r in extract.extract(df, model).collect()] == ["text here"]
    assert extract.extract(df.limit(0), model).count() == 0


BODY = "<h2 class='section-heading'>Part one</h2><p>words of the story here</p>"
WANTED = "Part one\nwords of the story here"


@pytest.mark.parametrize("page", [
    f"<div id='content-sidebar-wrap'><article>{BODY}</article></div>",
    f"<div class='has-sidebar'><article>{BODY}</article></div>",
    f"<div class='sidebar'><div><article>{BODY}</article></div></div>",
    f"<article class='post comments-open'>{BODY}</article>",
    f"<article class='widget'>{BODY}</article>",
    f"<div role='search'><article>{BODY}</article></div>",
    f"<div role='search'><div role='main' class='menu'>{BODY}</div></div>",
    f"<main class='has-sidebar'><div class='search'><article>{BODY}</article></div></main>",
    f"<form action='x'><article>{BODY}</article></form>",
    f"<article><section id='related-work'>{BODY}</section></article>",
    f"<div class='has-sidebar'>{BODY}</div>",
    f"<div id='content-sidebar-wrap'><div class='header-2-content'>{BODY}</div></div>",
    f"<article>{BODY}<div id='comments-area'><article class='comment'>no</article></div></article>",
    f"<article>{BODY}</article><div class='comments'><article class='comment'>no</article></div>",
    f"<article>{BODY}<div class='share-buttons'>no</div><p class='ad-300'>no</p></article>",
])
def test_wrappers_named_like_no_content_lose_nothing(page):
    learnt = collections.Counter()
    for p in labelled(30):
        learnt += extract.places(p)
    head = "<html><body class='nav-open'><nav>menu a b</nav>"
    foot = "<footer>foot line</footer></body></html>"
    for model in (extract.RegionModel(learnt), extract.RegionModel({})):
        assert model.extract(head + page + foot) == WANTED


def test_learnt_weights_go_before_class_words():
    page = "<div class='notice'><p>real words of a page</p></div>"
    counts = {("word", "div.notice", True): 100}
    assert extract.RegionModel(counts).extract(page) == "real words of a page"
    assert extract.RegionModel({}).extract(page) == ""


def test_region_is_the_best_subsequence():
    """The scan's region against all contiguous ones."""
    model = extract.RegionModel({("word", "nav", False): 100, ("word", "article", True): 100,
                                 ("tag", "p", True): 50, ("tag", "li", False): 50})
    page = "<nav>a b c</nav><p>one two</p><li>x<li>y<p>three four five</p><nav>d e f g</nav>"
    assert model.extract(page) == "one two\nx\ny\nthree four five"


# --- urls -------------------------------------------------------------------

RULES = [urlfilter.Rule("allow", "com/"), urlfilter.Rule("block", "example.com/en/"),
         urlfilter.Rule("allow", "www.example.com/en/"), urlfilter.Rule("block", "net/es/"),
         urlfilter.Rule("block", "net/fr/")]


def brute_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls_equal_brute_force(spark):
    rng = random.Random(6)
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "x://a://b.com/c",
            "HTTP://WWW.Example.COM/en/1?q#f", "http://example.com#/en/", "http://xexample.com/en/",
            "http://É.com/\n/x", "http://a..com/", "http://www.example.com/en/" + "p" * 9000,
            "http://" + "a." * 40_000 + "net/es/", "http://.net/es/", "http://net./es/"]
    hosts = ["com", "net", "example.com", "www.example.com", "a.b.example.com", "x.net", "org"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/es/', '/fr/x', '/e'])}"
             f"{rng.choice(['', '?a=/en/', '#x'])}" for _ in range(200)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    df = df.withColumn("judged", F.lit("clash")).withColumn("_h", F.lit("clash too"))
    df = df.withColumn("URL_parts", F.lit("and this"))
    rows = urlfilter.judge(df, RULES).collect()
    got = {r.page_id: tuple(r.judged) for r in rows}
    for i, u in enumerate(urls):
        assert got[i] == brute_judge(u, RULES), u
    assert {(r["_h"], r["URL_parts"]) for r in rows} == {("clash too", "and this")}
    assert rows[0].asDict().keys() == {"page_id", "url", "judged", "_h", "URL_parts"}
    none = {tuple(r.judged)[2:] for r in urlfilter.judge(df, []).collect()}
    assert none == {(None, "allow")}
    assert urlfilter.judge(df.limit(0), RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    """Many keys, so that several levels are needed."""
    from lexiclust.llm.common import stored
    universe = stored(spark.range(200_000).select(F.xxhash64("id").alias("key")), "universe")
    keys = universe.toArrow().column("key").to_numpy()
    listed = keys[::100].copy()
    cascade = urlfilter.build_cascade(universe, listed)
    assert len(cascade.levels) >= 3
    assert set(keys[cascade.listed(keys)].tolist()) == set(listed.tolist())


# --- chats ------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] <|turn|> <\|turn|>", "", None, "<|image|>",
            "<</s>[", "é" * 20_000, "<|body|>\n</s", "plain"]
    roles = ["user", "assistant", None, "system", "assistant", "assistant</s>", "user", "assistant"]
    rows = [(c, t, roles[(c + t) % 8], said[(c * 3 + t) % 9]) for c in range(12) for t in range(c + 1)]
    rows += [(None, 0, "assistant", "no id"), (3, None, "assistant", "null turn"), (3, 2, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("segment", F.lit("clash"))
    segments = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    by_conv = {}
    segment_of = {}
    for r in segments.collect():
        segment_of.setdefault((r.conv_id, r.turn), []).append(r.segment)
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        esc = lambda x: __import__("re").sub(chat.ESCAPE, r"\1\\\2\3", x)
        turns.sort(key=lambda x: (x[0], x[1], f"{chat.TURN}{esc(x[2])}{chat.BODY}{esc(x[3])}{chat.END}"))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        chars = sum(len(s) for (conv, _), ss in segment_of.items() if conv == c for s in ss)
        assert tuple(got[c])[1:] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                                     hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = chat.PART
    rows = [(1, 0, "user", [("text", "look </s>", None, None), ("image", None, "a.png", 4),
                            ("audio", None, "b.wav", None), ("text", "done", None, None),
                            (None, "untyped", None, None), ("document", None, "c.pdf", 2)]),
            (1, 1, "assistant", [("text", "fine", None, None)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    got = chat.format_turns(df, content=F.col("parts")).orderBy("turn").collect()
    assert got[0].segment == ("<|turn|>user<|body|>look <\\/s><|image|><|audio|>doneuntyped"
                              "<|document|></s>")
    assert [tuple(a) for a in got[0].attachments] == [
        ("image", "a.png", 1024), ("audio", "b.wav", 25), ("document", "c.pdf", 1024)]
    assert got[0].placeholder_tokens == 1024 + 25 + 1024
    assert got[1].segment[got[1].loss_start:got[1].loss_end] == "fine"
    assert got[2].segment == "<|turn|>user<|body|></s>"


# --- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(
        [(10_001, None, "en", "s", 0), (10_002, "", "en", "s", 0), (10_003, "12 34", "en", "s", 5),
         (None, docs.first().text, "fr", "s", 1)], docs.schema)
    copies = docs.limit(3)
    docs = docs.unionByName(extra).unionByName(copies).withColumn("kept", F.lit("extra"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            gone = docs.count() - out.count()
            assert gone >= 0
        counts.append((name, out.count()))
        docs = out.checkpoint()
        if name == "language_id":
            assert not docs.where(F.col("doc_id").between(10_001, 10_003)).count()
        if name == "near_dedup":
            assert docs.where("doc_id is null").count() == 1
            assert docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert [n for n, _ in counts] == ["language_id", "quality", "near_dedup", "decontamination", "packing"]
    assert counts[-1][1] > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_drops_near_copies_at_80_percent(spark):
    one = [f"w{i}" for i in range(200)]
    two = list(one)
    for i in (20, 70, 120, 170):
        two[i] = "other"
    a, b = (set(x.tolist()) for x in neardup.shingle_sets([" ".join(one), " ".join(two)]))
    assert 0.80 < len(a & b) / len(a | b) < 0.82
    docs = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, "another text")],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == [1, 3]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_of_no_rows(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, SF).count() == 0
