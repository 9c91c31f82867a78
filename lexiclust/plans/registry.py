"""Registered queries: one per operator of the inventory, each over whole
test tables. Keys match ``lexiclust.plans.oracles.ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiclust.functions.text import LATIN_ACCENTED, MACEDONIAN
from lexiclust.operators import text as textops
from lexiclust.plans.inputs import Inputs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

HEAD_LINES = 5000
TOP_VOCAB = 200_000


def query(name: str):
    def deco(fn):
        _QUERIES[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    from lexiclust.plans.checks import round_df

    from lexiclust.session import ship_package

    def wrap(name, fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return round_df(name, fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        return run
    return {name: wrap(name, fn) for name, fn in _QUERIES.items()}


# ---------------------------------------------------------------------------
# Text


@query("clean_lines")
def q_clean_lines(spark, sf_dir):
    """clean-text without a language filter: kept lines in corpus order."""
    return Inputs(spark, sf_dir).clean()


@query("clean_counters")
def q_clean_counters(spark, sf_dir):
    return textops.clean_counters(Inputs(spark, sf_dir).raw_lines())


@query("dedup_lines")
def q_dedup_lines(spark, sf_dir):
    """Distinct normalised lines with their first occurrence and copy count."""
    inp = Inputs(spark, sf_dir)
    df = textops.min_length(textops.normalize_lines(inp.raw_lines()))
    return textops.dedup_lines(df, with_copies=True)


@query("head_lines")
def q_head_lines(spark, sf_dir):
    return textops.head_lines(Inputs(spark, sf_dir).raw_lines(), HEAD_LINES)


@query("min_length")
def q_min_length(spark, sf_dir):
    return textops.min_length(textops.normalize_lines(Inputs(spark, sf_dir).raw_lines()))


@query("language_filter")
def q_language_filter(spark, sf_dir):
    """clean-text with the Latin profile (accented letters as the marker)."""
    return textops.clean_lines(Inputs(spark, sf_dir).raw_lines(), profile=LATIN_ACCENTED)


@query("language_filter_mk")
def q_language_filter_mk(spark, sf_dir):
    """clean-text with the Macedonian profile, over the corpus in Cyrillic letters."""
    return textops.clean_lines(Inputs(spark, sf_dir).cyrillic_lines(), profile=MACEDONIAN)


@query("tokenize")
def q_tokenize(spark, sf_dir):
    return Inputs(spark, sf_dir).tokens()


@query("token_counts")
def q_token_counts(spark, sf_dir):
    return textops.token_counts(Inputs(spark, sf_dir).tokens()).select(
        "token", F.col("n").cast("long").alias("n"))


@query("top_vocab")
def q_top_vocab(spark, sf_dir):
    return textops.top_vocab(Inputs(spark, sf_dir).tokens(), TOP_VOCAB)


# ---------------------------------------------------------------------------
# Vectors and k-means

EMB_K = 10
CAP_WORDS = 20_000
GRID_K = (5, 10, 20)


def _round_vec(df, col="vec"):
    from lexiclust.functions.vector import round_array
    return df.withColumn(col, round_array(col, 6))


def _embedding_run(spark, sf_dir, rounds, stop_early=False, k=EMB_K, seed=42):
    from lexiclust.operators import kmeans as km
    from lexiclust.operators.vectors import l2_normalize
    vs = l2_normalize(Inputs(spark, sf_dir).embedding_vectors())
    fit = km.spherical_kmeans(vs, [k], seed=seed, max_iter=rounds, stop_early=stop_early)
    lab = km.predict(vs, fit.centroids)
    return lab.select("slug", F.lit("parallel").alias("method"), "k", "word", "cluster"), fit


@query("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    from lexiclust.operators.vectors import l2_normalize
    return _round_vec(l2_normalize(Inputs(spark, sf_dir).embedding_vectors()))


@query("parse_vectors")
def q_parse_vectors(spark, sf_dir):
    """The embeddings written as ``.vec`` lines and read back."""
    from lexiclust.sources import vectors as sv
    lines = sv.render_vectors(Inputs(spark, sf_dir).embedding_vectors(), digits=12)
    return _round_vec(sv.parse_vectors(lines, "embeddings"))


@query("context_vectors")
def q_context_vectors(spark, sf_dir):
    return _round_vec(Inputs(spark, sf_dir).context_vectors())


@query("cap_rank")
def q_cap_rank(spark, sf_dir):
    from lexiclust.operators.vectors import cap_rank
    return cap_rank(Inputs(spark, sf_dir).context_vectors(), CAP_WORDS).select("slug", "rank", "word")


@query("restrict_to_vocab")
def q_restrict_to_vocab(spark, sf_dir):
    """Document-vocabulary vectors kept to the words of the conversations."""
    from lexiclust.operators.vectors import restrict_to_vocab
    inp = Inputs(spark, sf_dir)
    return restrict_to_vocab(inp.context_vectors(), inp.conversation_tokens().select("token")).select(
        "slug", "rank", "word")


@query("restrict_fallback")
def q_restrict_fallback(spark, sf_dir):
    """A toplist that matches nothing (conversation tokens behind a '#',
    which cleaned text cannot hold) keeps every vector."""
    from lexiclust.operators.vectors import restrict_to_vocab
    inp = Inputs(spark, sf_dir)
    lst = inp.conversation_tokens().select(F.concat(F.lit("#"), "token").alias("token"))
    return restrict_to_vocab(inp.context_vectors(), lst).select("slug", "rank", "word")


@query("known_words")
def q_known_words(spark, sf_dir):
    """Assignments of a run over the whole document vocabulary, kept to the
    words that also have a vector in the conversation-restricted set."""
    from lexiclust.operators import kmeans as km
    from lexiclust.operators.vectors import known_words, restrict_to_vocab
    inp = Inputs(spark, sf_dir)
    cv = inp.context_vectors()
    fit = km.spherical_kmeans(cv, [EMB_K], seed=42, max_iter=1, stop_early=False)
    asg = km.predict(cv, fit.centroids).select("slug", F.lit("parallel").alias("method"), "k", "word", "cluster")
    small = restrict_to_vocab(cv, inp.conversation_tokens().select("token"))
    return known_words(asg, small)


@query("nearest_centroid")
def q_nearest_centroid(spark, sf_dir):
    """Every unit embedding to the nearest of the K start centroids."""
    asg, _ = _embedding_run(spark, sf_dir, rounds=0)
    return asg


@query("kmeans_round1")
def q_kmeans_round1(spark, sf_dir):
    return _embedding_run(spark, sf_dir, rounds=1)[0]


@query("kmeans_round3")
def q_kmeans_round3(spark, sf_dir):
    return _embedding_run(spark, sf_dir, rounds=3)[0]


@query("kmeans_converged")
def q_kmeans_converged(spark, sf_dir):
    """M1 until the all-close test holds (at most 100 rounds)."""
    return _embedding_run(spark, sf_dir, rounds=100, stop_early=True)[0]


@query("centroid_mean")
def q_centroid_mean(spark, sf_dir):
    from lexiclust.operators.vectors import centroid_mean
    asg, _ = _embedding_run(spark, sf_dir, rounds=1)
    vs = Inputs(spark, sf_dir).embedding_vectors()
    out = centroid_mean(asg, vs, k_of_run=asg.select("slug", "method", "k").distinct()
                        .withColumn("k_total", F.col("k")))
    return _round_vec(out, "centroid")


@query("kmeans_lloyd")
def q_kmeans_lloyd(spark, sf_dir):
    from lexiclust.operators import kmeans as km
    from lexiclust.operators.vectors import l2_normalize
    vs = l2_normalize(Inputs(spark, sf_dir).embedding_vectors())
    model = km.lloyd_kmeans(vs, EMB_K, seed=42, n_init=10)
    return km.model_labels(model, vs).select("slug", F.lit("serial").alias("method"),
                                             F.lit(EMB_K).alias("k"), "word", "cluster")


@query("kmeans_baseline")
def q_kmeans_baseline(spark, sf_dir):
    from lexiclust.operators import kmeans as km
    from lexiclust.operators.vectors import l2_normalize
    vs = l2_normalize(Inputs(spark, sf_dir).embedding_vectors())
    model, _ = km.baseline_kmeans(vs, EMB_K, seed=42)
    return km.model_labels(model, vs).select("slug", F.lit("sklearn").alias("method"),
                                             F.lit(EMB_K).alias("k"), "word", "cluster")


@query("cluster_grid")
def q_cluster_grid(spark, sf_dir):
    from lexiclust.operators import kmeans as km
    res = km.cluster_grid(Inputs(spark, sf_dir).embedding_vectors(), GRID_K, method="parallel")
    return res.assignments


# ---------------------------------------------------------------------------
# Labels


def _labels():
    from lexiclust.operators import labels as lb
    return lb


@query("lemma_pos_map")
def q_lemma_pos_map(spark, sf_dir):
    return _labels().lemma_pos_map(Inputs(spark, sf_dir).treebank())


@query("word_pos_map")
def q_word_pos_map(spark, sf_dir):
    return _labels().word_pos_map(Inputs(spark, sf_dir).treebank())


@query("attach_labels")
def q_attach_labels(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    lb = _labels()
    return lb.attach_labels(inp.context_runs(), lb.lemma_pos_map(inp.treebank()))


@query("attach_pos")
def q_attach_pos(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    lb = _labels()
    return lb.attach_pos(inp.context_runs(), lb.word_pos_map(inp.treebank()))


@query("contingency")
def q_contingency(spark, sf_dir):
    return _labels().contingency(Inputs(spark, sf_dir).embedding_truth()).withColumn(
        "n", F.col("n").cast("long")).withColumn("n_truth", F.col("n_truth").cast("long")).withColumn(
        "n_cluster", F.col("n_cluster").cast("long"))


@query("purity")
def q_purity(spark, sf_dir):
    return _labels().label_scores(Inputs(spark, sf_dir).embedding_truth()).select(
        "slug", "method", "k", "purity")


@query("homogeneity_completeness")
def q_homogeneity_completeness(spark, sf_dir):
    return _labels().label_scores(Inputs(spark, sf_dir).embedding_truth()).select(
        "slug", "method", "k", "homogeneity", "completeness")


@query("nmi_v")
def q_nmi_v(spark, sf_dir):
    return _labels().label_scores(Inputs(spark, sf_dir).embedding_truth()).select(
        "slug", "method", "k", "NMI", "V")


@query("silhouette_euclid")
def q_silhouette_euclid(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    return _labels().silhouette(inp.embedding_truth(), inp.unit_embeddings(), "euclidean")


@query("silhouette_sampled")
def q_silhouette_sampled(spark, sf_dir):
    """The silhouette on a sample of 300 words a run (L6, its feature)."""
    inp = Inputs(spark, sf_dir)
    return _labels().silhouette(inp.embedding_truth(), inp.unit_embeddings(), "euclidean", sample=300)


@query("silhouette_cosine")
def q_silhouette_cosine(spark, sf_dir):
    """Cosine distance on the raw (not normalised) embeddings."""
    inp = Inputs(spark, sf_dir)
    return _labels().silhouette(inp.embedding_truth(), inp.embedding_vectors(), "cosine")


@query("label_metrics")
def q_label_metrics(spark, sf_dir):
    """eval-intrinsic over the embedding runs, ``label`` as truth."""
    inp = Inputs(spark, sf_dir)
    return _labels().label_metrics(inp.embedding_truth(), inp.unit_embeddings())


@query("label_metrics_pos")
def q_label_metrics_pos(spark, sf_dir):
    """eval-intrinsic as the reference runs it: treebank lemma tags as truth
    (strict lemma join) for a run over the document vocabulary."""
    inp = Inputs(spark, sf_dir)
    lb = _labels()
    labelled = lb.attach_labels(inp.context_runs(), lb.lemma_pos_map(inp.treebank())).withColumnRenamed(
        "upos", "truth")
    return lb.label_metrics(labelled, inp.context_vectors())


# ---------------------------------------------------------------------------
# Cluster statistics


def _cs():
    from lexiclust.operators import clusterstats as cs
    return cs


def _stats(inp):
    from lexiclust.operators import labels as lb
    key = "_cluster_stats"
    if key not in inp._memo:
        inp._memo[key] = _cs().cluster_stats(inp.context_runs(), inp.context_vectors(),
                                              lb.word_pos_map(inp.treebank())).persist()
    return inp._memo[key]


@query("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return _cs().cluster_sizes(Inputs(spark, sf_dir).context_runs()).withColumn(
        "cid", F.col("cid").cast("int"))


@query("suffix_purity")
def q_suffix_purity(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    cs = _cs()
    out = cs.suffix_purity(cs._members(inp.context_runs(), inp.context_vectors()))
    return out.withColumn("cid", F.col("cid").cast("int")).withColumn("L", F.col("L").cast("int"))


@query("pos_profile")
def q_pos_profile(spark, sf_dir):
    from lexiclust.operators import labels as lb
    inp = Inputs(spark, sf_dir)
    cs = _cs()
    out = cs.pos_profile(cs._members(inp.context_runs(), inp.context_vectors()),
                         lb.word_pos_map(inp.treebank()))
    return out.withColumn("cid", F.col("cid").cast("int")).withColumn(
        "covered", F.col("covered").cast("long"))


@query("msi")
def q_msi(spark, sf_dir):
    return _stats(Inputs(spark, sf_dir)).select("slug", "method", "k", "cid", "msi")


@query("cluster_stats")
def q_cluster_stats(spark, sf_dir):
    return _stats(Inputs(spark, sf_dir))


@query("parse_stats_tables")
def q_parse_stats_tables(spark, sf_dir):
    """The statistics written as CSV lines, their columns in another
    order and without MSI, and read back by header (MSI derived)."""
    from lexiclust.operators import runs as rn
    stats = _stats(Inputs(spark, sf_dir))
    columns = [c for c in reversed(stats.columns) if c not in ("slug", "method", "k", "msi")]
    name = F.format_string("cluster_stats_%s_%s_K%d.csv", "slug", "method", "k")
    return rn.parse_stats_tables(rn.render_csv(stats, name, columns))


@query("macro_means")
def q_macro_means(spark, sf_dir):
    return _cs().macro_means(_stats(Inputs(spark, sf_dir)))


@query("suggest_semantic")
def q_suggest_semantic(spark, sf_dir):
    return _cs().suggest_clusters(_stats(Inputs(spark, sf_dir)), "semantic")


@query("suggest_morphological")
def q_suggest_morphological(spark, sf_dir):
    return _cs().suggest_clusters(_stats(Inputs(spark, sf_dir)), "morphological")


@query("extreme_cluster")
def q_extreme_cluster(spark, sf_dir):
    return _cs().extreme_cluster(_stats(Inputs(spark, sf_dir)))


@query("sample_words")
def q_sample_words(spark, sf_dir):
    return _cs().sample_words(Inputs(spark, sf_dir).context_runs())


@query("canonical_columns")
def q_canonical_columns(spark, sf_dir):
    """Statistics written with other spellings (``cluster``, hyphenated
    names, no MSI column) read back into the canonical form."""
    st = _stats(Inputs(spark, sf_dir)).select(
        "slug", "method", "k", F.col("cid").alias("cluster"), "size",
        F.col("max_suffix_purity").alias("max-suffix-purity"),
        F.col("pos_purity").alias("pos-purity"), F.col("pos_entropy").alias("pos-entropy"),
        F.col("pos_coverage").alias("coverage"))
    return _cs().canonical_columns(st)


# Runs on both sides of every gate: words labelled, and whether they are one cluster.
GATES = {"first99": (99, False), "first100": (100, False), "first199": (199, False),
         "first200": (200, False), "single200": (200, True)}


@query("metric_gates")
def q_metric_gates(spark, sf_dir):
    """Which runs get a row of scores (100 labelled words) and which
    of them a silhouette (200 words, two clusters)."""
    inp = Inputs(spark, sf_dir)
    truth, rows = inp.embedding_truth().filter(F.col("k") == EMB_K), None
    for method, (words, single) in GATES.items():
        run = truth.filter(F.col("word").cast("long") < words).withColumn("method", F.lit(method))
        run = run.withColumn("cluster", F.lit(0)) if single else run
        rows = run if rows is None else rows.unionByName(run)
    scores = _labels().label_metrics(rows, inp.unit_embeddings())
    return scores.select("method", "K", "n", F.col("silhouette").isNotNull().alias("scored"))


@query("feasible_k")
def q_feasible_k(spark, sf_dir):
    """The K of the default grid that a set is large enough for, of the whole
    set and of its first words."""
    from lexiclust.operators import kmeans as km
    from lexiclust.operators.vectors import cap_rank, feasible_k
    vs = Inputs(spark, sf_dir).embedding_vectors()
    few = cap_rank(vs, 200).withColumn("slug", F.lit("first200"))
    fewer = cap_rank(vs, 199).withColumn("slug", F.lit("first199"))
    return feasible_k(vs.unionByName(few).unionByName(fewer), list(km.DEFAULT_K_VALUES))


# ---------------------------------------------------------------------------
# Alignment

ALIGN_K = 10
ALIGN_KS = {"greedy": (5, 10, 20), "optimal": (5, 8, 10)}
MATCHED_CID = 3


def _align_runs(inp, method="greedy"):
    """Runs of the same vectors from two seeds, for every K of ``ALIGN_KS``."""
    key = f"_align_runs_{method}"
    if key not in inp._memo:
        vs, ks = inp.unit_embeddings(), ALIGN_KS[method]
        a = inp.runs_over(vs, ks, rounds=3, seed=42)
        b = inp.runs_over(vs, ks, rounds=3, seed=7).withColumn("method", F.lit("parallel-s7"))
        inp._memo[key] = (a.persist(), b.persist())
    return inp._memo[key]


def _centroids(inp):
    from lexiclust.operators.vectors import centroid_mean
    a, b = (x.filter(F.col("k") == ALIGN_K) for x in _align_runs(inp))
    vs = inp.embedding_vectors()
    ka = a.select("slug", "method", "k").distinct().withColumn("k_total", F.col("k"))
    kb = b.select("slug", "method", "k").distinct().withColumn("k_total", F.col("k"))
    return centroid_mean(a, vs, ka), centroid_mean(b, vs, kb)


def _alignment(inp, method):
    from lexiclust.operators import align
    key = f"_alignment_{method}"
    if key not in inp._memo:
        a, b = _align_runs(inp, method)
        inp._memo[key] = align.alignment(a, b, inp.embedding_vectors(), normed=True,
                                         method=method).persist()
    return inp._memo[key]


@query("centroid_similarity")
def q_centroid_similarity(spark, sf_dir):
    from lexiclust.operators import align
    ca, cb = _centroids(Inputs(spark, sf_dir))
    return align.centroid_similarity(ca, cb).select("cid_a", "cid_b", "sim")


@query("greedy_match")
def q_greedy_match(spark, sf_dir):
    from lexiclust.operators import align
    ca, cb = _centroids(Inputs(spark, sf_dir))
    return align.greedy_match(align.centroid_similarity(ca, cb)).select("cid_a", "cid_b", "sim")


@query("optimal_match")
def q_optimal_match(spark, sf_dir):
    """The matching of maximum total similarity, by an auction."""
    from lexiclust.operators import align
    ca, cb = _centroids(Inputs(spark, sf_dir))
    return align.optimal_match(align.centroid_similarity(ca, cb)).matching.select("cid_a", "cid_b", "sim")


@query("cluster_overlap")
def q_cluster_overlap(spark, sf_dir):
    return _alignment(Inputs(spark, sf_dir), "greedy").filter(F.col("k") == ALIGN_K).select(
        "cid_a", "cid_b", "jaccard", "size_a", "size_b")


@query("alignment")
def q_alignment(spark, sf_dir):
    """align-clusters with the optimal matching, all pairs of runs at once."""
    return _alignment(Inputs(spark, sf_dir), "optimal")


@query("alignment_greedy")
def q_alignment_greedy(spark, sf_dir):
    """align-clusters with the greedy matching, all pairs of runs at once."""
    return _alignment(Inputs(spark, sf_dir), "greedy")


@query("parse_alignments")
def q_parse_alignments(spark, sf_dir):
    """The alignments written as CSV lines and read back by header."""
    from lexiclust.operators import align, runs as rn
    al = _alignment(Inputs(spark, sf_dir), "greedy")
    columns = ["jaccard", "centroid_cosine", "size_b", "size_a", "cid_b", "cid_a"]
    return rn.parse_alignments(rn.render_csv(al, align.pair_file(al), columns))


@query("alignment_summary")
def q_alignment_summary(spark, sf_dir):
    from lexiclust.operators import align
    return align.alignment_summary(_alignment(Inputs(spark, sf_dir), "greedy"))


@query("matched_cluster")
def q_matched_cluster(spark, sf_dir):
    from lexiclust.operators import align
    return align.matched_cluster(
        _alignment(Inputs(spark, sf_dir), "greedy").filter(F.col("k") == ALIGN_K), MATCHED_CID)


# ---------------------------------------------------------------------------
# Run tables

EVENT_METHODS = ["click", "error", "purchase", "signup", "view"]


def _runs():
    from lexiclust.operators import runs as rn
    return rn


@query("parse_runs")
def q_parse_runs(spark, sf_dir):
    return Inputs(spark, sf_dir).parsed_runs()


@query("best_run")
def q_best_run(spark, sf_dir):
    return _runs().best_run(Inputs(spark, sf_dir).parsed_runs())


@query("runtime_pivot")
def q_runtime_pivot(spark, sf_dir):
    rn = _runs()
    return rn.runtime_pivot(rn.best_run(Inputs(spark, sf_dir).parsed_runs()), EVENT_METHODS)


@query("speedup")
def q_speedup(spark, sf_dir):
    """Ratio of two methods' best seconds (``view`` over ``click``)."""
    rn = _runs()
    piv = rn.runtime_pivot(rn.best_run(Inputs(spark, sf_dir).parsed_runs()), EVENT_METHODS)
    return rn.speedup(piv, "view", "click")


@query("run_slug_family")
def q_run_slug_family(spark, sf_dir):
    rn = _runs()
    vec = Inputs(spark, sf_dir).parsed_runs().select("vec").distinct()
    return vec.select("vec", rn.run_slug(F.col("vec")).alias("slug")).withColumn(
        "family", rn.run_family(F.col("slug")))


@query("msi_pivot")
def q_msi_pivot(spark, sf_dir):
    return _runs().msi_pivot(_stats(Inputs(spark, sf_dir)))


@query("legend_order")
def q_legend_order(spark, sf_dir):
    """Lines of a figure of the runs in the order of its legend."""
    return _runs().legend_order(Inputs(spark, sf_dir).parsed_runs(), ["view", "click"])


@query("table_order")
def q_table_order(spark, sf_dir):
    """The table of the best runs in the order in which it is written."""
    rn = _runs()
    best = rn.best_run(Inputs(spark, sf_dir).parsed_runs())
    return rn.table_order(best.select("vecslug", "method", "K", "log_path"), ["vecslug", "method", "K"])


@query("metric_series")
def q_metric_series(spark, sf_dir):
    inp = Inputs(spark, sf_dir)
    from lexiclust.operators import labels as lb
    metrics = lb.label_metrics(inp.embedding_truth(), inp.unit_embeddings())
    return _runs().metric_series(metrics)


# ---------------------------------------------------------------------------
# Lemmas, training, looking inside clusters


@query("lexicon_lemmatize")
def q_lexicon_lemmatize(spark, sf_dir):
    """lemma-text as a data job: the cleaned corpus through a form-to-lemma
    lexicon built from the treebank."""
    inp = Inputs(spark, sf_dir)
    lex = textops.lemma_lexicon(inp.treebank())
    return textops.lexicon_lemmatize(inp.clean(), lex)


@query("top_words")
def q_top_words(spark, sf_dir):
    from lexiclust.operators import explore
    inp = Inputs(spark, sf_dir)
    return explore.top_words(inp.context_runs(), inp.context_vectors())


@query("project_2d")
def q_project_2d(spark, sf_dir):
    """PCA of each cluster's 40-word sample; checked by invariants in tests."""
    from lexiclust.operators import explore
    inp = Inputs(spark, sf_dir)
    return explore.project_2d(inp.context_runs(), inp.context_vectors())


@query("projected_centroids")
def q_projected_centroids(spark, sf_dir):
    """M9 with centroids: the projected points are centred, their axes are
    uncorrelated, and the first carries at least as much as the second."""
    from lexiclust.operators import explore
    inp = Inputs(spark, sf_dir)
    c = explore.projected_centroids(explore.project_2d(inp.context_runs(), inp.context_vectors()))
    near = lambda x: F.abs(F.round(x, 6))
    return c.select("slug", "method", "k", "cluster", "points", near(F.col("x")).alias("x"),
                    near(F.col("y")).alias("y"), near(F.col("xy")).alias("xy"),
                    (F.col("xx") >= F.col("yy") - 1e-9).alias("ordered"),
                    ((F.col("xx") > 0) | (F.col("points") < 2)).alias("spread"))


@query("viz_top_clusters")
def q_viz_top_clusters(spark, sf_dir):
    from lexiclust.operators import explore
    inp = Inputs(spark, sf_dir)
    return explore.viz_top_clusters(_stats(inp), inp.context_runs(), inp.context_vectors())


MIN_COUNT = 5  # of a trained word


def _trained_matrix(inp: Inputs):
    from lexiclust.operators import embed
    vocab = embed.training_vocabulary(inp.clean(), MIN_COUNT)
    return embed.shifted_ppmi(embed.cooccurrence(inp.clean(), vocab, window=5))


@query("cooccurrence")
def q_cooccurrence(spark, sf_dir):
    """M6, counts: pairs of words at most five apart in a line."""
    from lexiclust.operators import embed
    lines = Inputs(spark, sf_dir).clean()
    return embed.cooccurrence(lines, embed.training_vocabulary(lines, MIN_COUNT), window=5)


@query("shifted_ppmi")
def q_shifted_ppmi(spark, sf_dir):
    """M6, associations of the pairs."""
    return _trained_matrix(Inputs(spark, sf_dir))


@query("subword_buckets")
def q_subword_buckets(spark, sf_dir):
    """M6, sub-words: the n-gram buckets of every trained word."""
    from lexiclust.operators import embed
    return embed.subword_buckets(embed.training_vocabulary(Inputs(spark, sf_dir).clean(), MIN_COUNT))


@query("embedding_axes")
def q_embedding_axes(spark, sf_dir):
    """M6, axes: how many words they place; orthogonal, in descending order of
    weight, their sums not negative."""
    from lexiclust.operators import embed
    dim = 16
    vecs = embed.principal_axes(_trained_matrix(Inputs(spark, sf_dir)), dim)
    cells = vecs.select("word", F.posexplode("vec").alias("axis", "a"), "vec")
    sums = cells.groupBy("axis").agg(
        F.count(F.lit(1)).alias("words"), F.sum("a").alias("s"),
        *(F.sum(F.col("a") * F.col("vec")[j]).alias(f"c{j}") for j in range(dim)))
    cross = F.array(*(F.col(f"c{j}") for j in range(dim)))
    weight = F.element_at(cross, F.col("axis") + 1)
    others = F.transform(cross, lambda c, j: F.when(j == F.col("axis"), 0.0).otherwise(F.abs(c)))
    before = F.lag("weight").over(Window.orderBy("axis"))  # one row an axis
    return (sums.select("axis", "words", weight.alias("weight"), (F.col("s") > -1e-6).alias("turned"),
                        (F.array_max(others) < 1e-6 * weight).alias("orthogonal"))
            .select("axis", "words", "turned", "orthogonal",
                    F.coalesce(F.col("weight") <= before + 1e-9, F.lit(True)).alias("ordered")))


@query("train_embeddings")
def q_train_embeddings(spark, sf_dir):
    """Vectors trained on the cleaned corpus, sub-words included (values depend
    on the sum order in their last bits and on the random start)."""
    from lexiclust.operators import embed
    return embed.train_embeddings(Inputs(spark, sf_dir).clean(), dim=16, min_count=MIN_COUNT,
                                  slug="documents-trained").words


@query("parse_treebank")
def q_parse_treebank(spark, sf_dir):
    """S3 in table form: token rows read back from rendered CoNLL-U lines."""
    from lexiclust.operators import labels
    return labels.parse_treebank(Inputs(spark, sf_dir).treebank_lines()).select(
        "doc_id", "line_pos", "sent", "id", "form", "lemma", "upos")
