"""DuckDB oracle SQL, written from the operator definitions (not from our
Spark code). Views ``documents``, ``embeddings`` ... are pre-registered.

DuckDB's regex engine is ASCII for ``\\w``, ``\\b`` and ``\\s``; the test text
has no case where that differs from the Unicode rules (see SURVEY 7.3).
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

URL = r"https?://\S+|www\.\S+"
EMAIL = r"\b[\w.\-+]+@[\w.\-]+\.\w+\b"
KEEP_REF = r"[^0-9A-Za-zА-Яа-яЀ-ӿ[:space:]]+"
KEEP_UNI = r"[^\p{L}\p{N}[:space:]]+"


def _norm(expr: str, keep: str) -> str:
    s = f"regexp_replace({expr}, '{URL}', ' ', 'g')"
    s = f"regexp_replace({s}, '{EMAIL}', ' ', 'g')"
    s = f"regexp_replace({s}, '{keep}', ' ', 'g')"
    s = f"regexp_replace({s}, '[[:space:]]+', ' ', 'g')"
    return f"lower(trim({s}))"


RAW = """raw AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_pos, unnest(parts) AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
)"""


def _clean_ctes(keep: str = KEEP_REF, profile_where: str = "") -> str:
    """raw -> norm -> longl -> prof -> clean (first occurrence per text)."""
    return f"""{RAW},
norm AS (
  SELECT doc_id, line_pos, {_norm('raw', keep)} AS text
  FROM raw WHERE NOT regexp_full_match(raw, '[[:space:]]*')
),
longl AS (SELECT * FROM norm WHERE length(text) >= 20),
prof AS (SELECT * FROM longl {profile_where}),
clean AS (
  SELECT doc_id, line_pos, text FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, line_pos) AS rn FROM prof)
  WHERE rn = 1
)"""


def _profile_where(script_class: str, distinctive: str) -> str:
    letters = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
    script = (f"length(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), "
              f"'{script_class}', '', 'g'))")
    return (f"WHERE {letters} > 0 AND {script} / {letters} >= 0.6 "
            f"AND regexp_matches(text, '[{distinctive}]')")


CLEAN = _clean_ctes()
TOKENS = CLEAN + """,
tokens AS (
  SELECT doc_id, line_pos, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS tok_pos, unnest(toks) AS token
  FROM (SELECT doc_id, line_pos, string_split(text, ' ') AS toks FROM clean)
)"""

ORACLES["clean_lines"] = f"WITH {CLEAN} SELECT doc_id, line_pos, text FROM clean"

ORACLES["clean_counters"] = f"""WITH {RAW},
x AS (
  SELECT regexp_full_match(raw, '[[:space:]]*') AS blank, {_norm('raw', KEEP_REF)} AS text FROM raw
)
SELECT CAST(count(*) AS BIGINT) AS total_lines,
       CAST(count(*) FILTER (WHERE NOT blank) AS BIGINT) AS nonblank_lines,
       CAST(count(*) FILTER (WHERE NOT blank AND length(text) >= 20) AS BIGINT) AS long_lines,
       CAST(count(*) FILTER (WHERE NOT blank AND length(text) >= 20) AS BIGINT) AS profile_lines,
       CAST(count(DISTINCT CASE WHEN NOT blank AND length(text) >= 20 THEN text END) AS BIGINT) AS kept_lines
FROM x"""

ORACLES["dedup_lines"] = f"""WITH {CLEAN}
SELECT doc_id, line_pos, text, copies FROM (
  SELECT doc_id, line_pos, text,
         row_number() OVER (PARTITION BY text ORDER BY doc_id, line_pos) AS rn,
         CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies
  FROM longl) WHERE rn = 1"""

ORACLES["head_lines"] = f"""WITH {RAW}
SELECT doc_id, line_pos, raw FROM (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_pos) AS g FROM raw) WHERE g <= 5000"""

ORACLES["min_length"] = f"WITH {CLEAN} SELECT doc_id, line_pos, text FROM longl"

ORACLES["language_filter"] = (
    "WITH " + _clean_ctes(KEEP_UNI, _profile_where(r"[^\p{Latin}]", "éèêàçñüß"))
    + " SELECT doc_id, line_pos, text FROM clean")

# The corpus in Cyrillic letters as NFKC leaves it (k has become one letter, z is plain).
ORACLES["language_filter_mk"] = (
    "WITH " + _clean_ctes(KEEP_REF, _profile_where("[^А-Яа-яЀ-ӿ]", "ЃѓЌќЉљЊњЏџЅѕ")).replace(
        "string_split(text,", "string_split(translate(text, 'abdefgilmnoprstuvhcqwkABDEFGILMNOPRSTUV@', "
        "'абдефгилмнопрстувњцќџѓАБДЕФГИЛМНОПРСТУВ '),")
    + " SELECT doc_id, line_pos, text FROM clean")

ORACLES["tokenize"] = f"WITH {TOKENS} SELECT doc_id, line_pos, tok_pos, token FROM tokens WHERE token <> ''"

TOKEN_STATS = TOKENS + """,
tstats AS (
  SELECT token, CAST(count(*) AS BIGINT) AS n,
         arg_min(doc_id, (doc_id, line_pos, tok_pos)) AS fd,
         arg_min(line_pos, (doc_id, line_pos, tok_pos)) AS fl,
         arg_min(tok_pos, (doc_id, line_pos, tok_pos)) AS ft
  FROM tokens WHERE token <> '' GROUP BY token
)"""

ORACLES["token_counts"] = f"WITH {TOKEN_STATS} SELECT token, n FROM tstats"

ORACLES["top_vocab"] = f"""WITH {TOKEN_STATS}
SELECT rank, token, n FROM (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, fd, fl, ft) AS BIGINT) AS rank, token, n FROM tstats)
WHERE rank <= 200000"""



# ---------------------------------------------------------------------------
# Vectors and k-means


def _unit(expr: str) -> str:
    return (f"list_transform({expr}, lambda e: e / (sqrt(list_sum(list_transform({expr}, "
            f"lambda f: f * f))) + 1e-12))")


def _round_list(expr: str) -> str:
    return f"list_transform({expr}, lambda e: round(e, 6))"


EMB = f"""vn AS (
  SELECT 'embeddings' AS slug, CAST(vec_id AS BIGINT) AS rank, CAST(vec_id AS VARCHAR) AS word,
         {_unit('CAST(embedding AS DOUBLE[])')} AS x
  FROM embeddings
)"""

CONTEXT = TOKEN_STATS + f""",
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, fd, fl, ft) AS rnk FROM tstats),
cvc AS (SELECT token, doc_id % 16 AS b, count(*) AS c FROM tokens WHERE token <> '' GROUP BY 1, 2),
cvd AS (
  SELECT t.token, list(coalesce(ln(1 + c.c), 0.0) ORDER BY g.b) AS v
  FROM (SELECT DISTINCT token FROM cvc) t CROSS JOIN range(0, 16) g(b)
  LEFT JOIN cvc c ON c.token = t.token AND c.b = g.b
  GROUP BY t.token
),
cv AS (
  SELECT 'documents-context' AS slug, CAST(vocab.rnk - 1 AS BIGINT) AS rank, cvd.token AS word,
         {_unit('v')} AS x
  FROM cvd JOIN vocab USING (token)
)"""

CONV_TOKENS = f"""craw AS (
  SELECT conv_id * 1000000 + turn AS doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_pos,
         unnest(parts) AS raw
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)
),
cnorm AS (
  SELECT doc_id, line_pos, {_norm('raw', KEEP_REF)} AS text
  FROM craw WHERE NOT regexp_full_match(raw, '[[:space:]]*')
),
cclean AS (SELECT DISTINCT text FROM cnorm WHERE length(text) >= 20),
ctokens AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM cclean)"""


def kmeans_ctes(src: str, k: int, rounds: int, seed: int, p: str = "") -> str:
    """Unrolled spherical k-means over ``src(slug, rank, word, x)``; ends with
    ``{p}lab`` (rank, word, x, cid) from the centroids after ``rounds`` rounds."""
    ctes = [f"""{p}c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY md5('{seed}:' || rank), rank) - 1 AS INTEGER) AS cid, x AS c
  FROM {src} QUALIFY row_number() OVER (ORDER BY md5('{seed}:' || rank), rank) <= {k}
)"""]

    def assign(t_prev: int, name: str) -> str:
        return f"""{name} AS (
  SELECT v.rank, v.word, any_value(v.x) AS x,
         (min({{'d': round(list_distance(v.x, c.c), 9), 'cid': c.cid}})).cid AS cid
  FROM {src} v CROSS JOIN {p}c{t_prev} c GROUP BY v.rank, v.word
)"""

    for t in range(1, rounds + 1):
        ctes.append(assign(t - 1, f"{p}a{t}"))
        ctes.append(f"""{p}m{t} AS (
  SELECT cid, list(e ORDER BY i) AS m FROM (
    SELECT cid, i, avg(e) AS e FROM (
      SELECT cid, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM {p}a{t}) GROUP BY cid, i)
  GROUP BY cid
),
{p}e{t} AS (
  SELECT g.cid, row_number() OVER (ORDER BY g.cid) AS j
  FROM range(0, {k}) g(cid) WHERE g.cid NOT IN (SELECT cid FROM {p}m{t})
),
{p}s{t} AS (
  SELECT x, row_number() OVER (ORDER BY md5('{seed}:{t}:' || rank), rank) AS j FROM {src}
  QUALIFY j <= {k}
),
{p}c{t} AS (
  SELECT CAST(cid AS INTEGER) AS cid, {_unit('m')} AS c FROM (
    SELECT cid, m FROM {p}m{t}
    UNION ALL SELECT e.cid, s.x FROM {p}e{t} e JOIN {p}s{t} s USING (j))
)""")
    ctes.append(assign(rounds, f"{p}lab"))
    return ",\n".join(ctes)


def _kmeans_query(rounds: int, method: str = "parallel", k: int = 10) -> str:
    return (f"WITH {EMB},\n{kmeans_ctes('vn', k, rounds, 42)}\n"
            f"SELECT 'embeddings' AS slug, '{method}' AS method, CAST({k} AS INTEGER) AS k, word, "
            f"CAST(cid AS INTEGER) AS cluster FROM lab")


ORACLES["l2_normalize"] = f"WITH {EMB} SELECT slug, rank, word, {_round_list('x')} AS vec FROM vn"

ORACLES["parse_vectors"] = f"""SELECT 'embeddings' AS slug, CAST(vec_id AS BIGINT) AS rank,
  CAST(vec_id AS VARCHAR) AS word, {_round_list('CAST(embedding AS DOUBLE[])')} AS vec FROM embeddings"""
ORACLES["context_vectors"] = f"WITH {CONTEXT} SELECT slug, rank, word, {_round_list('x')} AS vec FROM cv"

ORACLES["cap_rank"] = f"WITH {CONTEXT} SELECT slug, rank, word FROM cv WHERE rank < 20000"

ORACLES["restrict_to_vocab"] = f"""WITH {CONTEXT}, {CONV_TOKENS}
SELECT slug, rank, word FROM cv
WHERE word IN (SELECT token FROM ctokens) OR NOT EXISTS (SELECT 1 FROM cv WHERE word IN (SELECT token FROM ctokens))"""

ORACLES["restrict_fallback"] = f"""WITH {CONTEXT}, {CONV_TOKENS}
SELECT slug, rank, word FROM cv
WHERE word IN (SELECT '#' || token FROM ctokens)
   OR NOT EXISTS (SELECT 1 FROM cv WHERE word IN (SELECT '#' || token FROM ctokens))"""

ORACLES["known_words"] = f"""WITH {CONTEXT}, {CONV_TOKENS},
{kmeans_ctes('cv', 10, 1, 42)}
SELECT 'documents-context' AS slug, 'parallel' AS method, CAST(10 AS INTEGER) AS k, word,
       CAST(cid AS INTEGER) AS cluster
FROM lab WHERE word IN (SELECT token FROM ctokens)"""

ORACLES["nearest_centroid"] = _kmeans_query(0)
ORACLES["kmeans_round1"] = _kmeans_query(1)
ORACLES["kmeans_round3"] = _kmeans_query(3)

ORACLES["centroid_mean"] = (
    f"WITH {EMB},\n{kmeans_ctes('vn', 10, 1, 42)},\n"
    f"""emb AS (SELECT CAST(vec_id AS VARCHAR) AS word, {_unit('CAST(embedding AS DOUBLE[])')} AS x FROM embeddings),
mem AS (SELECT lab.cid, emb.x FROM lab JOIN emb USING (word)),
mm AS (
  SELECT cid, list(e ORDER BY i) AS m, max(n) AS n FROM (
    SELECT cid, i, avg(e) AS e, count(*) AS n FROM (
      SELECT cid, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM mem) GROUP BY cid, i)
  GROUP BY cid
)
SELECT 'embeddings' AS slug, 'parallel' AS method, CAST(10 AS INTEGER) AS k, CAST(g.cid AS INTEGER) AS cid,
       {_round_list(_unit('coalesce(mm.m, list_transform(range(64), lambda z: 0.0))'))} AS centroid,
       CAST(coalesce(mm.n, 0) AS BIGINT) AS n_words
FROM range(0, 10) g(cid) LEFT JOIN mm ON mm.cid = g.cid""")


# ---------------------------------------------------------------------------
# Labels

TREEBANK = CONTEXT + """,
tb AS (
  SELECT t.token AS form,
         CASE WHEN length(t.token) > 5 THEN substring(t.token, 1, length(t.token) - 2) ELSE t.token END AS lemma,
         upper(d.lang) AS upos, t.doc_id, t.line_pos, t.tok_pos
  FROM tokens t JOIN documents d USING (doc_id) WHERE t.token <> ''
),
lp AS (
  SELECT lemma AS word, upos FROM (
    SELECT lemma, upos, count(*) AS c, min((doc_id, line_pos, tok_pos)) AS o
    FROM tb WHERE lemma <> '' AND upos <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY c DESC, o) = 1
),
wp AS (
  SELECT key AS word, upos FROM (
    SELECT key, upos, count(*) AS c, min((doc_id, line_pos, tok_pos, sub)) AS o FROM (
      SELECT lower(form) AS key, upos, doc_id, line_pos, tok_pos, 0 AS sub FROM tb
      UNION ALL SELECT lower(lemma), upos, doc_id, line_pos, tok_pos, 1 FROM tb)
    GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, o) = 1
)"""

CONTEXT_RUN = TREEBANK + ",\n" + kmeans_ctes("cv", 10, 1, 42, "r") + """,
crun AS (
  SELECT 'documents-context' AS slug, 'parallel' AS method, CAST(10 AS INTEGER) AS k, word,
         CAST(cid AS INTEGER) AS cluster FROM rlab
)"""

ORACLES["lemma_pos_map"] = f"WITH {TREEBANK} SELECT word, upos FROM lp"
ORACLES["word_pos_map"] = f"WITH {TREEBANK} SELECT word, upos FROM wp"
ORACLES["attach_labels"] = f"WITH {CONTEXT_RUN} SELECT crun.*, lp.upos FROM crun JOIN lp USING (word)"
ORACLES["attach_pos"] = (f"WITH {CONTEXT_RUN} SELECT crun.*, wp.upos FROM crun "
                         f"LEFT JOIN wp ON lower(crun.word) = wp.word")

EMB_RUNS = (EMB + ",\n" + ",\n".join(kmeans_ctes("vn", k, 3, 42, f"k{k}") for k in (5, 10, 20))
            + """,
eruns AS (
  SELECT 'embeddings' AS slug, 'parallel' AS method, CAST(5 AS INTEGER) AS k, word, CAST(cid AS INTEGER) AS cluster FROM k5lab
  UNION ALL SELECT 'embeddings', 'parallel', CAST(10 AS INTEGER), word, CAST(cid AS INTEGER) FROM k10lab
  UNION ALL SELECT 'embeddings', 'parallel', CAST(20 AS INTEGER), word, CAST(cid AS INTEGER) FROM k20lab
),
elab AS (
  SELECT r.*, e.label AS truth FROM eruns r JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = r.word
)""")


def scores_ctes(src: str) -> str:
    """Contingency metrics per run over ``src(slug, method, k, word, cluster, truth)``."""
    return f"""cells AS (SELECT slug, method, k, truth, cluster, count(*) AS n FROM {src} GROUP BY ALL),
tot AS (SELECT slug, method, k, sum(n) AS total FROM cells GROUP BY ALL),
ntr AS (SELECT slug, method, k, truth, sum(n) AS m FROM cells GROUP BY ALL),
ncl AS (SELECT slug, method, k, cluster, sum(n) AS m FROM cells GROUP BY ALL),
ht AS (
  SELECT slug, method, k, count(*) AS classes,
         CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum((m / total) * ln(m / total)) END AS h
  FROM ntr JOIN tot USING (slug, method, k) GROUP BY ALL),
hc AS (
  SELECT slug, method, k, count(*) AS classes,
         CASE WHEN count(*) = 1 THEN 0.0 ELSE -sum((m / total) * ln(m / total)) END AS h
  FROM ncl JOIN tot USING (slug, method, k) GROUP BY ALL),
mi AS (
  SELECT slug, method, k, greatest(sum((c.n / t.total) * ln((t.total * c.n) / (a.m * b.m))), 0.0) AS mi
  FROM cells c JOIN tot t USING (slug, method, k) JOIN ntr a USING (slug, method, k, truth)
  JOIN ncl b USING (slug, method, k, cluster) GROUP BY ALL),
pur AS (
  SELECT slug, method, k, sum(top) AS top FROM (
    SELECT slug, method, k, cluster, max(n) AS top FROM cells GROUP BY ALL) GROUP BY ALL),
sc0 AS (
  SELECT slug, method, k, CAST(total AS BIGINT) AS n, top / total AS purity,
         CASE WHEN ht.h = 0 THEN 1.0 ELSE mi / ht.h END AS homogeneity,
         CASE WHEN hc.h = 0 THEN 1.0 ELSE mi / hc.h END AS completeness,
         mi, ht.h AS h_true, hc.h AS h_pred, ht.classes AS n_true, hc.classes AS n_pred
  FROM tot JOIN pur USING (slug, method, k) JOIN mi USING (slug, method, k)
  JOIN ht USING (slug, method, k) JOIN hc USING (slug, method, k)),
scores AS (
  SELECT slug, method, k, n, purity, homogeneity, completeness,
         CASE WHEN homogeneity + completeness = 0 THEN 0.0
              ELSE 2 * homogeneity * completeness / (homogeneity + completeness) END AS V,
         CASE WHEN n_true = 1 AND n_pred = 1 THEN 1.0 WHEN mi = 0 THEN 0.0
              ELSE mi / ((h_true + h_pred) / 2) END AS NMI
  FROM sc0)"""


def silhouette_ctes(src: str, vecs: str, metric: str, sample: int | None = None, seed: int = 42) -> str:
    """Exact silhouette per run over the labelled words of ``src`` that have a
    vector in ``vecs(slug, word, x)``; sample = lowest md5('seed:word')."""
    cut = "" if sample is None else (
        f"QUALIFY row_number() OVER (PARTITION BY slug, method, k ORDER BY md5('{seed}:' || word), word)"
        f" <= {sample}")
    dist = ("list_distance(p.x, q.x)" if metric == "euclidean"
            else "greatest(least(1.0 - list_cosine_similarity(p.x, q.x), 2.0), 0.0)")
    return f"""pts0 AS (
  SELECT DISTINCT s.slug, s.method, s.k, s.word, s.cluster, v.x
  FROM {src} s JOIN {vecs} v ON v.slug = s.slug AND v.word = s.word),
gate AS (
  SELECT slug, method, k FROM pts0 GROUP BY ALL
  HAVING count(*) >= 200 AND count(DISTINCT cluster) >= 2),
pts AS (
  SELECT * FROM pts0 SEMI JOIN gate USING (slug, method, k) {cut}),
pairs AS (
  SELECT p.slug, p.method, p.k, p.word, p.cluster, q.cluster AS oc,
         CASE WHEN p.word = q.word THEN 0.0 ELSE {dist} END AS d
  FROM pts p JOIN pts q USING (slug, method, k)),
per AS (SELECT slug, method, k, word, cluster, oc, sum(d) AS sd, count(*) AS cnt FROM pairs GROUP BY ALL),
ab AS (
  SELECT slug, method, k, word,
         max(CASE WHEN oc = cluster AND cnt > 1 THEN sd / (cnt - 1) END) AS a,
         min(CASE WHEN oc <> cluster THEN sd / cnt END) AS b,
         max(CASE WHEN oc = cluster THEN cnt END) AS own
  FROM per GROUP BY ALL),
sil AS (
  SELECT slug, method, k,
         avg(CASE WHEN own = 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette,
         CAST(count(*) AS BIGINT) AS n_sample
  FROM ab GROUP BY ALL)"""


EMB_VECS = f"""evec AS (SELECT 'embeddings' AS slug, CAST(vec_id AS VARCHAR) AS word,
  CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""

ORACLES["contingency"] = f"""WITH {EMB_RUNS},
cells AS (SELECT slug, method, k, truth, cluster, CAST(count(*) AS BIGINT) AS n FROM elab GROUP BY ALL)
SELECT *, CAST(sum(n) OVER (PARTITION BY slug, method, k, truth) AS BIGINT) AS n_truth,
       CAST(sum(n) OVER (PARTITION BY slug, method, k, cluster) AS BIGINT) AS n_cluster
FROM cells"""

ORACLES["purity"] = f"WITH {EMB_RUNS},\n{scores_ctes('elab')} SELECT slug, method, k, purity FROM scores"
ORACLES["homogeneity_completeness"] = (
    f"WITH {EMB_RUNS},\n{scores_ctes('elab')} SELECT slug, method, k, homogeneity, completeness FROM scores")
ORACLES["nmi_v"] = f"WITH {EMB_RUNS},\n{scores_ctes('elab')} SELECT slug, method, k, NMI, V FROM scores"
ORACLES["silhouette_euclid"] = (
    f"WITH {EMB_RUNS},\n{silhouette_ctes('elab', 'vn', 'euclidean')} SELECT * FROM sil")
ORACLES["silhouette_sampled"] = (
    f"WITH {EMB_RUNS},\n{silhouette_ctes('elab', 'vn', 'euclidean', sample=300)} SELECT * FROM sil")
ORACLES["silhouette_cosine"] = (
    f"WITH {EMB_RUNS}, {EMB_VECS},\n{silhouette_ctes('elab', 'evec', 'cosine')} SELECT * FROM sil")


def _label_metrics_sql(prefix: str, src: str, vecs: str) -> str:
    return f"""WITH {prefix},
lm_in AS (SELECT * FROM {src} WHERE (slug, method, k) IN (
  SELECT (slug, method, k) FROM {src} GROUP BY ALL HAVING count(*) >= 100)),
{scores_ctes('lm_in')},
{silhouette_ctes('lm_in', vecs, 'euclidean')}
SELECT s.slug AS vecslug, s.method, s.k AS K, s.n, s.purity, s.NMI, s.V, s.homogeneity, s.completeness,
       sil.silhouette
FROM scores s LEFT JOIN sil USING (slug, method, k)"""


ORACLES["label_metrics"] = _label_metrics_sql(EMB_RUNS, "elab", "vn")
ORACLES["label_metrics_pos"] = _label_metrics_sql(
    CONTEXT_RUN + ",\nplab AS (SELECT crun.*, lp.upos AS truth FROM crun JOIN lp USING (word))", "plab", "cv")


# ---------------------------------------------------------------------------
# Cluster statistics

STATS = CONTEXT_RUN + """,
mem AS (
  SELECT c.slug, c.method, c.k, c.cluster AS cid, c.word, cv.rank
  FROM crun c JOIN cv ON cv.slug = c.slug AND cv.word = c.word),
sizes AS (SELECT slug, method, k, cluster AS cid, CAST(count(*) AS BIGINT) AS size FROM crun GROUP BY ALL),
sx AS (
  SELECT slug, method, k, cid, L, right(word, L) AS suffix, rank
  FROM mem CROSS JOIN (VALUES (2), (3), (4)) t(L) WHERE length(word) >= L),
sc AS (SELECT slug, method, k, cid, L, suffix, count(*) AS c, min(rank) AS o FROM sx GROUP BY ALL),
st AS (
  SELECT slug, method, k, cid, L, suffix, c / sum(c) OVER (PARTITION BY slug, method, k, cid, L) AS purity
  FROM sc QUALIFY row_number() OVER (PARTITION BY slug, method, k, cid, L ORDER BY c DESC, o) = 1),
tg AS (SELECT m.slug, m.method, m.k, m.cid, m.rank, wp.upos FROM mem m JOIN wp ON lower(m.word) = wp.word),
pc AS (SELECT slug, method, k, cid, upos, count(*) AS c, min(rank) AS o FROM tg GROUP BY ALL),
pe AS (
  SELECT slug, method, k, cid, CAST(sum(c) AS BIGINT) AS covered,
         -sum((c / tot) * ln(c / tot + 1e-12)) / ln(17) AS pos_entropy
  FROM (SELECT *, sum(c) OVER (PARTITION BY slug, method, k, cid) AS tot FROM pc) GROUP BY ALL),
pt AS (
  SELECT slug, method, k, cid, upos AS top_pos, c / sum(c) OVER (PARTITION BY slug, method, k, cid) AS pos_purity
  FROM pc QUALIFY row_number() OVER (PARTITION BY slug, method, k, cid ORDER BY c DESC, o) = 1),
stats0 AS (
  SELECT s.slug, s.method, s.k, CAST(s.cid AS INTEGER) AS cid, s.size,
         coalesce(a.suffix, '') AS suffix2, coalesce(a.purity, 0.0) AS suffix2_purity,
         coalesce(b.suffix, '') AS suffix3, coalesce(b.purity, 0.0) AS suffix3_purity,
         coalesce(c.suffix, '') AS suffix4, coalesce(c.purity, 0.0) AS suffix4_purity,
         coalesce(pt.top_pos, '') AS top_pos, coalesce(pt.pos_purity, 0.0) AS pos_purity,
         coalesce(pe.pos_entropy, 0.0) AS pos_entropy,
         coalesce(pe.covered, 0) / greatest(s.size, 1) AS pos_coverage
  FROM sizes s
  LEFT JOIN st a ON a.slug = s.slug AND a.method = s.method AND a.k = s.k AND a.cid = s.cid AND a.L = 2
  LEFT JOIN st b ON b.slug = s.slug AND b.method = s.method AND b.k = s.k AND b.cid = s.cid AND b.L = 3
  LEFT JOIN st c ON c.slug = s.slug AND c.method = s.method AND c.k = s.k AND c.cid = s.cid AND c.L = 4
  LEFT JOIN pt ON pt.slug = s.slug AND pt.method = s.method AND pt.k = s.k AND pt.cid = s.cid
  LEFT JOIN pe ON pe.slug = s.slug AND pe.method = s.method AND pe.k = s.k AND pe.cid = s.cid),
stats AS (
  SELECT slug, method, k, cid, size, suffix2, suffix2_purity, suffix3, suffix3_purity, suffix4, suffix4_purity,
         greatest(suffix2_purity, suffix3_purity, suffix4_purity) AS max_suffix_purity,
         top_pos, pos_purity, pos_entropy, pos_coverage,
         pos_purity - greatest(suffix2_purity, suffix3_purity, suffix4_purity) AS msi,
         pos_coverage > 0 AS pos_covered
  FROM stats0)"""

ORACLES["cluster_sizes"] = f"WITH {STATS} SELECT slug, method, k, CAST(cid AS INTEGER) AS cid, size FROM sizes"
ORACLES["suffix_purity"] = (f"WITH {STATS} SELECT slug, method, k, CAST(cid AS INTEGER) AS cid, "
                            f"CAST(L AS INTEGER) AS L, suffix, purity FROM st")
ORACLES["pos_profile"] = (f"WITH {STATS} SELECT pt.slug, pt.method, pt.k, CAST(pt.cid AS INTEGER) AS cid, "
                          f"top_pos, pos_purity, pos_entropy, covered FROM pt JOIN pe USING (slug, method, k, cid)")
ORACLES["msi"] = f"WITH {STATS} SELECT slug, method, k, cid, msi FROM stats"
ORACLES["cluster_stats"] = f"WITH {STATS} SELECT * FROM stats"
ORACLES["parse_stats_tables"] = f"WITH {STATS} SELECT * EXCLUDE (pos_covered) FROM stats"
ORACLES["macro_means"] = f"""WITH {STATS}
SELECT slug AS vecslug, method, k AS K, avg(max_suffix_purity) AS suffix_mean, avg(pos_purity) AS pos_purity_mean,
       avg(pos_entropy) AS pos_entropy_mean, avg(pos_coverage) AS pos_coverage_mean, avg(msi) AS msi_mean
FROM stats GROUP BY ALL"""


def _suggest_sql(score: str, order: str) -> str:
    return f"""WITH {STATS},
sg AS (SELECT *, {score} AS score FROM stats WHERE size >= 15)
SELECT slug, method, k, CAST(pick AS INTEGER) AS pick, cid, size, top_pos, pos_purity, pos_entropy, pos_coverage,
       max_suffix_purity, msi, score FROM (
  SELECT *, row_number() OVER (PARTITION BY slug, method, k ORDER BY {order}) AS pick FROM sg)
WHERE pick <= 8"""


ORACLES["suggest_semantic"] = _suggest_sql("msi", "score DESC, pos_purity DESC, max_suffix_purity ASC, cid ASC")
ORACLES["suggest_morphological"] = _suggest_sql("-msi", "score DESC, max_suffix_purity DESC, size DESC, cid ASC")
ORACLES["extreme_cluster"] = f"""WITH {STATS}
SELECT slug, method, k, arg_min(cid, (msi, cid)) AS lowest_cid, min(msi) AS lowest_msi,
       arg_min(cid, (-msi, cid)) AS highest_cid, max(msi) AS highest_msi
FROM stats GROUP BY ALL"""
ORACLES["sample_words"] = f"""WITH {CONTEXT_RUN}
SELECT slug, method, k, word, cluster FROM crun
QUALIFY row_number() OVER (PARTITION BY slug, method, k, cluster ORDER BY md5('42:' || word), word) <= 40"""
ORACLES["projected_centroids"] = f"""SELECT slug, method, k, cluster, count(*) AS points, 0.0 AS x, 0.0 AS y, 0.0 AS xy,
       true AS ordered, true AS spread
FROM ({ORACLES["sample_words"]}) GROUP BY ALL"""
TRAINED = TOKEN_STATS + """,
tv AS (SELECT token FROM tstats WHERE n >= 5),
placed AS (SELECT * FROM tokens WHERE token <> ''),
co AS (
  SELECT a.token AS word, b.token AS context, CAST(count(*) AS BIGINT) AS n
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND a.line_pos = b.line_pos
    AND b.tok_pos BETWEEN a.tok_pos - 5 AND a.tok_pos + 5 AND a.tok_pos <> b.tok_pos
  WHERE a.token IN (SELECT token FROM tv) AND b.token IN (SELECT token FROM tv)
  GROUP BY ALL
),
margin AS (SELECT word, sum(n) AS m FROM co GROUP BY word),
pp AS (
  SELECT co.word, co.context,
         ln(co.n) + ln((SELECT sum(n) FROM co)) - ln(a.m) - ln(b.m) AS x
  FROM co JOIN margin a ON a.word = co.word JOIN margin b ON b.word = co.context
)"""
ORACLES["cooccurrence"] = f"WITH {TRAINED} SELECT word, context, n FROM co"
ORACLES["shifted_ppmi"] = f"WITH {TRAINED} SELECT word, context, x FROM pp WHERE x > 1e-12"
ORACLES["subword_buckets"] = f"""WITH {TRAINED}
SELECT DISTINCT token AS word,
       CAST('0x' || substring(md5(substring('<' || token || '>', CAST(i AS INTEGER), CAST(g AS INTEGER))), 1, 8)
            AS BIGINT) % 2000000 AS bucket
FROM tv, range(3, 7) r(g), LATERAL (SELECT unnest(range(1, length(token) + 4 - g)) AS i)"""
ORACLES["embedding_axes"] = f"""WITH {TRAINED}
SELECT CAST(a AS INTEGER) AS axis, (SELECT count(DISTINCT word) FROM pp WHERE x > 1e-12) AS words,
       true AS turned, true AS orthogonal, true AS ordered
FROM range(0, 16) g(a)"""

# A line of the corpus is a sentence: a comment, one row a token, after the first a
# multiword node, and a blank line.
ORACLES["parse_treebank"] = f"""WITH {TREEBANK},
sents AS (SELECT doc_id, line_pos, row_number() OVER (ORDER BY doc_id, line_pos) - 1 AS sent
          FROM (SELECT DISTINCT doc_id, line_pos FROM tokens))
SELECT tb.doc_id, tb.line_pos * 1000000 + CASE WHEN tb.tok_pos = 0 THEN 1 ELSE tb.tok_pos + 2 END AS line_pos,
       CAST(sent AS BIGINT) AS sent, CAST(tb.tok_pos + 1 AS VARCHAR) AS id, form, lemma, upos
FROM tb JOIN sents ON sents.doc_id = tb.doc_id AND sents.line_pos = tb.line_pos"""
ORACLES["canonical_columns"] = f"""WITH {STATS}
SELECT slug, method, k, cid, size, max_suffix_purity, pos_purity, pos_entropy, pos_coverage,
       pos_purity - max_suffix_purity AS msi FROM stats"""


ORACLES["metric_gates"] = """SELECT method, CAST(10 AS INTEGER) AS K, count(*) AS n,
       count(*) >= 200 AND NOT single AS scored
FROM embeddings JOIN (VALUES ('first99', 99, false), ('first100', 100, false), ('first199', 199, false),
  ('first200', 200, false), ('single200', 200, true)) g(method, words, single) ON vec_id < words
GROUP BY method, single HAVING count(*) >= 100"""
ORACLES["feasible_k"] = """WITH sets AS (
  SELECT 'embeddings' AS slug, count(*) AS n FROM embeddings
  UNION ALL SELECT 'first200', count(*) FROM embeddings WHERE vec_id < 200
  UNION ALL SELECT 'first199', count(*) FROM embeddings WHERE vec_id < 199)
SELECT slug, CAST(k AS INTEGER) AS k FROM sets JOIN (VALUES (200), (400), (800), (1200), (2000)) g(k) ON k <= n"""


# ---------------------------------------------------------------------------
# Alignment


def _centroid_cte(name: str, members: str, k: int) -> str:
    return f"""{name}m AS (
  SELECT cid, list(e ORDER BY i) AS m FROM (
    SELECT cid, i, avg(e) AS e FROM (
      SELECT cid, generate_subscripts(x, 1) AS i, unnest(x) AS e FROM {members}) GROUP BY cid, i)
  GROUP BY cid),
{name} AS (
  SELECT CAST(g.cid AS INTEGER) AS cid,
         {_unit('coalesce(mm.m, list_transform(range(64), lambda z: 0.0))')} AS c
  FROM range(0, {k}) g(cid) LEFT JOIN {name}m mm ON mm.cid = g.cid)"""


def _greedy_ctes(sim: str, k: int) -> str:
    parts = [f"g0 AS (SELECT cid_a, cid_b, sim, round(sim, 9) AS s FROM {sim})"]
    for t in range(1, k + 1):
        # the sequential rule: the best pair that is left
        parts.append(f"""b{t} AS (
  SELECT cid_a, cid_b, sim FROM g{t - 1} ORDER BY s DESC, cid_a, cid_b LIMIT 1),
g{t} AS (
  SELECT * FROM g{t - 1}
  WHERE cid_a NOT IN (SELECT cid_a FROM b{t}) AND cid_b NOT IN (SELECT cid_b FROM b{t}))""")
    parts.append("gm AS (" + " UNION ALL ".join(f"SELECT * FROM b{t}" for t in range(1, k + 1)) + ")")
    return ",\n".join(parts)


def _optimal_ctes(sim: str, k: int) -> str:
    """The best total over every set of columns that the first t rows can take."""
    parts = ["t0 AS (SELECT CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS total, CAST([] AS INTEGER[]) AS path)"]
    for t in range(1, k + 1):
        parts.append(f"""t{t} AS (
  SELECT mask, max(total) AS total, arg_max(path, total) AS path FROM (
    SELECT mask | (1::BIGINT << cid_b) AS mask, total + CAST(round(sim * 1000000) AS BIGINT) AS total,
           list_append(path, cid_b) AS path
    FROM t{t - 1} JOIN {sim} ON cid_a = {t - 1} AND mask & (1::BIGINT << cid_b) = 0) GROUP BY mask)""")
    parts.append(f"""gm AS (
  SELECT s.* FROM {sim} s JOIN (
    SELECT generate_subscripts(path, 1) - 1 AS cid_a, unnest(path) AS cid_b FROM t{k}) USING (cid_a, cid_b))""")
    return ",\n".join(parts)


def align_ctes(k: int, match=_greedy_ctes) -> str:
    """Two runs of K = ``k`` matched one-to-one; the table is ``al``."""
    return (EMB + ",\n" + kmeans_ctes("vn", k, 3, 42, "sa") + ",\n" + kmeans_ctes("vn", k, 3, 7, "sb")
            + ",\n" + f"""emb AS (SELECT CAST(vec_id AS VARCHAR) AS word, {_unit('CAST(embedding AS DOUBLE[])')} AS x
  FROM embeddings),
ra AS (SELECT word, CAST(cid AS INTEGER) AS cluster FROM salab),
rb AS (SELECT word, CAST(cid AS INTEGER) AS cluster FROM sblab),
mema AS (SELECT ra.cluster AS cid, emb.x FROM ra JOIN emb USING (word)),
memb AS (SELECT rb.cluster AS cid, emb.x FROM rb JOIN emb USING (word)),
{_centroid_cte('cma', 'mema', k)},
{_centroid_cte('cmb', 'memb', k)},
simm AS (SELECT a.cid AS cid_a, b.cid AS cid_b, list_dot_product(a.c, b.c) AS sim
  FROM cma a CROSS JOIN cmb b),
{match('simm', k)},
sza AS (SELECT cluster AS cid_a, count(DISTINCT word) AS size_a FROM ra GROUP BY ALL),
szb AS (SELECT cluster AS cid_b, count(DISTINCT word) AS size_b FROM rb GROUP BY ALL),
itx AS (SELECT ra.cluster AS cid_a, rb.cluster AS cid_b, count(DISTINCT word) AS inter
  FROM ra JOIN rb USING (word) GROUP BY ALL),
al AS (
  SELECT 'embeddings' AS slug_a, 'parallel' AS method_a, 'embeddings' AS slug_b, 'parallel-s7' AS method_b,
         CAST({k} AS INTEGER) AS k, gm.cid_a, gm.cid_b, gm.sim AS centroid_cosine,
         coalesce(itx.inter, 0) / greatest(coalesce(sza.size_a, 0) + coalesce(szb.size_b, 0)
                                           - coalesce(itx.inter, 0), 1) AS jaccard,
         CAST(coalesce(sza.size_a, 0) AS BIGINT) AS size_a, CAST(coalesce(szb.size_b, 0) AS BIGINT) AS size_b
  FROM gm LEFT JOIN itx USING (cid_a, cid_b) LEFT JOIN sza USING (cid_a) LEFT JOIN szb USING (cid_b))""")


ALIGN_KS = (5, 10, 20)
ALIGN = align_ctes(10)
ALL_ALIGN = " UNION ALL ".join(f"SELECT * FROM (WITH {align_ctes(k)} SELECT * FROM al)" for k in ALIGN_KS)

OPTIMAL_KS = (5, 8, 10)  # the oracle tries every set of columns
ORACLES["optimal_match"] = f"WITH {align_ctes(10, _optimal_ctes)} SELECT cid_a, cid_b, sim FROM gm"
ORACLES["alignment"] = " UNION ALL ".join(
    f"SELECT * FROM (WITH {align_ctes(k, _optimal_ctes)} SELECT * FROM al)" for k in OPTIMAL_KS)
ORACLES["centroid_similarity"] = f"WITH {ALIGN} SELECT cid_a, cid_b, sim FROM simm"
ORACLES["greedy_match"] = f"WITH {ALIGN} SELECT cid_a, cid_b, sim FROM gm"
ORACLES["cluster_overlap"] = f"WITH {ALIGN} SELECT cid_a, cid_b, jaccard, size_a, size_b FROM al"
ORACLES["alignment_greedy"] = ALL_ALIGN
ORACLES["parse_alignments"] = f"""SELECT 'alignment_' || slug_a || '_' || method_a || '__' || slug_b || '_' ||
       method_b || '_K' || k || '.csv' AS file, k, cid_a, cid_b, centroid_cosine, jaccard, size_a, size_b
FROM ({ALL_ALIGN})"""
ORACLES["alignment_summary"] = f"""SELECT 'alignment_' || slug_a || '_' || method_a || '__' || slug_b || '_' || method_b || '_K' || k || '.csv' AS file,
       k AS K, avg(centroid_cosine) AS mean_centroid_cosine, median(centroid_cosine) AS median_centroid_cosine,
       avg(jaccard) AS mean_jaccard, CAST(count(*) AS BIGINT) AS pairs
FROM ({ALL_ALIGN}) GROUP BY ALL"""
ORACLES["matched_cluster"] = f"WITH {ALIGN} SELECT cid_a, cid_b, centroid_cosine FROM al WHERE cid_a = 3"


# ---------------------------------------------------------------------------
# Run tables

RUNS = """logs AS (
  SELECT 'clusters/u' || CAST(user_id // 10 AS VARCHAR) || '/' || event_type || '/K'
           || CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) // 20 + 1) * 100 AS VARCHAR)
           || '/run.log#' || CAST(event_id AS VARCHAR) AS log_path,
         concat_ws(chr(10),
           'vec=embeddings/vectors/u' || CAST(user_id // 10 AS VARCHAR) || '.vec',
           'vecslug=u' || CAST(user_id // 10 AS VARCHAR),
           'K=' || CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) // 20 + 1) * 100 AS VARCHAR),
           'method=' || event_type,
           'N=' || CAST(event_id AS VARCHAR),
           'D=64', 'normed=1',
           'iterations=' || json_extract_string(props, '$.k'),
           'num_cores=', 'max_iter=100',
           'secs=' || coalesce(CAST(value AS VARCHAR), ''),
           'max_words=all') AS text
  FROM events),
kv AS (
  SELECT log_path, pos, trim(split_part(line, '=', 1)) AS key, trim(substr(line, strpos(line, '=') + 1)) AS value
  FROM (SELECT log_path, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
        FROM (SELECT log_path, string_split(text, chr(10)) AS ls FROM logs))
  WHERE strpos(line, '=') > 0),
lastv AS (SELECT log_path, key, arg_max(value, pos) AS value FROM kv GROUP BY ALL),
wide AS (
  SELECT log_path,
    max(CASE WHEN key = 'vec' THEN value END) AS vec, max(CASE WHEN key = 'vecslug' THEN value END) AS vecslug,
    max(CASE WHEN key = 'method' THEN value END) AS method, max(CASE WHEN key = 'max_words' THEN value END) AS max_words,
    max(CASE WHEN key = 'K' THEN value END) AS K, max(CASE WHEN key = 'N' THEN value END) AS N,
    max(CASE WHEN key = 'D' THEN value END) AS D, max(CASE WHEN key = 'iterations' THEN value END) AS iterations,
    max(CASE WHEN key = 'num_cores' THEN value END) AS num_cores, max(CASE WHEN key = 'max_iter' THEN value END) AS max_iter,
    max(CASE WHEN key = 'normed' THEN value END) AS normed, max(CASE WHEN key = 'secs' THEN value END) AS secs
  FROM lastv GROUP BY log_path),
runs AS (
  SELECT coalesce(vec, '') AS vec, coalesce(vecslug, '') AS vecslug, coalesce(method, '') AS method,
    CASE WHEN regexp_full_match(K, '[+-]?[0-9]+') THEN CAST(K AS BIGINT) ELSE 0 END AS K,
    CASE WHEN regexp_full_match(N, '[+-]?[0-9]+') THEN CAST(N AS BIGINT) ELSE 0 END AS N,
    CASE WHEN regexp_full_match(D, '[+-]?[0-9]+') THEN CAST(D AS BIGINT) ELSE 0 END AS D,
    CASE WHEN lower(normed) IN ('1', 'true', 'yes') THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS normed,
    CASE WHEN regexp_full_match(iterations, '[+-]?[0-9]+') THEN CAST(iterations AS BIGINT) ELSE 0 END AS iterations,
    CASE WHEN regexp_full_match(num_cores, '[+-]?[0-9]+') THEN CAST(num_cores AS BIGINT) ELSE 0 END AS num_cores,
    CASE WHEN regexp_full_match(max_iter, '[+-]?[0-9]+') THEN CAST(max_iter AS BIGINT) ELSE 0 END AS max_iter,
    coalesce(max_words, '') AS max_words,
    coalesce(TRY_CAST(secs AS DOUBLE), CAST('NaN' AS DOUBLE)) AS secs,
    log_path
  FROM wide),
best AS (
  SELECT * FROM runs WHERE NOT isnan(secs)
  QUALIFY row_number() OVER (PARTITION BY vecslug, K, method ORDER BY secs, log_path) = 1),
piv AS (
  SELECT vecslug, K,
    min(secs) FILTER (WHERE method = 'click') AS click, min(secs) FILTER (WHERE method = 'error') AS error,
    min(secs) FILTER (WHERE method = 'purchase') AS purchase, min(secs) FILTER (WHERE method = 'signup') AS signup,
    min(secs) FILTER (WHERE method = 'view') AS view
  FROM best GROUP BY ALL)"""

ORACLES["parse_runs"] = f"WITH {RUNS} SELECT * FROM runs"
ORACLES["best_run"] = f"WITH {RUNS} SELECT * FROM best"
ORACLES["runtime_pivot"] = f"WITH {RUNS} SELECT * FROM piv"
ORACLES["speedup"] = f"""WITH {RUNS}
SELECT vecslug, K, view, click, CASE WHEN view IS NOT NULL AND click IS NOT NULL AND click <> 0
  THEN view / click END AS speedup FROM piv"""
ORACLES["run_slug_family"] = f"""WITH {RUNS},
v AS (SELECT DISTINCT vec FROM runs),
s AS (SELECT vec, CASE WHEN len(string_split(vec, '/')) > 1 THEN string_split(vec, '/')[-2] ELSE '' END || '-' ||
  replace(replace(replace(string_split(vec, '/')[-1], '.vec.gz', ''), '.vec', ''), '.bin', '') AS slug FROM v)
SELECT vec, slug, CASE WHEN starts_with(lower(slug), 'baseline-') THEN 'baseline'
  WHEN contains(lower(slug), 'lemma') THEN 'lemma' ELSE 'raw' END AS family FROM s"""
ORACLES["legend_order"] = f"""WITH {RUNS},
ln AS (
  SELECT DISTINCT vecslug, method, CASE WHEN starts_with(lower(vecslug), 'baseline-') THEN 'baseline'
    WHEN contains(lower(vecslug), 'lemma') THEN 'lemma' ELSE 'raw' END AS family FROM runs)
SELECT vecslug, method, family, row_number() OVER (ORDER BY
  coalesce(list_position(['baseline|view', 'baseline|click', 'raw|view', 'raw|click', 'lemma|view', 'lemma|click'],
                         family || '|' || method), 7), vecslug, method) AS place FROM ln"""
ORACLES["table_order"] = f"""WITH {RUNS}
SELECT vecslug, method, K, log_path, row_number() OVER (ORDER BY vecslug, method, K) AS place FROM best"""
ORACLES["msi_pivot"] = f"""WITH {STATS}
SELECT k AS K, round(avg(msi), 3) AS "documents-context|parallel" FROM stats GROUP BY ALL"""
ORACLES["metric_series"] = f"""WITH lmx AS ({ORACLES["label_metrics"]}),
pts AS (
  SELECT vecslug, method, K, metric, value FROM (
    SELECT vecslug, method, K, unnest([{{'metric': 'purity', 'value': purity}}, {{'metric': 'NMI', 'value': NMI}},
      {{'metric': 'V', 'value': V}}, {{'metric': 'homogeneity', 'value': homogeneity}},
      {{'metric': 'completeness', 'value': completeness}}, {{'metric': 'silhouette', 'value': silhouette}}], recursive := true)
    FROM lmx)
  WHERE value IS NOT NULL AND NOT isnan(value)),
rng AS (
  SELECT metric, min(value) - greatest(1e-6, (max(value) - min(value)) * 0.06) AS lo,
         max(value) + greatest(1e-6, (max(value) - min(value)) * 0.06) AS hi
  FROM pts GROUP BY metric)
SELECT pts.metric, vecslug, method, K, value, lo, hi FROM pts JOIN rng USING (metric)"""


# ---------------------------------------------------------------------------
# Lemmas and top words

ORACLES["lexicon_lemmatize"] = f"""WITH {TREEBANK},
lex AS (
  SELECT form, lemma FROM (
    SELECT lower(form) AS form, lemma, count(*) AS c, min((doc_id, line_pos, tok_pos)) AS o FROM tb GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY c DESC, o) = 1)
SELECT t.doc_id, t.line_pos, string_agg(coalesce(lex.lemma, t.token), ' ' ORDER BY t.tok_pos) AS text
FROM tokens t LEFT JOIN lex ON lex.form = t.token WHERE t.token <> '' GROUP BY ALL"""

ORACLES["top_words"] = f"""WITH {CONTEXT_RUN},
memw AS (SELECT c.cluster AS cid, c.word, cv.rank, cv.x FROM crun c JOIN cv USING (word)),
{_centroid_cte('cent', 'memw', 10).replace('range(64)', 'range(16)')},
sims AS (
  SELECT m.cid AS cluster, m.word, m.rank, list_dot_product({_unit('m.x')}, ce.c) AS sim
  FROM memw m JOIN cent ce ON ce.cid = m.cid)
SELECT 'documents-context' AS slug, 'parallel' AS method, CAST(10 AS INTEGER) AS k, CAST(cluster AS INTEGER) AS cluster,
       CAST(place AS INTEGER) AS place, word, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(sim, 9) DESC, rank) AS place FROM sims)
WHERE place <= 50"""


def oracle_sql() -> dict[str, str]:
    from lexiclust.plans.checks import round_sql
    return {name: round_sql(name, sql) for name, sql in ORACLES.items()}
