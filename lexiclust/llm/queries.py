"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.llm import (chat, decontaminate, extract, langid, lm, neardup, neighbours, packing,
                           quality, repair, tokencount, urlfilter, variants)
from lexiclust.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKEN_LIMIT = 512


def query(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op1_quality")
def op1_quality(spark, sf_dir):
    """Quality of every whole text by votes of labelled neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query("op2_main_text")
def op2_main_text(spark, sf_dir):
    """Main text of every whole page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract.extract(pages, extract.fit(pages), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_language")
def op3_language(spark, sf_dir):
    """Language of every whole text by word-first backoff."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs), out="found")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        "found.lang_pred", "found.score")


_OP4_SQL = r"""
WITH RECURSIVE fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM fold WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
  WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id,
  doc_id = coalesce(c, doc_id) AS kept
FROM fold LEFT JOIN n USING (doc_id) LEFT JOIN comp ON doc_id = comp.a
"""


@query("op4_near_duplicates", _OP4_SQL)
def op4_near_duplicates(spark, sf_dir):
    """Components of documents whose five-word shingle sets agree to 85 %."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs)


_OP5_SQL = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM fold, sizes
        WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, spot.n, item_id FROM spot JOIN win ON spot.k = win.k AND spot.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
got AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) AS items_sha256
        FROM occ GROUP BY doc_id)
SELECT fold.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM fold LEFT JOIN hit USING (doc_id) LEFT JOIN got USING (doc_id)
"""


@query("op5_decontaminate", _OP5_SQL)
def op5_decontaminate(spark, sf_dir):
    """Every document against the word windows of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), out="hits")
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"))


@query("op6_pack")
def op6_pack(spark, sf_dir):
    """All documents cut, tokenised and packed into sequences of 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# The contract's rules (fixed values).
URL_RULES = [
    urlfilter.Rule(urlfilter.ALLOW, "com/"),
    urlfilter.Rule(urlfilter.BLOCK, "example.com/en/"),
    urlfilter.Rule(urlfilter.ALLOW, "www.example.com/en/"),
    urlfilter.Rule(urlfilter.BLOCK, "net/es/"),
    urlfilter.Rule(urlfilter.BLOCK, "net/fr/"),
]

_OP7_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, h, p, verdict) AS (VALUES ('com/', 'com', '/', 'allow'),
  ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
  ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fit USING (page_id)
"""


@query("op7_url_filter", _OP7_SQL)
def op7_url_filter(spark, sf_dir):
    """Every page's url judged by the rules through two filter cascades."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "judged.*")


_OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>)', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|[a-z_]+\|>)', '\1\\\2\3', 'g') AS t
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
    ORDER BY turn, r, t)) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(r) + length('<|body|>') + length(t) + length('</s>'))
    AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


@query("op8_chat_format", _OP8_SQL)
def op8_chat_format(spark, sf_dir):
    """All conversations, and one that says the control strings, formatted and
    read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


_OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op9_neighbours", _OP9_SQL)
def op9_neighbours(spark, sf_dir):
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0)


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    """UTF-8 bytes and byte-level BPE tokens of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), out="size")
    return counted.select("doc_id", "size.n_bytes", "size.n_tokens",
                          (F.col("size.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# CRC-32 in SQL: its byte table by the rule of its polynomial, and the checksum of the
# bytes written in hexadecimal in column x.
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
      ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""
_CRC = """xor(list_reduce([('0x' || substr(x, 2 * i + 1, 2))::BIGINT FOR i IN range(length(x) // 2)],
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

_OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
often AS (SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 6 GROUP BY ALL),
written AS (SELECT r, n, hex(concat(doc_id, ':', r)) AS x FROM often),
hashed AS (SELECT r, n, {_CRC} AS h FROM written, crc_table),
said AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2)
    ELSE r END AS word FROM hashed),
vocab AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word
  HAVING sum(n) >= 5),
cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pair AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b
    ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN vocab v ON cut.d = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN vocab v ON cut.d = v.word),
ranked AS (
  SELECT pair.word, near, v.n AS near_n, count(*) OVER (PARTITION BY pair.word) AS n_near,
    row_number() OVER (PARTITION BY pair.word ORDER BY v.n DESC, near) AS k
  FROM pair JOIN vocab v ON v.word = near),
best AS (
  SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 5 * n THEN near END AS form,
    CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM vocab LEFT JOIN ranked ON ranked.word = vocab.word AND k = 1),
chain(word, root) AS (
  SELECT word, word FROM best
  UNION ALL SELECT chain.word, best.form FROM chain JOIN best ON best.word = chain.root
    WHERE best.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN best ON best.word = chain.root
         WHERE best.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM best JOIN ends USING (word)
"""


@query("op11_spelling_variants", _OP11_SQL)
def op11_spelling_variants(spark, sf_dir):
    """Words of all documents with their commoner spellings, typing errors planted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.group_variants(docs, damage_every=199).select(
        "word", "form", "root", "n", "n_near", "form_n")


_OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
whole AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))) AS x
  FROM conversations),
marked AS (SELECT *, {_CRC} % 20 AS h FROM whole, crc_table),
bad AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER w AS n, lag(role[1]) OVER w AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM ordered),
faulty AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1
      AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM faulty GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS n, {{'c': 0, 'a': '', 't': ''}} AS x0, {{'c': 99999999, 'a': '', 't': ''}} AS x1,
    {{'c': 2, 'a': 'I', 't': 'user:'}} AS x2, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS x3
  FROM counted
  UNION ALL
  SELECT conv_id, n, x0, x1, x2,
    list_sort([x3, {{'c': x2.c + 2, 'a': x2.a || 'I', 't': x2.t || lf || 'assistant:'}}])[1] AS x3
  FROM (
    SELECT conv_id, n, x0, x1, x3, chr(10) AS lf, list_sort([x2,
      {{'c': x0.c + 2, 'a': x0.a || 'I', 't': x0.t || CASE WHEN x0.t = '' THEN '' ELSE chr(10) END || 'user:'}},
      {{'c': x1.c + 2, 'a': x1.a || 'I', 't': x1.t || chr(10) || 'user:'}},
      {{'c': x3.c + 2, 'a': x3.a || 'I', 't': x3.t || chr(10) || 'user:'}}])[1] AS x2
    FROM (
      SELECT conv_id, n, d0 AS x0,
        list_sort([d1, {{'c': x0.c + k + CASE WHEN i = 's' THEN 0 ELSE 99999999 END, 'a': x0.a || 'K', 't': own}}])[1] AS x1,
        list_sort([d2,
          {{'c': x0.c + k + ku, 'a': x0.a || 'K', 't': x0.t || CASE WHEN x0.t = '' THEN '' ELSE chr(10) END || own}},
          {{'c': x1.c + k + ku, 'a': x1.a || 'K', 't': x1.t || chr(10) || own}},
          {{'c': x3.c + k + ku, 'a': x3.a || 'K', 't': x3.t || chr(10) || own}},
          {{'c': x0.c + k + 2, 'a': x0.a || 'R', 't': x0.t || CASE WHEN x0.t = '' THEN '' ELSE chr(10) END || 'user:' || text}},
          {{'c': x1.c + k + 2, 'a': x1.a || 'R', 't': x1.t || chr(10) || 'user:' || text}},
          {{'c': x3.c + k + 2, 'a': x3.a || 'R', 't': x3.t || chr(10) || 'user:' || text}}])[1] AS x2,
        list_sort([d3,
          {{'c': x2.c + k + ka, 'a': x2.a || 'K', 't': x2.t || chr(10) || own}},
          {{'c': x2.c + k + 2, 'a': x2.a || 'R', 't': x2.t || chr(10) || 'assistant:' || text}}])[1] AS x3
      FROM (
        SELECT dp.conv_id, f.n, x0, x1, x2, x3, f.text, f.role || ':' || f.text AS own, f.role[1] AS i,
          CASE f.fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 99999999 END AS k,
          CASE WHEN f.role[1] = 'u' THEN 0 ELSE 99999999 END AS ku,
          CASE WHEN f.role[1] = 'a' THEN 0 ELSE 99999999 END AS ka,
          {{'c': x0.c + 3, 'a': x0.a || 'D', 't': x0.t}} AS d0, {{'c': x1.c + 3, 'a': x1.a || 'D', 't': x1.t}} AS d1,
          {{'c': x2.c + 3, 'a': x2.a || 'D', 't': x2.t}} AS d2, {{'c': x3.c + 3, 'a': x3.a || 'D', 't': x3.t}} AS d3
        FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n + 1)))),
ended AS (
  SELECT dp.conv_id, gaps, blank, duplicate, truncated, illegal, list_sort([x0, x3])[1] AS x
  FROM dp JOIN counted c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.rows = dp.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(x.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_repair", _OP12_SQL)
def op12_repair(spark, sf_dir):
    """All conversations damaged, and the cheapest edits that repair each."""
    turns = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.summaries(repair.repair(turns, present="present"))


LM_FOLDS, LM_HELD_OUT = 7, 2  # rows whose crc32(doc_id) mod 7 is 2 are not learnt from


@query("op13_lm_score")
def op13_lm_score(spark, sf_dir):
    """Every whole text under a byte model and a word model of the training texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % LM_FOLDS
    return lm.score_documents(docs, F.coalesce(fold != LM_HELD_OUT, F.lit(True)))
