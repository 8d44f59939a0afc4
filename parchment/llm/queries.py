"""The numbered queries: each applies one operator to its whole table; with SQL where that can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, chat, decontaminate, html, jaccard, langid, lexical, packing, pii, quality, suffix, trie, urls
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents only: one row per document and benchmark item."""
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All diagonals of all texts and items by a join of equal tokens; a stretch is the farthest pair of places on a diagonal
#: between which at least four of five tokens are equal.
OVERLAP_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS t FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT q, len(t) AS size, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM b WHERE len(t) >= {decontaminate.MIN_TOKENS}),
o AS (SELECT r, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM d),
g AS (SELECT r, q, o.k - i.k AS base, count(*) AS equal FROM o JOIN i USING (w) GROUP BY r, q, base, size HAVING 5 * count(*) >= 4 * least(size, {decontaminate.STRETCH})),
p AS (SELECT r, q, base, equal, d.t AS a, b.t AS c, unnest(range(greatest(1, 1 - base), least(len(b.t), len(d.t) - base) + 1)) AS k FROM g JOIN d USING (r) JOIN b USING (q)),
s AS (SELECT r, q, base, equal, k, 5 * sum((a[base + k] = c[k])::INT) OVER (PARTITION BY r, q, base ORDER BY k) - 4 * (k - greatest(1, 1 - base) + 1) AS score FROM p
  UNION ALL SELECT r, q, base, equal, greatest(0, -base), 0 FROM g),
l AS (SELECT r, q, base, any_value(x.equal) AS equal, max(y.k - x.k) AS stretch FROM s x JOIN s y USING (r, q, base) WHERE y.k >= x.k AND y.score >= x.score GROUP BY r, q, base),
f AS (SELECT r, q, max({{'e': equal, 's': stretch}}) AS best FROM l JOIN b USING (q) WHERE 5 * equal >= 4 * len(t) OR stretch >= {decontaminate.STRETCH} GROUP BY r, q)
SELECT doc_id, item_id, len(b.t)::BIGINT AS item_tokens, best.e::BIGINT AS equal_tokens, best.s::BIGINT AS longest_stretch FROM f JOIN d USING (r) JOIN b USING (q)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_metrics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _rule_sql(r: quality.Rule) -> str:
    bad = [f"100 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None) + [f"100 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None)
    return f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END"


QUALITY_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{quality.WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{quality.WORD}')) AS l
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
c AS (SELECT DISTINCT r, i + k AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g), range(5) AS s(k) WHERE n > 1),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(trim(x, '.,;:!?"''()')) IN ({", ".join(f"'{x}'" for x in sorted(set(quality.STOP_WORDS)))}))) AS n_stop_words,
         len(list_filter(l, lambda x: ends_with(rtrim(x, ' ' || chr(9) || chr(13)), '...') OR ends_with(rtrim(x, ' ' || chr(9) || chr(13)), '…'))) AS n_ellipsis_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN n USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             concat_ws(',', {", ".join(_rule_sql(r) for r in quality.RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 6).alias("block_score"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


JACCARD_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quality.WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c.b, doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN l ON l.a = doc_id
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM d, unnest(range(0, n - 49)) AS u(i) WHERE n >= 50),
f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w HAVING min(doc_id) < max(doc_id)),
s AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w JOIN f USING (w) WHERE doc_id > least),
g AS (SELECT r, i, sum(CASE WHEN before IS NULL OR before + 50 < i THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
x AS (SELECT r, run, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY r, run),
k AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS since FROM x),
p AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS kept, max(hi) AS since, sum(hi - lo) AS removed, count(*) AS spans FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(since, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (r)
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), pii.span_list(F.col("spans")).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytepair.digest(bytepair.decode(bytepair.encode(docs).select("doc_id", "ids"), spelled=False))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') AS t FROM documents),
k AS (SELECT r, doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM k),
p AS (SELECT r, u.t, count(*)::BIGINT AS tf FROM d, unnest(d.t) AS u(t) GROUP BY r, u.t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, docs),
i AS (SELECT DISTINCT item_id, u.t FROM (SELECT item_id, regexp_extract_all(translate(text, '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.TERM}') AS t FROM benchmark) AS b, unnest(b.t) AS u(t)),
f AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
      FROM i JOIN p USING (t) JOIN w USING (t) JOIN k USING (r), s GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM o WHERE rank <= {lexical.BEST}
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal id, bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295)"
TRIE_SQL = f"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', role, text))) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY pos) AS own, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
b AS (SELECT l.conv_id, list_concat(o.own[1:l.h], l.own[l.h + 1:]) AS turns FROM l LEFT JOIN l o ON o.conv_id = l.conv_id - l.conv_id % 5),
m AS (SELECT conv_id, d, turns[1:d] AS node, turns[d].t AS last, len(turns) = d AS ends FROM b, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(min(last)), 0) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, d),
p AS (SELECT a.conv_id AS parent, a.node AS parent_node, count(*) AS n_children FROM n JOIN n a ON a.d = n.d - 1 AND a.node = n.node[1:n.d - 1] WHERE n.d > 0 GROUP BY a.conv_id, a.node),
f AS (SELECT n.*, coalesce(p.n_children, 0) AS n_children FROM n LEFT JOIN p ON p.parent_node = n.node),
s AS (SELECT k, node[1:k] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM f, unnest(range(0, d + 1)) AS u(k) GROUP BY k, node[1:k])
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (node) LEFT JOIN n a ON f.d > 0 AND a.node = f.node[1:f.d - 1] AND a.d = f.d - 1
"""


def queries() -> dict:
    return {"op1_decontamination": op1_decontamination, "op3_ngram_jaccard_join": op3_ngram_jaccard_join, "op4_html_extraction": op4_html_extraction, "op5_suffix_array_dedup": op5_suffix_array_dedup, "op6_pii": op6_pii, "op7_packing": op7_packing, "op8_chat_formatting": op8_chat_formatting, "op9_language_id": op9_language_id, "op2_quality_rules": op2_quality_rules, "op10_url_filters": op10_url_filters, "op11_byte_level_bpe": op11_byte_level_bpe, "op12_ranked_search": op12_ranked_search, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OVERLAP_SQL, "op3_ngram_jaccard_join": JACCARD_SQL, "op5_suffix_array_dedup": REPEATS_SQL, "op2_quality_rules": QUALITY_SQL, "op12_ranked_search": SEARCH_SQL, "op13_prefix_trie": TRIE_SQL}
