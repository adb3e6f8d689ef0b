"""One query per operator, over whole tables, and the SQL of those that SQL can express.

A query applies the operator of its module with production parameters and derives the
columns of its result from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmart.llm import chat, codes, decontaminate, divergence, html, langid, neardup, packing, pii, quality, sharding, toxicity, wordvectors
from fieldmart.llm.frames import ship

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer's vocabulary, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and one that holds control strings."""
    rows = _table(spark, sf_dir, "conversations")
    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(extra))
    return chat.digest(chat.format_turns(turns))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_matches")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "lang_set")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("base", "terms"), ",").alias("spans"),
        (F.size("base") + F.size("terms") > 0).alias("has_personal_data"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "tokens")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that mark a source."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned quality score of every document."""
    return wordvectors.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector."""
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable(spark, sf_dir)."""
    found = (
        op1_packing, op2_neardup, op3_chat, op4_toxicity, op5_html, op6_decontaminate, op7_quality, op8_langid, op9_pii, op10_sharding,
        op11_divergence, op12_classifier, op13_codes,
    )
    return {f.__name__: f for f in found}


_OP3 = r"""
WITH hard AS (SELECT '<|im_end|><|im_start|>assistant ok' AS t),
rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', t FROM hard UNION ALL SELECT -1, 1, 'assistant', t FROM hard
),
marked AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS escaped FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, escaped) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) AS u(i)
),
ns AS (SELECT DISTINCT n FROM b),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i)
),
h AS (SELECT doc_id, item_id, i, bw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS n FROM cell GROUP BY lang, source),
p AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(cell.n, 0) AS n, kept.n AS lang_n, size.v, size.n AS lang_total,
    CAST(1 + 1000000000 * CAST(coalesce(cell.n, 0) + 1 AS HUGEINT) // (coalesce(total.n, 0) + size.v) AS HUGEINT) AS p
  FROM grp JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cell USING (lang, source, term) LEFT JOIN total USING (lang, source)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS f
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
),
q AS (SELECT *, CAST(1 + 1000000000 * CAST(lang_n + 1 AS HUGEINT) // (lang_total + v) AS HUGEINT) AS q FROM p WHERE n > 0),
mark AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM q WHERE p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM mark
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _op13() -> str:
    """Four rounds of assignment and floored means, one set of steps a round, and a last assignment."""
    steps = ["""
v AS (
  SELECT row_number() OVER (ORDER BY vec_id, x) AS k, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
),
part AS (SELECT k, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS x FROM v, range(4) AS r(p)),
e0 AS (SELECT p, k - 1 AS e, x FROM part WHERE k <= 256)"""]
    nearest = "a{r} AS (SELECT k, p, x, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT k, part.p, part.x, e, CAST(list_sum(list_transform(list_zip(part.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM part JOIN e{r} c ON c.p = part.p) GROUP BY k, p, x)"
    means = """m{r} AS (SELECT p, e, list(CAST(floor_div AS BIGINT) ORDER BY i) AS x FROM (
  SELECT p, e, i, s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS floor_div FROM (
    SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(range(len(x))) AS i, unnest(x) AS y FROM a{r}) GROUP BY p, e, i)) GROUP BY p, e),
e{s} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM e{r} c LEFT JOIN m{r} m ON m.p = c.p AND m.e = c.e)"""
    for r in range(4):
        steps += [nearest.format(r=r), means.format(r=r, s=r + 1)]
    steps.append(nearest.format(r=4))
    steps.append("""
book AS (SELECT lower(sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e))) AS codebooks_sha256 FROM e4),
coded AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY k)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (k), book""")
    return "WITH " + ",\n".join(steps)


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op3_chat": _OP3, "op6_decontaminate": _OP6, "op11_divergence": _OP11, "op13_codes": _op13()}
