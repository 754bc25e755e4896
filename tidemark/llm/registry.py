"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, minhash, mixing, negatives, packing, phrases, positives, quality, simhash, tokens, toxicity, urls, warc
from tidemark.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_packages(warc.write_packages(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", *[F.col("measures")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.training_order(mixing.place(table(spark, sf_dir, "documents")))
    return placed.filter(F.col("pass") <= 1).select("doc_id", "size", "source_size", "target", F.col("doc_taken").alias("taken"), F.round("position", 9).alias("position"))


#: A conversation of control strings that stands beside the table's own.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_trees(chat.conversation_tree(rows))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.withColumns({"turns": turns, "loss": loss}).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json")))


#: Documents with more tokens are marked as over the limit.
TOKEN_LIMIT = 2048


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_edits(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


def op12_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = positives.measures_of(table(spark, sf_dir, "documents"))
    out = positives.score(measures, positives.train(measures, table(spark, sf_dir, "labels")))
    return out.select("doc_id", positives.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= positives.BAR, 1).otherwise(0).alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 50 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_warc_packages": op2_warc_packages,
    "op3_quality_rules": op3_quality_rules,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_chat_format": op5_chat_format,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity_cnn": op8_toxicity_cnn,
    "op9_minhash_fingerprints": op9_minhash_fingerprints,
    "op10_url_filter": op10_url_filter,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_quality_pu": op12_quality_pu,
    "op13_hard_negatives": op13_hard_negatives,
}
_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

ORACLE: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
  windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
  twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM windows) WHERE c > 1),
  covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
  m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[{quality.SYMBOLS}]')) AS n_symbols, len(l) AS n_lines,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words FROM w LEFT JOIN covered USING (r)),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.01 AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AS kept
FROM b""",
    "op4_curriculum_mix": rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
  weighted AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
  leveled AS (SELECT *, 3 * source_size / weight AS reach, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
    FROM weighted WINDOW f AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, source_size, weight, CASE WHEN reach > level THEN round(max(CASE WHEN reach > level THEN level END) OVER () * weight, 6) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM leveled),
  laid AS (SELECT s.*, source_size, target, weight, CAST(round(target) AS BIGINT) AS goal, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
  taken AS (SELECT *, greatest(least(goal - start, size), 0) AS t0, greatest(least(goal - start - source_size, size), 0) AS t1, greatest(least(goal - start - 2 * source_size, size), 0) AS t2,
    CASE weight WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.75 END AS a, CASE weight WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.25 END AS b FROM laid)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 + t2 AS BIGINT) AS taken,
  CASE WHEN t0 > 0 THEN round(CASE WHEN a = b THEN start / goal ELSE (sqrt(greatest(a * a + 2 * (b - a) * (start / goal * (a + b) / 2), 0)) - a) / (b - a) + 0.0 END, 9) END AS position FROM taken""",
    "op5_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  f AS (SELECT *, length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '>', '\g')) + length(replace(replace(text, '\', '\e'), '<', '\l')) + 16 AS chars FROM c),
  g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op11_phrase_mining": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
  g AS (SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, w, count(*) AS a FROM g GROUP BY ALL),
  t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
  inside AS (SELECT lang, w, max(b) AS b FROM (SELECT lang, w[i:j] AS w, a AS b FROM (SELECT lang, w, k, a, i, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k) GROUP BY ALL),
  cuts AS (SELECT c.lang, c.k, c.w, c.a, j, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * c.a // (l.a + r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f l ON l.lang = c.lang AND l.w = c.w[:j] JOIN f r ON r.lang = c.lang AND r.w = c.w[j + 1:]),
  lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, j) = 1),
  kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, w) WHERE b IS NULL OR 100 * b < 80 * a),
  ranked AS (SELECT *, array_to_string(w, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(w, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t USING (lang) WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
