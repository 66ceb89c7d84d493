"""The registered queries of the training-data operators (``opN_<name>``) and their DuckDB SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over whole tables; it derives its digest
columns from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.columns import WORD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 24
SHARD_SEED = 17
MIX_SEED = 23


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# unsigned crc32 of a UTF-8 text: the byte table from its rule, then one fold over the bytes
_CRC = """crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT *, hex(encode(coalesce(text, ''))) AS hx FROM documents),
crcs AS (SELECT hexed.*, xor(list_reduce(list_prepend(4294967295,
    list_transform(range(1, len(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM hexed, crc_table)"""


def _uniform(seed: int, digits: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, {digits}))::BIGINT"


@query("op7_interleaved_shards", f"""WITH {_CRC},
ranked AS (SELECT doc_id, source, text, text_crc32, {_uniform(SHARD_SEED, 15)} AS k,
  count(*) OVER (PARTITION BY source) AS ns FROM crcs),
fractions AS (SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 0.5::DOUBLE) / ns) AS f FROM ranked),
placed AS (SELECT *, row_number() OVER (ORDER BY f, k, doc_id, source NULLS LAST) - 1 AS p, count(*) OVER () AS n
  FROM fractions)
SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size, text_crc32, 'rows' AS law,
  (p * {SHARDS} // n)::INTEGER AS shard,
  (p - ((p * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed""")
def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot. Text sizes and checksums are taken once, in the scan, so
    only narrow rows are ranked."""
    from sluice.llm.sharding import interleaved_shards
    from sluice.session import persist_table

    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    narrow = persist_table(spark, narrow, "text-sizes")
    placed = interleaved_shards(spark, narrow, SHARDS, F.col("source"), F.col("doc_id"), SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


_SIZED = f"""sized AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    {_uniform(MIX_SEED, 13)} AS k FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 3 * source_size AS most,
    [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM by_source),
shares AS (SELECT *, sum(source_size) OVER ()::BIGINT AS words,
    (sum(most) OVER o - most)::BIGINT AS most_before, (sum(w) OVER () - sum(w) OVER o + w)::BIGINT AS w_from
  FROM weighed WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
capped AS (SELECT *, most / w <= (words - most_before) / w_from AS is_full FROM shares),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
    (words - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()::BIGINT)
      / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()::BIGINT * w END AS target FROM capped)"""


@query("op8_pareto_mix", f"""WITH {_SIZED},
expected AS (SELECT s.*, t.source_size, t.target,
    least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, floor(e)::BIGINT AS sure, e - floor(e) AS pi, (k + 0.5::DOUBLE) / 4503599627370496 AS u FROM expected),
ranks AS (SELECT *, CASE WHEN pi > 0 THEN (u * (1.0::DOUBLE - pi)) / ((1.0::DOUBLE - u) * pi) END AS q FROM odds),
run AS (SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS FIRST, doc_id NULLS FIRST, size
      ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
    sum(sure * size) OVER (PARTITION BY source)::BIGINT AS sure_words FROM ranks)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= target - sure_words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run""")
def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words the mix takes of every document; words are counted once."""
    from sluice.llm.mixing import pareto_mix, word_count
    from sluice.session import persist_table

    narrow = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    narrow = persist_table(spark, narrow, "word-sizes")
    mixed = pareto_mix(spark, narrow, F.col("source"), F.col("doc_id"), F.col("words"), MIX_SEED)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_WORDS13 = r"""doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size,
    array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS u(i)),
hits AS (SELECT d.doc_id, d.size, d.i, b.item_id FROM doc_windows d JOIN item_windows b ON d.size = b.size AND d.win = b.win),
hit_words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit
  FROM (SELECT DISTINCT doc_id, size, i FROM hits), unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)"""


@query("op10_suffix_array_decontamination", f"""WITH {_WORDS13}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op10_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    from sluice.llm.decontaminate import benchmark_matches, contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_matches(spark, docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


@query("op6_weak_supervision")
def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base filter and posterior verdict of every document."""
    from sluice.llm.rules import base_failed, judged, with_counts
    from sluice.session import persist_table

    counted = with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    verdict = judged(spark, persist_table(spark, counted, "rule-counts"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base_failed().alias("base_failed"), (~base_failed() & F.col("good")).alias("kept"), "p_good")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back whole and digested."""
    import public_tokenizers

    from sluice.llm.token_files import crc32, read_token_files, write_token_files
    from sluice.llm.tokenizers_cached import UnitEncoder
    from sluice.session import scratch_path

    model = public_tokenizers.path("word_bpe_49k.json")
    folder = scratch_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    write_token_files(spark, docs, folder, lambda: UnitEncoder.of(model).encode, 1, F.col("doc_id"), F.col("text"))
    read = read_token_files(spark, folder, crc32, "ids_crc32 long")
    return read.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file")


@query("op3_overlap_token_counts")
def op3_overlap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    from sluice.llm.token_counts import with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op5_co_training_quality")
def op5_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of every document, from the labels."""
    from sluice.llm.quality import fit_quality, scored

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    models = fit_quality(spark, docs, table(spark, sf_dir, "labels"))
    return scored(spark, docs, models).select("doc_id", "p_good", "p_clean", "score", (F.col("score") >= 0.5).alias("kept"))


@query("op4_signature_tree_jaccard")
def op4_signature_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets are nine tenths alike."""
    from sluice.llm.jaccard import similar_documents

    found = similar_documents(spark, table(spark, sf_dir, "documents"), k=3, num=9, den=10)
    return found.withColumnRenamed("id", "doc_id")


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 200 bytes that occur elsewhere."""
    from sluice.llm.suffix_dedup import without_repeats

    return without_repeats(spark, table(spark, sf_dir, "documents"), kept=False).withColumnRenamed("id", "doc_id")


@query("op9_context_mixing")
def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document; four fifths of the documents, by checksum of the id, are
    learned from."""
    from sluice.llm.context_mixing import text_scores

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    found = text_scores(spark, table(spark, sf_dir, "documents"), fold != 1)
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")


_FOLD11 = r"""rows_after AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, crc % 20 AS kind FROM marked), unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(i)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, E' \t\n\x0b\x0c\r') AS t FROM rows_after),
faults AS (SELECT *, substr(role, 1, 1) AS h, CASE WHEN t = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS h0 FROM numbered),
counts AS (SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
    count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
    count(*) FILTER (n > 1 AND h0 || h NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM faults GROUP BY conv_id),
-- states: 0 nothing, 1 system, 2 user, 3 pairs; inserts lead from one to another
inserts(a, b, letters, price) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 5), (1, 2, 'I', 5),
    (3, 2, 'I', 5), (2, 3, 'I', 5), (0, 3, 'II', 10), (1, 3, 'II', 10)),
reads(a, h, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
actions AS (SELECT a, b, h, 'K' AS letter, 0 AS price FROM reads
  UNION ALL SELECT a, b, NULL, 'R', 1 FROM reads WHERE h <> 's'
  UNION ALL SELECT i, i, NULL, 'D', 2 FROM range(4) AS r(i)),
parse AS (
  SELECT conv_id, 0::BIGINT AS n, 0 AS state, {'cost': 0, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.n + 1, x.b, min({'cost': p.best.cost + i.price + x.price
      + CASE WHEN x.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.best.audit || i.letters || x.letter})
  FROM parse p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1
    JOIN inserts i ON i.a = p.state JOIN actions x ON x.a = i.b
  WHERE (x.h IS NULL OR x.h = f.h) AND (x.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY p.conv_id, p.n, x.b),
plans AS (SELECT p.conv_id, min({'cost': p.best.cost + i.price, 'audit': p.best.audit || i.letters}) AS best
  FROM parse p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n_rows = p.n JOIN inserts i ON i.a = p.state
  WHERE i.b IN (0, 3) GROUP BY p.conv_id),
edits AS (SELECT conv_id, k, substr(best.audit, k::INTEGER, 1) AS letter,
    length(replace(substr(best.audit, 1, k::INTEGER), 'I', '')) AS n,
    length(replace(substr(best.audit, 1, k::INTEGER), 'D', '')) AS o FROM plans, unnest(range(1, length(best.audit) + 1)) AS u(k)),
made AS (SELECT e.conv_id, e.k, e.o, e.letter, f.role, f.text, max(CASE WHEN e.letter = 'K' AND e.o = 1 AND f.h = 's' THEN 1 ELSE 0 END)
    OVER (PARTITION BY e.conv_id) AS sys
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n AND e.letter <> 'I' WHERE e.letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM made GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN plans p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id"""

_MARKED11 = """marked AS (SELECT hx.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc
  FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations) hx, crc_table)"""


@query("op11_lr_conversation_repair", f"""WITH RECURSIVE {_CRC.partition("hexed AS")[0].rstrip().rstrip(",")},
{_MARKED11},
{_FOLD11}""")
def op11_lr_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    from sluice.llm.conversations import damaged, ordered_rows, repair_plans

    rows = damaged(table(spark, sf_dir, "conversations"))
    ordered = ordered_rows(rows, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text"), F.col("present"))
    return repair_plans(ordered).withColumnRenamed("conv", "conv_id")


@query("op13_lanczos_whitening")
def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every embedding."""
    from sluice.llm.whitening import whiten

    return whiten(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), 16).withColumnRenamed("key", "vec_id")


@query("op12_host_suffix_html")
def op12_host_suffix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from sluice.llm.html_text import main_text

    found = main_text(spark, table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"), F.col("html"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
