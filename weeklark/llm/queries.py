"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprints, html, jaccard, langid, linededup, packing, secrets, sharding
from .common import ensure_importable, table

ensure_importable()

#: The conversation that the contract adds: both turns say this.
PLANTED = "</s>[INST] ok [/INST]"


def tokenizer_path() -> str:
    """Default of the packing query; the file stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, table(spark, sf_dir, "benchmark")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.classify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    # On its own: a conversation of the table that is called -1 stays another one.
    return chat.digest(chat.format_chats(rows).unionByName(chat.format_chats(added)))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return placed.select("doc_id", "slot", "shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_fingerprints": op5_fingerprints,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_chat_format": op9_chat_format,
    "op10_shard": op10_shard,
}


def _shard_sql() -> str:
    owners = ",".join(map(str, sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.N_SHARDS)])))
    return f"""
        WITH owners AS (SELECT string_split('{owners}', ',') AS owner),
        slots AS (
            SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, {sharding.DIGEST_DIGITS}))::BIGINT % {sharding.TABLE_SIZE} AS slot
            FROM documents)
        SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM slots, owners
    """


# Two reparses and escapes collapse to a rule here: a conversation is escaped if any of its texts or roles holds a backslash or a control string.
CHAT_SQL = rf"""
    WITH rows AS (
        SELECT conv_id, FALSE AS planted, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, TRUE, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, TRUE, 1, 'assistant', '{PLANTED}'),
    marked AS (
        SELECT *, bool_or(regexp_matches(role || ' ' || text, '\\|</?s>|\[/?INST\]')) OVER (PARTITION BY conv_id, planted) AS escaped FROM rows),
    sized AS (
        SELECT *, length(role) + length(text) + length('<s>') + length(' [INST] ') + length(' [/INST]</s>')
            + CASE WHEN escaped THEN len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]')) ELSE 0 END AS size
        FROM marked)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(size) AS BIGINT) AS formatted_chars, TRUE AS round_trip
    FROM sized GROUP BY conv_id, planted
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES_SQL = rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
        FROM documents),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
    frequent AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {linededup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {linededup.MIN_DOCS}),
    judged AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
"""

DECONTAMINATE_SQL = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    windows AS (
        SELECT item, n, array_to_string(w[i : i + n - 1], ' ') AS words
        FROM (SELECT item, w, least({decontam.WIDTH}, len(w)) AS n, unnest(range(1, len(w) - least({decontam.WIDTH}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    lengths AS (SELECT DISTINCT n FROM windows),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
    found AS (
        SELECT p.doc_id, p.i, p.n, v.item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM places) p
        JOIN windows v ON v.n = p.n AND v.words = p.words),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontam.ONE_IN} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": DECONTAMINATE_SQL, "op7_line_dedup": LINES_SQL, "op9_chat_format": CHAT_SQL, "op10_shard": _shard_sql()}
