"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .alignment import align
from .bytespans import remove_later_repeats
from .chat import format_conversations, read_back
from .decontam import contamination
from .exact import exact_duplicates
from .lm import lm_scores
from .merkle import manifest
from .mixing import mix
from .neardup import near_duplicates
from .quality import quality_scores
from .sharding import shard_rows
from .substring import remove_repeats
from .tokens import token_counts

TOKENIZER = "word_bpe_49k.json"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return read_back(format_conversations(rows.union(more)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shard_rows(rows, SHARDS, by=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(table(spark, sf_dir, "documents"), altered)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later_repeats(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_mixing, op2_minhash_near_dedup, op3_lm_scoring, op4_chat_formatting, op5_token_counts, op6_substring_dedup,
        op7_sharding, op8_decontamination, op9_quality_classifier, op10_exact_dedup, op11_tokenizer_alignment, op12_merkle_manifest,
        op13_suffix_array_dedup, pipeline,
    )
    return {f.__name__: f for f in own}


ORACLES = {
    "op4_chat_formatting": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|>') + length(role) + 1 + length(CASE WHEN regexp_matches(text, '<\|[A-Za-z0-9_]+\|>|<\\+\|') THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op8_decontamination": r"""
        WITH item AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        windows AS (
            SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS gram
            FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)),
        doc AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        lengths AS (SELECT DISTINCT n FROM windows),
        seen AS (
            SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, lengths WHERE len(ws) >= n)),
        hit AS (SELECT seen.doc_id, seen.i, seen.n, windows.item FROM seen JOIN windows USING (n, gram)),
        covered AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(text) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY text)""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, n_chars,
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS ahead,
                coalesce(strlen(text) || ':' || text, '-') AS behind,
                list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]))),
                    lambda crc, b: (xor(crc, b) >> 1) * (1 - (xor(crc, b) & 1)) + xor(xor(crc, b) >> 1, 3988292384) * (xor(crc, b) & 1)) AS crc
            FROM documents),
        hashed AS (
            SELECT doc_id, lang, sha256(ahead || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || behind) AS leaf,
                CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(ahead || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || behind) END AS other
            FROM fields),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM hashed),
        nodes AS (
            SELECT tree, 0 AS level, pos, n, leaf AS node FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
        subroots AS (SELECT tree, node, level FROM nodes WHERE n = 1),
        upper AS (
            SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, node FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
        steps AS (
            SELECT l.tree, l.pos, n.level, (l.pos >> n.level) & 1 AS side, s.node AS sibling
            FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) n ON l.tree = n.tree
            LEFT JOIN nodes s ON s.tree = l.tree AND s.level = n.level AND s.pos = xor(l.pos >> n.level, 1)
            UNION ALL
            SELECT l.tree, l.pos, r.level + u.level, (l.tree >> u.level) & 1, s.node
            FROM leaves l JOIN subroots r ON l.tree = r.tree CROSS JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) u
            LEFT JOIN upper s ON s.level = u.level AND s.pos = xor(l.tree >> u.level, 1)),
        paths AS (SELECT tree, pos, count(*) AS depth, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM steps GROUP BY tree, pos),
        folded AS (
            SELECT tree, pos, 0 AS level, coalesce(other, leaf) AS node FROM leaves
            UNION ALL
            SELECT f.tree, f.pos, f.level + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.node WHEN s.side = 1 THEN s.sibling || f.node ELSE f.node || s.sibling END)
            FROM folded f JOIN steps s ON f.tree = s.tree AND f.pos = s.pos AND f.level = s.level),
        top AS (SELECT node FROM upper WHERE n = 1)
        SELECT l.doc_id, l.leaf, r.node AS subroot, top.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = top.node AS verified
        FROM leaves l JOIN subroots r ON l.tree = r.tree CROSS JOIN top LEFT JOIN paths p ON l.tree = p.tree AND l.pos = p.pos
        JOIN folded f ON f.tree = l.tree AND f.pos = l.pos AND f.level = coalesce(p.depth, 0)""",
    "op13_suffix_array_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        bytes AS (SELECT r, i, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS byte FROM (SELECT r, h, unnest(range(0, strlen(h) // 2)) AS i FROM d)),
        windows AS (
            SELECT r, id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS w
            FROM (SELECT r, id, h, unnest(range(0, greatest(strlen(h) // 2 - 49, 0))) AS i FROM d)),
        hits AS (SELECT r, i FROM (SELECT r, i, id > min(id) OVER (PARTITION BY w) AS hit FROM windows) WHERE hit),
        cover AS (
            SELECT b.r, b.i, byte, coalesce(max(t.i) OVER (PARTITION BY b.r ORDER BY b.i) >= b.i - 49, false) AS gone
            FROM bytes b LEFT JOIN hits t ON b.r = t.r AND b.i = t.i),
        edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM cover),
        counted AS (
            SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
            FROM edged GROUP BY r)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM d LEFT JOIN counted USING (r)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
