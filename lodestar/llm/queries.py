"""The ten operators as queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aq, chat, dac, lthash, packing, simhash, substring, toxicity, trie_bpe, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def trie_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.deduplicated_archives(spark, table(spark, sf_dir, "pages")))


def additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aq.nearest(spark, table(spark, sf_dir, "embeddings"), every=50, k=5)


def multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lthash.fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(own.union(extra)))


def direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def substring_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_trie_encoding": trie_encoding,
    "op3_warc_revisits": warc_revisits,
    "op4_additive_quantisation": additive_quantisation,
    "op5_multiset_fingerprints": multiset_fingerprints,
    "op6_toxicity_chain": toxicity_chain,
    "op7_simhash_components": simhash_components,
    "op8_chat_formatting": chat_formatting,
    "op9_direct_codes": direct_codes,
    "op10_substring_windows": substring_windows,
}

ORACLES: dict[str, str] = {
    "op3_warc_revisits": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op8_chat_formatting": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*/?s>|\\*</?SYS>>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g') AS escaped FROM c)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
               sum(length(escaped) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 8 ELSE 22 + length(role) END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op10_substring_windows": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        n AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS a, words FROM w WHERE len(words) >= 35),
        k AS (SELECT doc_id, a, sha256(array_to_string(words[a : a + 34], ' ')) AS h FROM n),
        r AS (SELECT doc_id, a FROM (SELECT doc_id, a, count(*) OVER (PARTITION BY h) AS times FROM k) WHERE times > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 35)) AS i FROM r),
        p AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
        o AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN p USING (doc_id)),
        v AS (SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed FROM o),
        u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        t AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
        SELECT v.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM v LEFT JOIN t USING (doc_id)""",
}
