"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lattice, minhash, quality, repeats, simhash, tokenfile, urls
from .common import table

#: The rules of the URL query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations and their loss masks."""
    own = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    probe = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], schema)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat.format_conversations(rows)
    read = out.withColumn("turns", chat.parse_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return minhash.edited(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings of earlier documents."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the subword lattice model."""
    return lattice.score(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids stand, read back from Huffman-coded files."""
    return tokenfile.read_files(tokenfile.write_files(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    path = _tokenizer("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url. Pages have no labels but what the rules say of them."""
    return urls.judge(table(spark, sf_dir, "pages"), None, URL_RULES)


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_simhash": op2_simhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_repeats": op4_repeats,
    "op5_quality": op5_quality,
    "op6_lm_score": op6_lm_score,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filters": op10_url_filters,
}
ORACLES: dict[str, str] = {
    "op1_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        m AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS fresh,
                regexp_replace(text, '([<\\[])(\\\\*(?:\\||/?s>|/?INST\\]|</?SYS>>))', '\\1\\\\\\2', 'g') AS esc FROM t),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                sum(length(esc) + CASE WHEN fresh THEN 12 + length(url_encode(role)) + 1 + 11 ELSE 8 END) AS formatted_chars
            FROM m GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
}
