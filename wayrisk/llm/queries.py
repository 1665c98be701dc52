"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.llm import sql_twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

END_ID = 2


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import decontaminate

    found = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "similarity")


@query
def op2_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import simhash_dedup

    found = simhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash_dedup.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from wayrisk.llm import sentencepiece_codec as codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    return codec.digests(codec.round_trip(table(spark, folder, "documents"), path))


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from wayrisk.llm import token_files

    path = public_tokenizers.path("byte_bpe_50k.json")
    read = token_files.round_trip(table(spark, folder, "documents"), path, END_ID)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import url_rules

    return url_rules.judge_urls(table(spark, folder, "pages"), keep=["page_id"])


def _op5_sql() -> str:
    from wayrisk.llm import url_rules

    def cases(value) -> str:
        rules = sorted(url_rules.HOST_RULES, key=lambda r: (-len(r.name), r.name))
        fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
        return "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{value(r)}'" for r in rules) + " END"

    def any_of(allow: bool) -> str:
        return "(" + " OR ".join(f"regexp_matches(low, '{p.regex}', 's')" for p in url_rules.PATTERN_RULES if p.allow == allow) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
        CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    hosts AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts),
    places AS (SELECT page_id, low, translate(raw_host, '{upper}', '{lower}') AS host,
        regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts)
    SELECT page_id, host, path, {cases(lambda r: r.name)} AS rule,
      coalesce({cases(lambda r: 'allow' if r.allow else 'block')},
        CASE WHEN NOT {any_of(True)} AND {any_of(False)} THEN 'block' ELSE 'allow' END) AS verdict
    FROM places"""


SQL["op5_url_filter"] = _op5_sql()


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import license_scan

    found = license_scan.scan(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "duties")


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import quality_rules

    docs = table(spark, folder, "documents")
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality_rules.judge(docs, quality_rules.bucket_weights(docs, trusted), keep=["doc_id"])


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import suffix_dedup

    found = suffix_dedup.repeated(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import warc

    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import language_id

    docs = table(spark, folder, "documents")
    learned = language_id.fit(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    held = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.classify(held, learned, keep=["doc_id", "held_out"])


@query
def op11_lz_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import lz_fingerprint

    return lz_fingerprint.edited_likeness(table(spark, folder, "documents"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import whitening

    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from wayrisk.llm import collocations

    return collocations.collocations(table(spark, folder, "documents"))


SQL.update(op1_decontaminate=sql_twins.OP1, op8_suffix_dedup=sql_twins.OP8, op9_warc=sql_twins.OP9, op13_collocations=sql_twins.OP13)
