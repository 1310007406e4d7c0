"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evkit.llm.common import lower_ascii, open_table
from evkit.llm.exact_dedup import mark_copies
from evkit.llm.fingerprints import compare_edited, fingerprint_text
from evkit.llm.licenses import scan
from evkit.llm.manifest import COLUMNS, leaf_digest, manifest
from evkit.llm.manifest_sql import MANIFEST_SQL
from evkit.llm.mixing import mix
from evkit.llm.ngram_join import join_near
from evkit.llm.packing import pack
from evkit.llm.personal import find_personal, span_text
from evkit.llm.quality import fit, score
from evkit.llm.registry import QUERIES, SQL, query
from evkit.llm.token_files import read_tokens, write_tokens
from evkit.llm.vector_dedup import link_vectors
from evkit.llm.warc import assemble, payload_bytes, read_records, write_archive
from evkit.llm.whitening import fit_whitening, whiten
from evkit.session import scratch_path, write_once

__all__ = ["QUERIES", "SQL"]

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op4_mix_sources(spark, folder):
    mixed = mix(open_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    f"""
    WITH hashed AS (SELECT doc_id, sha256({LOWER_SQL}) AS text_sha256 FROM documents),
    marked AS (
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, text_sha256
        FROM hashed WINDOW g AS (PARTITION BY text_sha256)
    )
    SELECT *, doc_id = keep_id AS kept FROM marked
    """
)
def op10_exact_dedup(spark, folder):
    marked = mark_copies(open_table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op3_ngram_join(spark, folder):
    found = join_near(open_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op5_packing(spark, folder):
    pieces = pack(open_table(spark, folder, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


@query()
def op6_quality(spark, folder):
    docs = open_table(spark, folder, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, open_table(spark, folder, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query()
def op1_license_scan(spark, folder):
    found = scan(open_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query()
def op7_warc(spark, folder):
    path = scratch_path(spark, "warc")
    write_archive(open_table(spark, folder, "pages"), path)
    # Payloads are compared with their digests as they are read; the report needs their sizes only.
    captures = assemble(write_once(read_records(spark, path).drop("payload"), "records"))
    number = lambda name: F.regexp_extract(name, r":([^:>]*)>$", 1)
    return captures.select(
        number("capture.record_id").cast("long").alias("page_id"),
        payload_bytes().alias("payload_bytes"),
        F.substring("capture.digest", 6, 40).alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        F.when(F.col("capture.refers_to").isNotNull(), number("capture.refers_to").cast("long")).alias("refers_to"),
    )


@query()
def op9_personal_data(spark, folder):
    found = find_personal(open_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(span_text("base_spans").cast("binary"), 256).alias("base_sha256"),
                        span_text("all_spans").alias("spans"))


@query()
def op8_vector_dedup(spark, folder):
    found = link_vectors(open_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query()
def op2_token_files(spark, folder):
    path = scratch_path(spark, "token-files")
    write_tokens(open_table(spark, folder, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op11_fingerprints(spark, folder):
    rows = compare_edited(open_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("vector")).alias("fingerprint"),
        fingerprint_text(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next")


@query(MANIFEST_SQL)
def op12_merkle_manifest(spark, folder):
    docs = open_table(spark, folder, "documents").select(*COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = F.when(F.coalesce(tampered, F.lit(False)), lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proved = manifest(docs, leaf_digest(*[now if c == "text" else F.col(c) for c in COLUMNS]))
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query()
def op13_whitening(spark, folder):
    rows = open_table(spark, folder, "embeddings").select("vec_id", "embedding")
    rows = whiten(rows, fit_whitening(rows))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return each.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("col.whitened").alias("whitened"),
                       F.col("col.explained").alias("explained"), "identity_error")
