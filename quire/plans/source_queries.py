"""Queries that write files from the driver tables and read them by byte ranges."""

from pyspark.sql import functions as F

from quire.plans.registry import Tables, query
from quire.sources import chunks as C
from quire.sources.scratch import shared_path, write_json_arrays

#: Small, so that the test tables' files are cut inside texts, escapes and strings.
RANGE_BYTES = 1 << 18


@query(
    "chunk_file_scan",
    """SELECT 'c' || doc_id AS row_id, source AS book_id, CAST(doc_id % 300 AS INT) AS page_start, sha256(text) AS h, doc_id % 2 = 0 AS is_front_matter, lang AS language FROM documents""",
)
def chunk_file_scan(t: Tables):
    element = F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("doc_id")).alias("node_id"), F.col("source").alias("book_id"), (F.col("doc_id") % 300).alias("page_start"),
        (F.col("doc_id") % 2 == 0).alias("is_front_matter"), "text", F.create_map(F.lit("language"), F.col("lang")).alias("metadata"),
    ))
    path = shared_path(t.spark, "chunk-files")
    write_json_arrays(t.documents.select(element), path)
    rows = C.scan_chunks(t.spark, path, range_bytes=RANGE_BYTES)
    return rows.select("row_id", "book_id", "page_start", F.sha2("text", 256).alias("h"), "is_front_matter", F.col("metadata")["language"].alias("language"))


@query("page_file_table", "SELECT 'book:p' || page_id AS node_id, page_id AS ord, sha256(html) AS h FROM pages")
def page_file_table(t: Tables):
    """Pages whose HTML stands in ``markdown``, quotes, backslashes and all."""
    path = shared_path(t.spark, "page-files")
    write_json_arrays(t.pages.select(F.to_json(F.struct(F.col("page_id").alias("page"), F.col("html").alias("markdown")))), path)
    return C.page_table(t.spark, path, "book", RANGE_BYTES).select("node_id", "ord", F.sha2("text", 256).alias("h"))
