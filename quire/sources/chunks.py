"""Chunk and page sources, flat node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quire.functions import text as T
from quire.operators.findings import union_all
from quire.sources.ranges import RANGE_BYTES, scan_elements

# ---------------------------------------------------------------------------
# Fixed values
WRAPPER_KEYS = ["chunks", "nodes", "items"]
LOOKUP_ID_ORDER = ["node_id", "chunk_id", "id"]
CONTRACT_ID_ORDER = ["node_id", "id", "chunk_id"]
PAGE_KEYS = ["page_label", "page_number", "page"]
PAGE_MARKER = r"<!--\s*page\s+(\d+)\s*-->"
NODE_METADATA = [
    "source_pdf", "source_type", "book_id", "book_title", "domain", "grade", "chapter", "chapter_number",
    "chapter_source_chunk_id", "chapter_source_page", "is_front_matter", "section", "section_page_start",
    "section_source", "section_confidence", "section_level", "topic", "content_type", "page_start", "page_end",
]
# ---------------------------------------------------------------------------

CHUNK = Ty.StructType(
    [
        Ty.StructField(n, t)
        for n, t in [
            ("node_id", Ty.StringType()), ("chunk_id", Ty.StringType()), ("id", Ty.StringType()),
            ("source_pdf", Ty.StringType()), ("source_type", Ty.StringType()), ("domain", Ty.StringType()),
            ("grade", Ty.StringType()), ("book_id", Ty.StringType()), ("book_title", Ty.StringType()),
            ("chapter", Ty.StringType()), ("chapter_number", Ty.IntegerType()), ("section", Ty.StringType()),
            ("topic", Ty.StringType()), ("content_type", Ty.StringType()), ("page_start", Ty.IntegerType()),
            ("page_end", Ty.IntegerType()), ("is_front_matter", Ty.BooleanType()), ("text", Ty.StringType()),
            ("metadata", Ty.MapType(Ty.StringType(), Ty.StringType())),
        ]
    ]
)


def row_id(order: list[str] = LOOKUP_ID_ORDER) -> Column:
    """First non-blank id field; lookup and contract look in different orders."""
    return F.coalesce(*[F.when(~T.blank(c), T.strip(c)) for c in order])


def scan_chunks(spark: SparkSession, path: str, id_order: list[str] = LOOKUP_ID_ORDER, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Chunk rows of JSON files, an array or a wrapper object each (S1), read by byte ranges: a large file is many tasks.

    ``ord`` is the place in the file. A file whose brackets or strings are not closed gives no rows; ``scan_problems``
    lists such files where whole documents are at hand.
    """
    return _chunk_rows(scan_elements(spark, path, range_bytes), id_order)


def _chunk_rows(raw: DataFrame, id_order: list[str]) -> DataFrame:
    rows = raw.select("file", F.col("ord").cast("long").alias("ord"), F.from_json("raw", CHUNK).alias("c")).select("file", "ord", "c.*")
    return rows.withColumn("row_id", row_id(id_order))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document"))


def _collection(document: Column) -> Column:
    """The array of raw chunk objects: the document itself or the first wrapper key that holds any."""
    items = [F.get_json_object(document, f"$.{k}") for k in WRAPPER_KEYS]
    picked = F.coalesce(*[F.when(~i.isin("[]", "null", "", "{}"), i) for i in items])
    source = F.when(F.startswith(F.ltrim(document), F.lit("[")), document).otherwise(picked)
    return F.from_json(source, "array<string>")


def explode_chunks(files: DataFrame, id_order: list[str] = LOOKUP_ID_ORDER) -> DataFrame:
    """files: (file, document)."""
    return _chunk_rows(files.select("file", F.posexplode(_collection(F.col("document"))).alias("ord", "raw")), id_order)


def scan_problems(files: DataFrame) -> DataFrame:
    """Files without a usable chunk list and rows that are no objects."""
    items = _collection(F.col("document"))
    empty = files.filter(F.coalesce(F.size(items), F.lit(0)) <= 0).select("file", F.lit("NO_CHUNKS").alias("code"), F.lit(None).cast("long").alias("ord"))
    odd = files.select("file", F.posexplode(items).alias("ord", "raw")).filter(~F.startswith(F.ltrim("raw"), F.lit("{"))).select(
        "file", F.lit("NOT_AN_OBJECT").alias("code"), F.col("ord").cast("long").alias("ord")
    )
    return empty.unionByName(odd)


def page_table(spark: SparkSession, path: str, slug: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One chunk per ``{page, markdown}`` entry of JSON array files, read by byte ranges."""
    entry = F.from_json("raw", "struct<page:int,markdown:string,text:string>").alias("p")
    rows = scan_elements(spark, path, range_bytes).select("file", entry).select("file", "p.*")
    return page_chunks(rows.select("file", "page", F.coalesce(F.when(F.col("markdown") != "", F.col("markdown")), "text", F.lit("")).alias("text")), slug)


def marked_pages(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Pages of texts that carry page markers (S2): the text between a marker and the next."""
    marks = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(1))
    parts = F.split(text, PAGE_MARKER, -1)
    zipped = F.zip_with(marks, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda m, p: F.struct(m.cast("int").alias("page"), p.alias("text")))
    return texts.select(*keep, F.explode(zipped).alias("p")).select(*keep, "p.page", "p.text")


def page_chunks(pages: DataFrame, slug: str | Column) -> DataFrame:
    prefix = F.lit(slug) if isinstance(slug, str) else slug
    return pages.withColumn("node_id", F.concat(prefix, F.lit(":p"), F.col("page").cast("string"))).withColumn("ord", F.col("page").cast("long"))


def page_number(metadata: Column, ordinal: Column) -> Column:
    """First page-like metadata value that holds a number, else the ordinal (S3)."""
    found = [
        F.when(F.regexp_extract(F.coalesce(F.element_at(metadata, F.lit(k)), F.lit("")), r"(\d+)", 1) != "",
               F.regexp_extract(F.element_at(metadata, F.lit(k)), r"(\d+)", 1).try_cast("int"))
        for k in PAGE_KEYS
    ]
    return F.coalesce(*found, ordinal.cast("int"))


def chunks_of_pages(pages: DataFrame, path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """One chunk per input page (S3). pages: (path, ordinal from 1, text, metadata map)."""
    stem = T.file_stem(path)
    page = page_number(F.col("metadata"), F.col(ordinal))
    return pages.select(
        F.concat(stem, F.format_string("_chunk_%03d", F.col(ordinal).cast("int"))).alias("id"),
        F.col(path).alias("source_pdf"), F.lit("pdf").alias("source_type"), stem.alias("book_id"), stem.alias("book_title"),
        F.lit("unknown").alias("content_type"), page.alias("page_start"), page.alias("page_end"), "text", "metadata",
        F.col(ordinal).cast("long").alias("ord"),
    )


def flat_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks with ``boundary_cleanup`` as scalar columns."""
    b = lambda n: F.col(f"boundary_cleanup.{n}")
    keep = [c for c in ["doc", *NODE_METADATA] if c in chunks.columns]
    n = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return chunks.select(
        F.col("id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), *keep,
        yes(b("applied")).alias("boundary_cleanup_applied"),
        n(b("prefix_trimmed_chars")).alias("boundary_cleanup_prefix_trimmed_chars"),
        n(b("suffix_trimmed_chars")).alias("boundary_cleanup_suffix_trimmed_chars"),
        b("start_heading").alias("boundary_cleanup_start_heading"), yes(b("start_heading_found")).alias("boundary_cleanup_start_heading_found"),
        b("end_heading").alias("boundary_cleanup_end_heading"), yes(b("end_heading_found")).alias("boundary_cleanup_end_heading_found"),
        F.greatest(n(F.size(b("warnings"))), F.lit(0)).alias("boundary_cleanup_warning_count"),
    )


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Node table by chapter, so that a chapter filter prunes folders.

    A random salt beside the chapter keeps one large chapter from being written by one task.
    """
    spread = nodes.repartition(F.col("chapter_number"), F.pmod(F.xxhash64("node_id"), F.lit(32)))
    spread.write.mode("overwrite").partitionBy("chapter_number").parquet(path)


def derive_chunks(materials: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean chunks, refusals) from chapter materials.

    materials: (material_id, source_pdf, chapter_numbers array<int>); chunks: (material_id, i, node_id, text). A material
    with any fault gives no chunks; all faults are listed.
    """
    numbers = F.array_distinct("chapter_numbers")
    per_id = chunks.filter(~T.blank("node_id")).groupBy("material_id", T.strip("node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    held = chunks.select("material_id").distinct()
    row = lambda df, code, detail="": df.select("material_id", F.lit(code).alias("code"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    faults = union_all(
        [
            row(materials.filter(T.blank("source_pdf")), "NO_SOURCE_DOCUMENT"),
            row(materials.filter(F.coalesce(F.size(numbers), F.lit(0)) <= 0), "NO_CHAPTER"),
            row(materials.filter(F.size(numbers) > 1), "AMBIGUOUS_CHAPTER"),
            row(materials.join(held, "material_id", "left_anti"), "NO_CHUNKS"),
            row(chunks.filter(T.blank("node_id")), "NO_NODE_ID", F.col("i").cast("string")),
            row(per_id.filter("n > 1"), "DUPLICATE_NODE_ID", F.col("node_id")),
            row(chunks.filter(T.blank("text")), "BLANK_TEXT", F.coalesce("node_id", F.lit(""))),
        ]
    )
    good = materials.join(faults.select("material_id").distinct(), "material_id", "left_anti")
    clean = chunks.join(good.select("material_id", "source_pdf", numbers[0].alias("chapter_number")), "material_id").select(
        T.strip("node_id").alias("node_id"), "source_pdf", "chapter_number", "text", "material_id"
    )
    return clean, faults
