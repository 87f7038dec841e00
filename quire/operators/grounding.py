"""Evidence joins: citations, quotes, approvals, normalised claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.ordered import first_per_key, salted_join
from quire.operators.findings import union_all
from quire.operators.patterns import find_patterns
from quire.sources.scratch import written

# ---------------------------------------------------------------------------
# Fixed values
MIN_QUOTE_WORDS = 4
MAX_QUOTE_WORDS = 80
QUOTES_PER_CHUNK = 12
SENTENCE_END = r"(?<=[.!?])\s+"
QUOTE_BREAK = r"(?<=[.!?])\s+|\s+•\s+"
GENERATED_KINDS = [
    "pedagogical_example", "practice_question", "practice_answer", "learner_instruction", "self_assessment",
    "study_plan", "misconception_statement",
]
HIGH_RISK_KINDS = ["official_rule", "task_format", "pronunciation_rule", "grammar_rule"]
NO_CITATION = "The model did not provide a valid local source citation for this field."
NO_SPAN = "The model did not provide a valid exact evidence span for this source_grounded claim."
NO_SPAN_HIGH_RISK = "The model did not provide a valid exact evidence span for this high-risk claim."
WRONG_KIND = "The model used pedagogical_generation for a claim kind that requires source evidence."
NOT_ENOUGH = "The local source evidence was insufficient for this field."
REPAIRABLE = ["PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED"]
# ---------------------------------------------------------------------------


def citation_errors(bridge: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per cited id with its errors.

    bridge: (claim_id, scope, chapter_number, expected_pdf, node_id); chunks: (node_id,
    text, source_pdf, chapter_number). Checks that hold together are all reported.
    """
    side = chunks.select(
        "node_id", F.lit(True).alias("__found"), T.blank("text").alias("__blank"),
        T.strip("source_pdf").alias("__pdf"), T.int_or_null("chapter_number").alias("__chapter"),
    )
    joined = bridge.join(side, "node_id", "left")
    wrong_pdf = (T.strip("expected_pdf") != "") & (F.col("__pdf") != "") & (T.strip("expected_pdf") != F.col("__pdf"))
    wrong_chapter = (F.col("scope") == "chapter") & (F.col("__chapter") != F.col("chapter_number"))
    codes = F.filter(
        F.array(
            F.when(F.col("__found").isNull(), F.lit("UNRESOLVED")),
            F.when(F.col("__blank"), F.lit("EMPTY_TEXT")),
            F.when(wrong_pdf, F.lit("DOCUMENT_MISMATCH")),
            F.when(wrong_chapter, F.lit("CHAPTER_MISMATCH")),
        ),
        lambda c: c.isNotNull(),
    )
    return joined.select("claim_id", "node_id", F.explode(codes).alias("code"))


def evidence_set(bridge: DataFrame, chunks: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Distinct evidence chunks with the place of their first citation."""
    firsts = bridge.groupBy(doc, "node_id").agg(F.min(order).alias("first_cited"), F.count(F.lit(1)).alias("citations"))
    return firsts.join(chunks, "node_id")


def source_id_errors(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """Integrity of id arrays (G6). claims: (claim_id, json_path, chapter_number, book_pdf, ids)."""
    rows = claims.select("claim_id", "json_path", "chapter_number", "book_pdf", F.posexplode("ids").alias("i", "raw"))
    rows = rows.withColumn("node_id", T.strip("raw"))
    blank = rows.filter(F.coalesce("node_id", F.lit("")) == "").select(
        "claim_id", F.lit("SOURCE_CHUNK_ID_NOT_FOUND").alias("code"),
        F.concat("json_path", F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("json_path"), "node_id",
    )
    real = rows.filter(F.coalesce("node_id", F.lit("")) != "")
    repeats = real.groupBy("claim_id", "json_path", "node_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "claim_id", F.lit("DUPLICATE_SOURCE_CHUNK_ID").alias("code"), "json_path", "node_id"
    )
    bridge = real.select(
        "claim_id", "json_path", F.lit("chapter").alias("scope"), "chapter_number", F.col("book_pdf").alias("expected_pdf"), "node_id"
    )
    names = F.create_map(
        *[F.lit(x) for x in ("UNRESOLVED", "SOURCE_CHUNK_ID_NOT_FOUND", "DOCUMENT_MISMATCH", "SOURCE_DOCUMENT_MISMATCH",
                             "CHAPTER_MISMATCH", "CHAPTER_MISMATCH")]
    )
    keyed = bridge.withColumn("claim_id", F.struct("claim_id", "json_path"))
    joined = citation_errors(keyed, chunks).filter(F.col("code") != "EMPTY_TEXT").select(
        F.col("claim_id.claim_id").alias("claim_id"), F.element_at(names, F.col("code")).alias("code"),
        F.col("claim_id.json_path").alias("json_path"), "node_id",
    )
    return union_all([blank, repeats, joined])


def verify_spans(spans: DataFrame, chunks: DataFrame, normalise=T.contract_text) -> DataFrame:
    """Each evidence span with all its errors and whether it is verified.

    spans: (claim_id, i, node_id, quote, source_ids); chunks: (node_id, text). The join is
    on the node id; containment is tested only inside the joined pair.
    """
    clean = spans.withColumn("node_id", T.strip("node_id")).withColumn("__q", normalise(F.col("quote")))
    firsts = clean.groupBy("claim_id", "node_id", "__q").agg(F.min("i").alias("__first"))
    side = chunks.select("node_id", F.lit(True).alias("__found"), normalise(F.col("text")).alias("__t"))
    joined = clean.join(firsts, ["claim_id", "node_id", "__q"], "left").join(side, "node_id", "left")
    words = T.word_count("__q")
    empty_node = F.coalesce("node_id", F.lit("")) == ""
    empty_quote = T.blank("quote")
    usable = ~empty_node & ~empty_quote
    cited = F.coalesce(F.array_contains("source_ids", F.col("node_id")), F.lit(False))
    missing = F.col("__found").isNull()
    absent = ~missing & ~F.coalesce(F.contains("__t", F.col("__q")), F.lit(True))
    code = lambda cond, name: F.when(cond, F.lit(name))
    codes = F.filter(
        F.array(
            code(empty_node, "SOURCE_CHUNK_ID_NOT_FOUND"),
            code(~empty_node & empty_quote, "EVIDENCE_SPAN_QUOTE_TOO_SHORT"),
            code(usable & (F.col("i") > F.col("__first")), "DUPLICATE_EVIDENCE_SPAN"),
            code(usable & ~cited, "EVIDENCE_SPAN_NODE_NOT_CITED"),
            code(usable & (words < MIN_QUOTE_WORDS), "EVIDENCE_SPAN_QUOTE_TOO_SHORT"),
            code(usable & (words > MAX_QUOTE_WORDS), "EVIDENCE_SPAN_QUOTE_TOO_LONG"),
            code(usable & missing, "SOURCE_CHUNK_ID_NOT_FOUND"),
            code(usable & absent, "EVIDENCE_SPAN_QUOTE_NOT_FOUND"),
        ),
        lambda c: c.isNotNull(),
    )
    verified = usable & cited & words.between(MIN_QUOTE_WORDS, MAX_QUOTE_WORDS) & ~missing & ~absent
    return joined.select("claim_id", "i", "node_id", "quote", codes.alias("codes"), verified.alias("verified"), (F.col("i") == F.col("__first")).alias("first_use"))


def sentences(text: Column) -> Column:
    """Trimmed sentences; an end mark must be followed by white space."""
    return F.filter(F.transform(F.split(text, f"(?U){SENTENCE_END}"), T.strip), lambda s: s != "")


def _inner_pairs(norm: Column) -> Column:
    """Neighbouring word pairs without the first and last word.

    A quote may start or end inside a word of the source, so only these pairs are sure to
    stand as whole words in any text that contains it. Four words give at least one pair.
    """
    w = F.split(norm, " ")
    return _pairs(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))))


def _all_pairs(norm: Column) -> Column:
    return _pairs(F.split(norm, " "))


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def locate_quotes(quotes: DataFrame, chunks: DataFrame, scope: list[str], order: str = "ord") -> DataFrame:
    """First chunk (by ``order``) of the scope that contains each quote (G7, G8, Q13 at corpus size).

    quotes: (quote_id, norm, *scope), of any length; chunks: (node_id, norm,
    order, *scope), both in the same normal form. Quotes of one to three words have no inner word pair
    and are found by their rarest inner word or a piece of a word (``find_patterns``); an empty one is
    nowhere. Of longer ones no pair of a quote and a chunk is formed unless they share the
    quote's rarest inner word pair:

    1. equal texts are kept once, with their first place, so copies cost nothing more;
    2. word pairs of the chunks are kept only where some quote has them;
    3. each quote looks up its rarest pair, and containment is tested on those candidates.

    A quote one of whose pairs is nowhere in the scope is nowhere itself.
    """
    hashed = chunks.select(*scope, order, "node_id", "norm").withColumn("__h", F.xxhash64("norm"))
    texts = written(first_per_key(hashed, [*scope, "__h", "norm"], [order]), "texts")  # several uses, some in jobs of their own
    pairs_inside = F.size(F.split("norm", " ")) >= 4
    short, quotes = quotes.filter(~pairs_inside), quotes.filter(pairs_inside)
    grams = quotes.select("quote_id", *scope, "norm", F.explode(_inner_pairs(F.col("norm"))).alias("pair"))
    needed = grams.select(*scope, "pair").distinct()
    postings = texts.select(*scope, "node_id", F.explode(_all_pairs(F.col("norm"))).alias("pair")).join(needed, [*scope, "pair"], "left_semi")
    frequency = postings.groupBy(*scope, "pair").agg(F.count(F.lit(1)).alias("__df"))
    rarest = (
        grams.select("quote_id", *scope, "pair")
        .join(frequency, [*scope, "pair"], "left")
        .groupBy("quote_id", *scope)
        .agg(F.min_by("pair", F.struct(F.coalesce("__df", F.lit(0)), "pair")).alias("pair"), F.min(F.coalesce("__df", F.lit(0))).alias("__df"))
        .filter("__df > 0")
        .drop("__df")
    )
    candidates = salted_join(postings, rarest, [*scope, "pair"], "inner", F.col("node_id")).select("quote_id", *scope, "node_id")
    verified = (
        candidates.join(texts.select(*scope, "node_id", order, F.col("norm").alias("__t")), [*scope, "node_id"])
        .join(quotes.select("quote_id", F.col("norm").alias("__q")), "quote_id")
        .filter(F.contains("__t", F.col("__q")))
        .select("quote_id", "node_id", order)
    )
    places = texts.select(*scope, F.col("node_id").alias("text_id"), "norm", order)
    brief = find_patterns(short.select(F.col("quote_id").alias("pattern_id"), "norm", *scope), places.drop(order), scope)
    brief = brief.join(places.drop("norm"), ["text_id", *scope]).select(F.col("pattern_id").alias("quote_id"), F.col("text_id").alias("node_id"), order)
    return verified.unionByName(brief).groupBy("quote_id").agg(F.min_by("node_id", order).alias("node_id"), F.min(order).alias(order))


def cover_claims(claims: DataFrame, chunks: DataFrame, scope: list[str], order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(spans, verdicts): every sentence of a claim found in its chapter, else insufficient.

    claims: (claim_id, text, *scope); chunks: (node_id, text, order, *scope).
    """
    parts = claims.select("claim_id", *scope, F.posexplode_outer(sentences(F.coalesce("text", F.lit("")))).alias("i", "quote"))
    parts = parts.withColumn("norm", T.match_text("quote")).withColumn("quote_id", F.struct("claim_id", "i"))
    fits = T.word_count("norm").between(MIN_QUOTE_WORDS, MAX_QUOTE_WORDS)
    found = locate_quotes(
        parts.filter(fits).select("quote_id", *scope, "norm"),
        chunks.select(*scope, order, "node_id", T.match_text(F.coalesce("text", F.lit(""))).alias("norm")),
        scope, order,
    )
    joined = parts.join(found, "quote_id", "left")
    spans = joined.select("claim_id", "i", "node_id", "quote")
    verdict = joined.groupBy("claim_id").agg(
        F.bool_and(F.coalesce(fits & F.col("node_id").isNotNull(), F.lit(False))).alias("covered"),
        F.count("quote").alias("sentences"),
    )
    ok = verdict.filter("covered").select("claim_id")
    return spans.join(ok, "claim_id", "left_semi"), verdict.select(
        "claim_id", F.when(F.col("covered"), "source_grounded").otherwise("insufficient_source_evidence").alias("origin"), "sentences"
    )


def text_derivation(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """exact_source_text, source_paraphrase or the record's own origin.

    records: (record_id, origin, text, source_chunk_ids); chunks: (node_id, text).
    """
    pairs = (
        records.filter((F.col("origin") == "source_grounded") & ~T.blank("text"))
        .select("record_id", T.squash("text").alias("__q"), F.explode("source_chunk_ids").alias("node_id"))
        .join(chunks.select("node_id", T.squash("text").alias("__t")), "node_id")
        .groupBy("record_id")
        .agg(F.bool_or(F.contains("__t", F.col("__q"))).alias("__exact"))
    )
    kind = (
        F.when(F.col("origin").isin("pedagogical_generation", "insufficient_source_evidence"), F.col("origin"))
        .when(F.col("__exact"), "exact_source_text")
        .otherwise("source_paraphrase")
    )
    return records.join(pairs, "record_id", "left").withColumn("text_derivation", kind).drop("__exact")


def quote_bank(chunks: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Quotable sentences of each chunk, first twelve distinct ones (G10). Row-local."""
    keep = keep or ["node_id"]
    parts = F.transform(F.split(T.squash("text"), f"(?U){QUOTE_BREAK}"), T.strip)
    good = F.filter(parts, lambda p: T.word_count(p).between(MIN_QUOTE_WORDS, MAX_QUOTE_WORDS))
    first = F.slice(F.array_distinct(good), 1, QUOTES_PER_CHUNK)
    return chunks.select(*keep, F.posexplode(first).alias("i", "quote")).select(
        *keep, (F.col("i") + 1).alias("position"),
        F.concat("node_id", F.format_string(".quote_%02d", F.col("i") + 1)).alias("quote_id"), "quote",
    )


def claim_hash(text: Column) -> Column:
    """Identity of the exact words."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(text.cast("binary"), 256), F.lit(32)))


def source_revision(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Identity of the ids and texts of a group of chunks.

    Row hashes are added up, so no order and no gathering is needed and any group combines
    map-side: the count and two sums of independent hashes, hashed once more. The
    canonical form is this library's own.
    """
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = chunks.select(*keys, F.xxhash64("node_id", h).alias("a"), F.xxhash64(h, F.lit("second"), "node_id").alias("b"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string")
    identity = F.concat_ws(":", F.count(F.lit(1)).cast("string"), total("a"), total("b"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.left(F.sha2(identity, 256), F.lit(32))).alias("revision"))


def approval_status(claims: DataFrame, approvals: DataFrame, revisions: DataFrame, chunks: DataFrame, key: str = "chapter_number") -> DataFrame:
    """Whether an approval licenses each claim, with the first reason against it.

    claims: (key, claim_path, text); approvals: (key, claim_path, verdict, claim_hash, source_content_revision,
    source_chunk_ids); revisions: (key, revision); chunks: (key, node_id).
    """
    cited = approvals.select(key, "claim_path", F.explode("source_chunk_ids").alias("node_id"))
    gone = cited.join(chunks.select(key, "node_id").distinct(), [key, "node_id"], "left_anti").groupBy(key, "claim_path").agg(
        F.count(F.lit(1)).alias("__gone")
    )
    joined = (
        claims.join(approvals.withColumn("__a", F.lit(True)), [key, "claim_path"], "left")
        .join(revisions, key, "left")
        .join(gone, [key, "claim_path"], "left")
    )
    reason = T.first_reason(
        [
            (F.col("__a").isNull(), "not_reviewed"),
            (F.col("verdict") == "unfaithful", "rejected"),
            (~F.col("claim_hash").eqNullSafe(claim_hash(F.col("text"))), "reworded"),
            (~F.col("source_content_revision").eqNullSafe(F.col("revision")), "source_changed"),
            (F.coalesce("__gone", F.lit(0)) > 0, "chunks_missing"),
        ]
    )
    return joined.select(key, "claim_path", reason.isNull().alias("approved"), reason.alias("reason"))


def translate_provenance(claims: DataFrame) -> DataFrame:
    """Provenance record per claim, or the reason it cannot be published.

    claims: (path, origin, source_chunk_ids, grounded_in_source_chunk_ids, chunk_ids, transformation,
    generation_reason, generator_version, author_reference, source_resource_id).
    """
    filled = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c))
    ids = F.filter(
        F.coalesce(filled("source_chunk_ids"), filled("grounded_in_source_chunk_ids"), filled("chunk_ids"), F.array().cast("array<string>")),
        lambda v: ~T.blank(v),
    )
    text = lambda c: F.when(~T.blank(c), T.strip(c))
    origin = F.trim(F.coalesce("origin", F.lit("")))
    sourced = origin.isin("source_grounded", "source_transformed")
    generated = origin == "pedagogical_generation"
    missing = F.filter(
        F.array(
            F.when((origin == "source_grounded") & text("source_resource_id").isNull(), F.lit("source_resource_id")),
            F.when((origin == "source_transformed") & text("transformation").isNull(), F.lit("transformation")),
            F.when(generated & text("generation_reason").isNull(), F.lit("generation_reason")),
            F.when(generated & text("generator_version").isNull(), F.lit("generator_version")),
        ),
        lambda v: v.isNotNull(),
    )
    error = T.first_reason(
        [
            (origin == "insufficient_source_evidence", "insufficient_source_evidence"),
            (~(sourced | generated | (origin == "manually_authored")), "unknown_origin"),
            ((origin == "manually_authored") & text("author_reference").isNull(), "no_author"),
            (F.size(missing) > 0, "missing_fields"),
            (sourced & (F.size(ids) == 0), "no_source_chunks"),
        ]
    )
    good = error.isNull()
    return claims.select(
        "path",
        F.when(good, origin).alias("origin"),
        F.when(good & sourced, ids).alias("source_chunk_ids"),
        F.when(good & generated, ids).alias("grounded_in_source_chunk_ids"),
        F.when(good & sourced, text("source_resource_id")).alias("source_resource_id"),
        F.when(good & (origin == "source_transformed"), text("transformation")).alias("transformation"),
        F.when(good & generated, text("generation_reason")).alias("generation_reason"),
        F.when(good & generated, text("generator_version")).alias("generator_version"),
        F.when(good & (origin == "manually_authored"), text("author_reference")).alias("author_reference"),
        error.alias("error"),
        F.when(error == "missing_fields", missing).alias("missing"),
    )


def apply_corrections(leaves: DataFrame, audit: DataFrame, corrections: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(leaves after correction, damaged list).

    leaves: (doc, json_path, value); audit: (doc, json_path, support_status); corrections: (doc, json_path, new_value).
    """
    fixable = audit.filter(F.col("support_status").isin(REPAIRABLE) & F.col("json_path").isNotNull()).select(doc, "json_path").distinct()
    usable = corrections.join(fixable, [doc, "json_path"], "left_semi")
    fixed = leaves.join(usable, [doc, "json_path"], "left").select(
        doc, "json_path", F.coalesce("new_value", "value").alias("value"), F.col("new_value").isNotNull().alias("corrected")
    )
    return fixed, audit.filter(F.col("support_status") == "SOURCE_DAMAGED")


def normalise_claims(claims: DataFrame, chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Claims with only allowed ids and verified spans; the rest downgraded with a reason.

    claims: (claim_id, doc, text, claim_kind, origin, source_chunk_ids, grounded_in_source_chunk_ids,
    evidence_spans array<struct<node_id, quote>>, reason); allowed: (doc, node_id).
    Stricter than the contract: every grounded claim needs a verified span.
    """
    def kept_ids(column: str) -> DataFrame:
        rows = claims.select("claim_id", "doc", F.posexplode(column).alias("i", "raw")).withColumn("node_id", T.strip("raw"))
        ok = rows.join(allowed.select("doc", "node_id").distinct(), ["doc", "node_id"])
        firsts = ok.groupBy("claim_id", "node_id").agg(F.min("i").alias("i"))
        return firsts.groupBy("claim_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "node_id"))), lambda s: s["node_id"]).alias(f"__{column}")
        )

    base = claims.join(kept_ids("source_chunk_ids"), "claim_id", "left").join(kept_ids("grounded_in_source_chunk_ids"), "claim_id", "left")
    none = F.array().cast("array<string>")
    ids, grounded = F.coalesce("__source_chunk_ids", none), F.coalesce("__grounded_in_source_chunk_ids", none)
    spans = base.select("claim_id", ids.alias("source_ids"), F.posexplode("evidence_spans").alias("i", "s")).select(
        "claim_id", "source_ids", "i", F.col("s.node_id").alias("node_id"), F.col("s.quote").alias("quote")
    )
    good = verify_spans(spans, chunks).filter("verified and first_use").groupBy("claim_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "node_id", "quote"))), lambda s: F.struct(s["node_id"].alias("node_id"), s["quote"].alias("quote"))).alias("__spans")
    )
    joined = base.join(good, "claim_id", "left")
    forced = (F.col("claim_kind") == "misconception_statement") & (F.col("origin") == "source_grounded")
    origin = F.when(forced, "pedagogical_generation").otherwise(F.col("origin"))
    g, p, n = (origin == o for o in ("source_grounded", "pedagogical_generation", "insufficient_source_evidence"))
    why = (
        F.when(g & (F.size(ids) == 0), NO_CITATION)
        .when(g & F.col("__spans").isNull(), F.when(F.col("claim_kind").isin(HIGH_RISK_KINDS), NO_SPAN_HIGH_RISK).otherwise(NO_SPAN))
        .when(p & ~F.coalesce(F.col("claim_kind").isin(GENERATED_KINDS), F.lit(False)), WRONG_KIND)
        .when(n, F.when(T.blank("reason"), NOT_ENOUGH).otherwise(F.col("reason")))
    )
    down = why.isNotNull()
    no_spans = F.array().cast("array<struct<node_id:string,quote:string>>")
    return joined.select(
        "claim_id",
        "doc",
        F.when(~down, F.col("text")).alias("text"),
        "claim_kind",
        F.when(down, "insufficient_source_evidence").otherwise(origin).alias("origin"),
        F.when(g & ~down, ids).otherwise(none).alias("source_chunk_ids"),
        F.when(p & ~down, grounded).otherwise(none).alias("grounded_in_source_chunk_ids"),
        F.when(g & ~down, F.col("__spans")).otherwise(no_spans).alias("evidence_spans"),
        why.alias("reason"),
    )
