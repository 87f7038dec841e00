"""Quality rules, URL filter, languages and the quality classifier."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import language_id, quality_classifier, quality_rules, url_filter
from quire.llm.queries import LISTED_TERMS, QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_counts(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, held = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            held |= set(range(i, i + 5))
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(held)


@pytest.mark.parametrize("text", ["", " \n ", "a b c d e a b c d e f", "x\ny\nx\n\n \n \nx", "a " * 40, "é\u00a0ü <b> 日本\u2028x", "a b c d e f g a b c d e"])
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def test_rules_of_messy_rows(spark, messy):
    rows = quality_rules.apply_rules(messy.drop("kept"), np.zeros(quality_rules.BUCKETS), ["doc_id"]).collect()
    assert len(rows) == 12 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2))
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    trusted = quality_rules.trusted_ids(labels)
    ratio = quality_rules.fit_ratio(messy, trusted)
    assert [r.doc_id for r in trusted.collect()] == [5] and np.isfinite(ratio).all() and ratio.any()
    assert not quality_rules.fit_ratio(messy.limit(0), trusted.limit(0)).any()
    assert quality_rules.apply_rules(messy.limit(0), ratio, ["doc_id"]).count() == 0


def test_ratio_counts_every_document(spark):
    """The table equals one counted in plain Python over all documents."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    counts = np.zeros((2, quality_rules.BUCKETS))
    for r in documents.collect():
        held = np.bincount(quality_rules.gram_buckets(r.text.encode()), minlength=quality_rules.BUCKETS)
        counts[0] += held * (r.doc_id in good)
        counts[1] += held
    share = np.log((counts + 1) / (counts.sum(1, keepdims=True) + quality_rules.BUCKETS))
    for most in (quality_rules.BROADCAST_IDS, 0):  # ids broadcast, ids shuffled
        assert np.allclose(quality_rules.fit_ratio(documents, quality_rules.trusted_ids(labels), broadcast_ids=most), share[0] - share[1])


def test_junk_goes_and_clean_stays(spark):
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES["op2_quality_rules"](spark, FOLDER).join(marks, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert np.mean(clean) > 0.99 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.05


def plain_rule(host: str, path: str):
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net", "https://net/", "x://example.com/de/a", "http://www.spam.org/fr/1", "http://spam.org/b/?q=1",
            "https://www.spam.org/b#c", "http://spam.org/b//", "http://other.org/b", "a://b://c/d", "http://notexample.com/de/", "http://EXAMPLE.com/DE/", "http://spam.org/b"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([(u,) for u in ("http://spam.org/b", "http://spam.org/b", None, "junk", "https://www.spam.org/fr/1")], "url string")
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, listed, ["page_id"]).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rule, verdict = plain_rule(host, path)
        hit = re.sub(r"^www\.", "", host) + path.rstrip("/") in ("spam.org/b", "spam.org/fr/1")
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict or ("block" if hit else "allow"))
    assert url_filter.filter_urls(pages.limit(0), listed, ["page_id"]).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages.filter("page_id > 7"), listed.limit(0), ["page_id"]).collect()} == {"allow"}
    assert "casino" in LISTED_TERMS


def test_bloom_lets_every_listed_key_through(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("site"), "id").alias("k"))
    blocks = url_filter.bloom_blocks(keys.filter("hash(k) % 2 = 0"), "k")
    tried = url_filter.possible_hits(keys, "k", blocks).withColumn("listed", F.expr("hash(k) % 2 = 0"))
    counts = {(r["listed"], r["__possible"]): r["count"] for r in tried.groupBy("listed", "__possible").count().collect()}
    assert counts.get((True, False), 0) == 0 and counts.get((False, True), 0) < 1000


def test_profiles_by_plain_bundling():
    bundler = language_id.Bundler()
    text = "Ab, çd!"
    code = [0, *[max(ord(c) % 1024, 1) for c in "ab"], 0, *[max(ord(c) % 1024, 1) for c in "çd"], 0]
    want = sum(np.roll(bundler.letters[a], 2) * np.roll(bundler.letters[b], 1) * bundler.letters[c] for a, b, c in zip(code, code[1:], code[2:]))
    assert np.array_equal(bundler.profiles([text, "", "12 !"])[0], want) and not bundler.profiles(["12 !"]).any()


def test_long_text_is_bundled_in_parts(monkeypatch):
    bundler, text = language_id.Bundler(), "eine kleine Probe von Worten " * 30
    whole = bundler.profiles([text, "kurz"])
    monkeypatch.setattr(language_id, "PART", 101)
    assert np.array_equal(bundler.profiles([text, "kurz"]), whole)


def test_languages_held_out(spark):
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language_id"](spark, FOLDER).join(truth, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_messy_rows(spark, messy):
    model = language_id.fit_languages(messy, ["doc_id"], "lang")
    rows = language_id.identify(messy.drop("score"), model, ["doc_id"]).collect()
    assert model.names == ("en",) and len(rows) == 12
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 9)} == dict.fromkeys((0, 1, 2, 9), "und")
    nothing = language_id.fit_languages(messy.limit(0), ["doc_id"], "lang")
    assert {(r.lang_pred, r.score) for r in language_id.identify(messy, nothing, ["doc_id"]).collect()} == {("und", 0.0)}


def test_language_stage_drops_what_was_never_learned(spark):
    """Unlearned languages and letter noise go; short clean texts and nearly all labelled documents stay."""
    rng = np.random.default_rng(5)
    strange = [
        "Tämä on suomenkielinen lause, jossa kerrotaan lyhyesti säästä ja siitä, miten ihmiset viettävät kesäpäiviä järven rannalla.",
        "Bu cümle Türkçe yazılmıştır ve insanların yaz günlerini göl kıyısında arkadaşlarıyla nasıl geçirdiklerini kısaca anlatır.",
        "Ez a mondat magyarul íródott, és röviden elmeséli, hogyan töltik az emberek a nyári napokat a tó partján a barátaikkal.",
        "Это предложение написано по-русски и кратко рассказывает о том, как люди проводят летние дни на берегу озера.", "12 !",
    ]
    for first, last in ((97, 123), (0x3B1, 0x3CA), (0x430, 0x450)):
        for words in (5, 30, 300):
            strange += [" ".join("".join(map(chr, rng.integers(first, last, rng.integers(4, 10)))) for _ in range(words)) for _ in range(20)]
    clean = ["Von.", "That it.", "Pachque çaneux et.", "Des enberge die enver.", "Thnt th anrendat oneses thea ingshly with."]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    size, base = docs.count(), 1 << 40
    more = spark.createDataFrame([(base + i, t, None, "s", len(t)) for i, t in enumerate([*clean, *strange])], docs.schema)
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), FOLDER).select("doc_id").collect()]
    assert {k - base for k in kept if k >= base} == set(range(len(clean)))
    assert sum(k < base for k in kept) >= 0.995 * size


def test_cutoffs_of_small_classes():
    """One very repetitive long text does not set the cutoff of its class; a large class keeps all but CUTOFF_SHARE."""
    cut = language_id.cutoffs_of({4: {160: 1}, 9: {50: 1, 400: 999}, 16: {996: 1}}, 0.09)
    assert np.allclose([cut[k] for k in (0, 3, 4, 5, 9, 10, 16, 32)], [0.09, 0.09, 0.125, 0.125, 0.4, 0.4, 0.245, 0.245])


def test_quality_held_out(spark):
    marks = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES["op8_quality_classifier"](spark, FOLDER).join(marks, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93 and all(r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_dictionaries_hold_every_sampled_text(spark):
    """Also the texts of the largest ids, and where one class has fewer texts."""
    rows = [(i, f"<{i:05d}> " + ("good" if i % 4 else "bad") + " words of no weight " * 20) for i in range(1600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id long, quality int")
    model = quality_classifier.fit_quality(docs, labels, "doc_id", rows=600)
    held = {q: {int(x) for x in re.findall(rb"<(\d{5})>", c)} for q, c in ((1, model.good), (0, model.bad))}
    assert len(held[1]) == 600 and len(held[0]) == 200 and all((i % 4 > 0) == q for q in held for i in held[q])
    assert len(model.good) == len(model.bad) <= quality_classifier.DICTIONARY_BYTES
    assert quality_classifier.build_dictionary([b"aaaaaa", b"b", b"cccccc"], 9) == b"aaaabcccc" and quality_classifier.build_dictionary([]) == b""


def test_quality_of_messy_rows(spark, messy):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (6, 1)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = quality_classifier.fit_quality(messy, marks, "doc_id")
        rows = quality_classifier.score_quality(messy, model, ["doc_id"]).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality_classifier.score_quality(messy.limit(0), model, ["doc_id"]).count() == 0
