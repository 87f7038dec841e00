"""Leaves of nested JSON and byte-range scans, against plain Python."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import json_tree
from quire.operators import claims as L
from quire.operators import quality as Q
from quire.operators import retrieval as R8
from quire.sources import chunks as Ch
from quire.sources import ranges as R
from quire.sources.scratch import write_json_arrays


def walk(value, path="$", keys=()):
    if isinstance(value, dict):
        for k, v in value.items():
            name = k if k.isidentifier() else '"' + k.replace('"', '\\"') + '"'
            yield from walk(v, f"{path}.{name}", (*keys, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", keys)
    else:
        yield path, list(keys), value


def nested(rng: random.Random, depth: int):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice(["text", "", 'q"uote', "back\\slash", "[not] {a} list", 7, -3, True, None, "é中"])
    if kind < 0.65:
        return {rng.choice(["a", "input", "a b", "mistake", "f.g", "k"]): nested(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [nested(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def shown(value):
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def test_leaves_of_any_shape_and_depth(spark):
    rng = random.Random(4)
    documents = {i: nested(rng, rng.randint(0, 6)) for i in range(120)}
    deep = "x"
    for i in range(40):
        deep = [deep] if i % 2 else {"k": deep, "": i}
    documents[500] = deep
    df = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in documents.items()] + [(900, None), (901, "{broken"), (902, "")], "id long, json string").withColumn("n", F.lit(1))
    got = sorted((r.id, r.json_path, list(r["keys"]), r.value, r.kind == "STRING") for r in json_tree.leaves(df, ["id"]).collect())
    want = sorted((i, path, keys, shown(v), isinstance(v, str)) for i, d in documents.items() for path, keys, v in walk(d))
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(r.id for r in json_tree.unreadable(df, ["id"]).collect()) == [900, 901, 902]
    assert json_tree.leaves(df.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        json_tree.leaves(df.withColumnRenamed("id", "key"), ["key"])


def test_nesting_ignores_brackets_in_strings(spark):
    cases = [("[]", 1), ('"[[["', 0), ('{"a":"\\"[{","b":[[1]]}', 3), ("7", 0), ('[{"a":[]},[]]', 3), (None, None)]
    df = spark.createDataFrame(cases, "j string, n int")
    assert all(r.n == r.found for r in df.select("n", json_tree.nesting("j").alias("found")).collect())


def test_asserted_chains_skip_problems_and_mistakes(spark):
    document = {
        "worked_examples": [{"input": "$1+1=3$", "model_answer": "$$2+2=4$$ and $2+2=4$", "steps": [{"input": {"deep": "$5=6$"}, "note": "$9-1=7$"}]}],
        "common_mistakes": [{"mistake": "$3*3=6$", "fix": "$3*3=9$"}], "misconception": ["$0=1$"], "x": {"mistake": [["$4=5$"]]},
    }
    df = spark.createDataFrame([(1, json.dumps(document))], "id long, json string")
    chains = Q.check_chains(Q.document_chains(json_tree.leaves(df, ["id"]), ["id"]))
    assert sorted((r.chain, r.verdict) for r in chains.collect()) == [("2+2=4", "true"), ("3*3=9", "true"), ("9-1=7", "false")]


def test_every_string_is_stripped_of_artifacts(spark):
    mark = " :contentReference[oaicite:3]{index=3}"
    document = {"note": f" a{mark} b{mark}", "list": [f"{mark}", {"deep": f"x{mark}"}], "n": 4, "none": None}
    df = spark.createDataFrame([(1, json.dumps(document))], "id long, json string")
    got = {r.json_path: r.value for r in Q.strip_document_artifacts(json_tree.leaves(df, ["id"])).collect()}
    assert got == {"$.note": "a b", "$.list[0]": "", "$.list[1].deep": "x", "$.n": "4", "$.none": None}


def test_prose_leaves_out_what_is_not_read(spark):
    document = {"b": ["two", {"formula": "no", "c": "three"}], "a": "one", "example": ["no"], "tags": ["no"], "z": 5}
    df = spark.createDataFrame([(1, json.dumps(document)), (2, '{"formula":"only"}')], "id long, json string")
    assert [(r.id, r.text) for r in json_tree.prose(json_tree.leaves(df, ["id"]), ["id"]).collect()] == [(1, "one two three")]


# -- byte ranges -------------------------------------------------------------------------------------------------------


def plain_marks(text: str):
    depth, inside, escaped, out = 0, False, False, []
    for i, c in enumerate(text):
        if inside:
            inside, escaped = (True, False) if escaped else (c != '"', c == "\\")
        elif c == '"':
            inside = True
        elif c in "[]{},:":
            depth += (c in "[{") - (c in "]}")
            out.append((i, c, depth))
    return out, R.ESCAPED if inside and escaped else R.INSIDE if inside else R.OUTSIDE


def test_states_compose_at_every_cut():
    rng = random.Random(6)
    text = json.dumps([nested(rng, 4) for _ in range(12)] + ['\\\\"', "\\", '"[', "\\\\\\"])
    want, _ = plain_marks(text)
    for cut in range(len(text)):
        (found, state) = plain_marks(text[:cut])
        first = R.marks(text[:cut].encode(), R.OUTSIDE)
        assert first.state == state
        second = R.marks(text[cut:].encode(), state, found[-1][2] if found else 0)
        both = [(int(a), chr(w), int(d)) for m, base in ((first, 0), (second, cut)) for a, w, d in zip(m.at + base, m.what, m.depth, strict=True)]
        assert both == want and second.state == R.OUTSIDE


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_elements_of_any_range_size(spark, tmp_path, size):
    rng = random.Random(size)
    elements = [nested(rng, 3) for _ in range(30)] + [{"id": 'x"],[{', "text": "\\\\\\" * 9}, [], {}, "", ","]
    few = elements[:6] if size == 1 else elements
    files = {
        "array.json": few, "wrapped.json": {"meta": [1, [2, {"chunks": [9]}]], "chunks": [], "note": '"chunks": [', "items": few[:4], "nodes": few},
        "empty.json": [], "object.json": {"nodes": {"a": 1, "b": 2}, "other": [1, 2]}, "one.json": [{"a": [1, 2]}], "scalar.json": 5,
    }
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value, indent=2 if "w" in name else None, ensure_ascii=False))
    (tmp_path / "broken.json").write_text('[{"a": 1}, {"b": "open')
    (tmp_path / "blank.json").write_text("")
    got: dict = {}
    for r in R.scan_elements(spark, str(tmp_path), size).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.ord] = json.loads(r.raw)
    want = {"array.json": few, "wrapped.json": few, "one.json": [{"a": [1, 2]}]}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_one_file_gives_many_tasks_with_equal_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"node_id": f"n{i}", "text": "".join(rng.choice('ab"\\[]{},\n é') for _ in range(rng.randint(0, 300))), "page_start": i, "metadata": {"k": str(i)}} for i in range(400)]
    (tmp_path / "big.json").write_text(json.dumps({"chunks": rows}))
    got = Ch.scan_chunks(spark, str(tmp_path), range_bytes=4096)
    assert got.rdd.getNumPartitions() > 10
    whole = Ch.explode_chunks(Ch._files(spark, str(tmp_path)))
    same = [c for c in got.columns if c not in ("file", "metadata")]
    assert sorted(map(str, got.select(same).collect())) == sorted(map(str, whole.select(same).collect())) and got.count() == 400


def test_ranges_are_read_in_one_job_a_step(spark, tmp_path):
    """A scan of many ranges is a few jobs, whatever their number, and the task's reader does not carry all ranges."""
    (tmp_path / "big.json").write_text(json.dumps([{"node_id": f"n{i}", "text": "x" * 50} for i in range(2000)]))
    spark.sparkContext.setJobGroup("ranges", "")
    rows = R.scan_elements(spark, str(tmp_path), 1 << 10)
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranges")) < 10
    assert rows.count() == 2000 and rows.rdd.getNumPartitions() > 10
    reader = R.RangeReader({"step": "sums", "ranges": "[[\"f\", 0, 1, 1], [\"f\", 1, 2, 2]]"})
    assert len(reader.partitions()) == 2 and not reader.ranges


def test_ranges_grow_with_their_files():
    assert R._range_bytes(1 << 20, 4096, 16) == 1 << 16
    assert R._range_bytes(1000, 4096, 16) == 4096
    assert R._range_bytes(1 << 40, 4096, 16) == R.GROWN_BYTES
    assert R._range_bytes(1 << 40, 64 << 20, 16) == 64 << 20


def test_written_arrays_are_json(spark, tmp_path):
    df = spark.range(1000).select(F.to_json(F.struct("id", F.lit('a"\n,]').alias("t"))))
    write_json_arrays(df.repartition(7), f"{tmp_path}/out")
    write_json_arrays(df.limit(0), f"{tmp_path}/none")
    held = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(x["id"] for part in held for x in part) == list(range(1000))
    assert R.scan_elements(spark, f"{tmp_path}/none").count() == 0
    assert np.unique([r.ord for r in R.scan_elements(spark, f"{tmp_path}/out", 500).collect()]).tolist() == list(range(max(map(len, held))))


# -- canonical text, whole books, fallback retrieval -----------------------------------------------------------------------


def scrambled(value, rng: random.Random):
    """The same value with the keys of its objects in another order."""
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return {k: scrambled(v, rng) for k, v in items}
    return [scrambled(v, rng) for v in value] if isinstance(value, list) else value


def test_canonical_text_equals_sorted_compact_json(spark):
    rng = random.Random(9)
    values = [nested(rng, 5) for _ in range(60)] + [{"t": "\x0b\x1f\x00\n\t\"\\u000B \\", "b": {"z": 1, "a": [3, 2, {"y": 0, "x": 0}]}, "ä": "é中😀", "content_hash": "old"}, {"content_hash": 1}, {}]
    rows = [(i, json.dumps(scrambled(v, rng), indent=i % 3 or None, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(900, None), (901, "{no")]
    df = spark.createDataFrame(rows, "id long, json string")
    plain = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    got = {r.id: r.c for r in df.select("id", json_tree.canonical("json").alias("c")).collect()}
    assert got == {i: plain(v) for i, v in enumerate(values)} | {900: None, 901: None}
    objects = df.filter("id >= 60")
    less = {r.id: r.c for r in objects.select("id", json_tree.canonical("json", ["content_hash"]).alias("c")).collect()}
    assert less == {60: plain({k: v for k, v in values[60].items() if k != "content_hash"}), 61: "{}", 62: "{}", 900: None, 901: None}
    one = objects.filter("id = 60").select(json_tree.canonical_digest("json").alias("d")).first().d
    assert one == hashlib.sha256(plain(values[60]).encode()).hexdigest()


def test_chapters_stand_in_three_places(spark):
    chapter = lambda n: {"chapter_number": n, "learning_objectives": [f"o{n}"]}
    books = {
        "a": {"generation": {}, "learning_materials": {"summary": "S", "chapters": [chapter(1)], "chapter_packages": [chapter(2)]}, "chapter_packages": [chapter(3)]},
        "b": {"generation": {}, "learning_materials": {"chapters": "none", "chapter_packages": [chapter(2), chapter(4)]}, "chapter_packages": [chapter(3)]},
        "c": {"learning_materials": {}, "chapter_packages": [chapter(3), "odd"]}, "d": {"generation": {}}, "e": {"generation": 1, "learning_materials": {"chapters": []}, "chapter_packages": [chapter(5)]},
        "f": {"generation": {}, "chapter_packages": [chapter(6)]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in books.items()], "doc string, book string")
    got = sorted((r.doc, r.claim_id, r.json_path) for r in L.whole_book_claims(df).collect())
    path = lambda root, i: f"$.{root}[{i}].learning_objectives[0]"
    assert got == [
        ("a", "book.summary", "$.learning_materials.summary"), ("a", "chapter_01.learning_objectives.0", path("learning_materials.chapters", 0)),
        ("b", "chapter_02.learning_objectives.0", path("learning_materials.chapter_packages", 0)), ("b", "chapter_04.learning_objectives.0", path("learning_materials.chapter_packages", 1)),
        ("c", "chapter_03.learning_objectives.0", path("chapter_packages", 0)), ("f", "chapter_06.learning_objectives.0", path("chapter_packages", 0)),
    ]
    assert sorted((r.doc, r.code) for r in L.book_problems(df).collect()) == [("c", "CHAPTER_NOT_AN_OBJECT"), ("c", "NO_GENERATION"), ("d", "NO_MATERIALS"), ("e", "NO_GENERATION")]


def fallback(spark, nodes, sources, chunks):
    requests = spark.createDataFrame([("r", [1.0, 0.0], None, None)], "request_id string, query_vector array<double>, resolved_chapter int, filter_chapter int")
    n = spark.createDataFrame(nodes, "node_id string, embedding array<double>, source_pdf string, chapter_number int")
    s = spark.createDataFrame(sources, "request_id string, place string, node_id string, source_pdf string, chapter_number int")
    c = spark.createDataFrame(chunks, "node_id string, text string")
    return [(r.position, r.node_id, r.text, r.code) for r in sorted(R8.fallback_retrieval(requests, s, n, c).collect(), key=lambda r: r.position)]


def test_fallback_takes_new_chunks_in_order(spark):
    at = lambda a: [1.0 - a, a]
    nodes = [(f"n{i}", at(i / 50), "a.pdf", 6) for i in range(12)] + [("x", at(0.0), "a.pdf", 5)]
    chunks = [(f"n{i}", " " if i == 3 else f"t{i}") for i in range(12) if i != 5]
    own = [("r", "source", "n0", "a.pdf", 6), ("r", "clean", "n0", "a.pdf", 6), ("r", "source", "n2", "a.pdf", 6)]
    assert fallback(spark, nodes, own, chunks) == [(1, "n1", "t1", None), (2, "n3", " ", "blank_text"), (3, "n4", "t4", None), (4, "n5", None, "missing"), (5, "n6", "t6", None)]
    other = [(i, v, "b.pdf" if i == "n4" else p, c) for i, v, p, c in nodes]
    assert fallback(spark, other, own, chunks) == [(0, "n4", None, "wrong_document")]
    late = [(i, v, "b.pdf" if i == "n7" else p, c) for i, v, p, c in nodes]
    assert [r[0] for r in fallback(spark, late, own, chunks)] == [1, 2, 3, 4, 5]
    assert fallback(spark, nodes, [*own, ("r", "source", "n9", "b.pdf", 6)], chunks) == [(0, None, None, "no_single_document")]
    assert fallback(spark, nodes, [*own, ("r", "clean", "n9", "a.pdf", 7)], chunks) == [(0, None, None, "several_chapters")]
