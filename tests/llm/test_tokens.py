"""Encoding, counts and packing against the public libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe_codec, packing, token_counts
from quire.llm.queries import QUERIES
from quire.llm.vocabulary import read_json, read_ranks

RANKS = read_ranks(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
JSON = read_json(public.path("byte_bpe_50k.json"), public.PATTERN)


def strange_texts(n: int = 300) -> list[str]:
    rng = random.Random(3)
    pool = [chr(i) for i in range(0x250)] + ["\x85", "\u2028", "\u3000", "\u200b", "\u0661", "中", "文", "😀", "\u0301", " ", "  ", "the", "ing", "'ll", "\n", "<|endoftext|>", "aaaa", "ß"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 3000, "ab" * 2000, "é" * 2500]


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(RANKS)


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.whole.index(k) for k in codec.keys) == list(range(len(codec.keys)))
    assert all(codec.keys[codec.whole.index(k)] == k for k in codec.keys)
    assert bpe_codec.PerfectHash([b"only"]).index(b"other") == 0


def test_codec_equals_tiktoken(codec):
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={t: i for i, t in enumerate(RANKS.tokens) if t}, special_tokens={})
    for text in strange_texts():
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_counts_and_packing_ids_equal_tokenizers():
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = strange_texts()
    ids = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_counts.Counter(JSON).counts(texts) == [len(x) for x in ids]
    encoder = packing.Encoder(JSON)
    assert [encoder.encode(t).tolist() for t in texts] == ids


def test_packing_encodes_texts_of_any_length():
    """Runs of white space on which the library's pattern runs out of stack, at the start, inside, before a special string and at the end."""
    library, encoder = Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.Encoder(JSON)
    run = 5000
    short = [" " * run, "a" + "\n" * run + "b", " \t" * run + "word" + "\u2003" * run, "x" + " " * run + "<|endoftext|>" + " " * run + "'s", "\n " * run + "\n!", "a" * 50_000]
    for text in short:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in ("one" + " " * 2_000_000 + "two", "\n" * 2_000_000, "z" * 2_000_000 + " \n" * 1_000_000):
        ids = encoder.encode(text)
        assert b"".join(JSON.tokens[i] for i in ids.tolist()) == text.encode()
        assert len(ids) == token_counts.Counter(JSON).counts([text])[0]


def test_codec_and_counts_of_messy_rows(spark, messy):
    coded = bpe_codec.encode_documents(messy.select("doc_id", "text", "n_tokens", "kept"), RANKS, ["doc_id"]).collect()
    assert len(coded) == 12 and [r.decoded for r in coded if r.doc_id == 0] == [b""] and [r.ids for r in coded if r.doc_id == 1] == [[]]
    texts = {(r.doc_id, (r.text or "").encode()) for r in messy.collect()}
    assert {(r.doc_id, bytes(r.decoded)) for r in coded} == texts
    counted = token_counts.count_tokens(messy, JSON, ["doc_id"]).collect()
    assert len(counted) == 12 and {r.n_bytes for r in counted if r.doc_id in (0, 1)} == {0}
    assert bpe_codec.encode_documents(messy.limit(0), RANKS, ["doc_id"]).count() == 0
    assert token_counts.count_tokens(messy.limit(0), JSON, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe_codec.encode_documents(messy, RANKS, ["ids"])


def test_assign_loses_no_token_and_fills_sequences():
    rng = random.Random(1)
    for n in (0, 1, 5, 200):
        lengths = [rng.choice([1, 3, 700, rng.randint(1, 1023), 0]) for _ in range(n)]
        pieces = packing.assign(lengths)
        held = defaultdict(int)
        for item, start, length, at, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == held[at] and length > 0
            held[at] += length
        assert all(v <= packing.CAPACITY for v in held.values()) and len(held) <= -(-sum(lengths) // packing.CAPACITY)
        for i, want in enumerate(lengths):
            own = sorted((s, size) for item, s, size, _, _ in pieces if item == i)
            assert [s for s, _ in own] == list(np.cumsum([0, *[size for _, size in own]])[:-1]) and sum(size for _, size in own) == want


def test_packed_messy_rows(spark, messy):
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(messy, JSON, "doc_id", with_ids=True).collect()
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in messy.collect()}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert bytes(r.ids) == piece.tobytes() and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    copies = {r.doc_id: sum(x.doc_id == r.doc_id for x in messy.collect()) for r in rows}
    for k, want in ids.items():
        assert sum(r.length for r in rows if r.doc_id == k) == len(want) * copies[k]
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 1024
    assert packing.pack_documents(messy.limit(0), JSON, "doc_id").count() == 0


def check_packed(rows, texts: dict) -> None:
    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, text in texts.items():
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces.pop(k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 1024


def test_packing_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op7_packing"](spark, folder).collect()
    check_packed(rows, {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()})
    used = len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) > 0.97 * 1024 * used


def test_a_document_repeated_often_is_spread(spark):
    """Copies of one row go to many groups, each of bounded size."""
    df = spark.range(6000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words again and again " * 90).alias("text"))
    rows = packing.pack_documents(df.repartition(4), JSON, "doc_id")
    groups = [r["count"] for r in rows.groupBy(F.expr("sequence_id >> 32").alias("g")).count().collect()]
    assert len(groups) > 5 and max(groups) < 2 * packing.GROUP_RESTS
    total = rows.agg(F.sum("length"), F.max("doc_tokens"), F.countDistinct("sequence_id")).first()
    assert total[0] == 6000 * total[1] and total[0] > 0.99 * 1024 * total[2]
