"""Vocabularies of byte-level BPE files."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import lru_cache

import regex


@dataclass(frozen=True)
class Vocabulary:
    """``tokens``: bytes of each id; ``merges``: (left id, right id, merged id) by rank, for files that list them; ``added``: strings that stand for one id."""

    tokens: tuple[bytes, ...]
    pattern: str
    merges: tuple[tuple[int, int, int], ...] = ()
    added: tuple[tuple[str, int], ...] = ()


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level files write for each byte: itself where it prints, else the next unused code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def read_ranks(path: str, pattern: str) -> Vocabulary:
    """A rank file: lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(tuple(tokens), pattern)


@lru_cache(maxsize=4)
def read_json(path: str, pattern: str) -> Vocabulary:
    """A tokenizers file with byte-level pre-tokens and no normaliser; anything else is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = spec["normalizer"] is None and first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first["use_regex"]
    if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("not a plain byte-level BPE file")
    letters, added = byte_letters(), tuple((t["content"], t["id"]) for t in spec["added_tokens"])
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    specials = {i for _, i in added}
    for token, i in model["vocab"].items():
        if i not in specials:
            tokens[i] = bytes(letters[c] for c in token)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = tuple((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs)
    return Vocabulary(tuple(tokens), pattern, merges, added)


def splitter(pattern: str):
    """``findall`` of a pre-token pattern, whose matches cover the text."""
    return regex.compile(pattern).findall
