"""Token counts by rank-synchronous merging.

Distinct pre-tokens of a batch are one ragged array of symbol ids. Each round looks up the
merge rank of every adjacent pair, takes each pre-token's lowest rank and merges all its
pairs of that rank at once; pre-tokens without a mergeable pair leave. The symbols that
survive are the tokens. A merge's product ranks after it, so this order of merging is that
of one pair at a time.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textarrays as ta
from .common import table, text_of

TOKEN_LIMIT = 2048
#: Pre-tokens that a task remembers; beyond, it starts anew.
REMEMBERED = 1_000_000
_NO_RANK = np.iinfo(np.int64).max
#: Texts with characters from here on are split by the library's own pattern code, whose Unicode tables are of another version.
_RARE = regex.compile("[\u0530-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Token counts for a tokenizer file of this kind: normalised and lower-cased text, pre-tokens by a pattern, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = len(vocab)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made[order]
        steps = spec["normalizer"]["normalizers"]
        self.form = next((x["type"] for x in steps if x["type"].startswith("NF")), None)
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_file(path)
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.known: dict[bytes | str, int] = {}

    def split_by_library(self, text: str) -> list[bytes]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, x)) for x, _ in found]

    def pre_tokens(self, text: str) -> tuple[int, list[bytes | str]]:
        """Number of special strings in the text, and the pre-tokens of what lies between them."""
        parts = self.special.split(text) if self.special else [text]
        out: list[bytes | str] = []
        for part in parts:
            if _RARE.search(part):
                out += self.split_by_library(part)
                continue
            if self.form and not part.isascii():
                part = normalize(self.form, part)
            if self.lower:
                part = part.replace("Σ", "σ").lower()  # letter by letter: no final sigma
            out += self.pattern.findall(part)
        return len(parts) - 1, out

    def merged(self, pre_tokens: list[bytes | str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        coded = [x if isinstance(x, bytes) else x.encode() for x in pre_tokens]
        count = np.array([len(x) for x in coded], np.int64)
        if not len(count):
            return count
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(count)
        symbol[ends - 1] = self.last[data[ends - 1]]
        row = np.repeat(np.arange(len(count)), count)
        while len(symbol):
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            rank = np.full(len(row), _NO_RANK)
            left = np.flatnonzero(~first[1:])
            key = symbol[left] * self.size + symbol[left + 1]
            slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[slot] == key
            rank[left[hit]] = self.rank[slot[hit]]
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(row)))
            done = lowest == _NO_RANK
            count[row[starts[done]]] = length[done]
            merge = (rank == np.repeat(lowest, length)) & (rank != _NO_RANK)
            begins = merge.copy()
            begins[1:] &= ~merge[:-1]
            at = np.arange(len(row))
            run = np.maximum.accumulate(np.where(begins, at, 0))
            merge &= (at - run) % 2 == 0  # of overlapping equal pairs, the first, third and so on
            made = np.zeros(len(row), np.int64)
            made[left[hit]] = self.made[slot[hit]]
            symbol = np.where(merge, made, symbol)
            keep = ~np.repeat(done, length)
            keep[1:] &= ~merge[:-1]
            symbol, row = symbol[keep], row[keep]
        return count

    def count(self, texts: list[str]) -> list[int]:
        found = [self.pre_tokens(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = list({x for _, tokens in found for x in tokens} - self.known.keys())
        self.known.update(zip(fresh, self.merged(fresh).tolist(), strict=True))
        size = self.known.__getitem__
        return [n + sum(map(size, tokens)) for n, tokens in found]


@lru_cache(maxsize=2)
def counter(name: str) -> MergeCounter:
    import public_tokenizers

    return MergeCounter(public_tokenizers.path(name))


def _counts(name: str):
    def run(batches):
        for batch in batches:
            for part in ta.slices(batch):
                n = counter(name).count([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of whole texts, by a file of the installed public vocabularies.

    Null and empty texts have 0 of both; repeated rows each get a row; an empty table gives
    none; columns other than doc_id and text are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return source.mapInArrow(_counts(tokenizer), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_rank_synchronous_bpe(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
