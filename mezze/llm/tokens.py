"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens with their numbers of tokens, broadcast to all executors. A byte-level
BPE's vocabulary is itself a list of frequent strings, as each merge was the most frequent of its time: the table holds
those entries that are whole pre-tokens, so it is never larger than the vocabulary and takes no pass over the texts. Tier
two is a bounded cache of each Python worker, filled by encoding what the table lacks. Pre-tokens are never shuffled. The
table saves time only; the counts do not depend on it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mezze.llm.bpe import Specials, Words, byte_letters, chunks
from mezze.llm.common import map_pandas

#: Entries of a worker's cache.
CACHE = 300_000
#: Fixed value: the pattern that byte-level pre-tokenizers use without being told one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_workers: dict[str, "Counts"] = {}


class Counts:
    """Numbers of tokens of pre-tokens: a worker's table and cache in one dictionary."""

    def __init__(self, path: str, table: tuple[bytes, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("only a byte-level BPE with the usual pre-tokens, no normalizer and no prefix space is known")
        self.words, self.specials, self.vocab = Words(PATTERN), Specials(spec["added_tokens"], False), spec["model"]["vocab"]
        self.table = dict(zip(table[0].decode("utf-8").split("\0"), table[1].tolist())) if table and len(table[1]) else {}
        self.known = dict(self.table)
        self.source = table

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text around special tokens, and how many of the latter it has."""
        parts = self.specials.split(text)
        if len(parts) == 1:
            return self.words.findall(text), 0
        return [t for part in parts[::2] for t in self.words.findall(part)], len(parts) // 2

    def learn(self, pre_tokens: set[str]) -> dict[str, int]:
        if len(self.known) > CACHE:
            self.known = dict(self.table)
        missing = list(pre_tokens - self.known.keys())
        for at in range(0, len(missing), 10_000):
            part = missing[at : at + 10_000]
            self.known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        return self.known


def frequent(path: str) -> tuple[bytes, np.ndarray]:
    """The vocabulary's entries that are whole pre-tokens, joined by a zero character, and their numbers of tokens."""
    counts = Counts(path)
    back = {ord(c): b for b, c in byte_letters().items()}
    found = []
    for entry in sorted(counts.vocab, key=counts.vocab.get):
        try:
            text = bytes(back[ord(c)] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character, or a special token
        if "\0" not in text and counts.split(text) == ([text], 0):
            found.append(text)
    known = counts.learn(set(found))
    return "\0".join(found).encode("utf-8"), np.array([known[t] for t in found], np.int32)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); one row per input row, 0 for a null or empty text.

    `path` is the vocabulary file of a byte-level BPE, present on the driver and every executor. Strings of special tokens
    in a text count as one token each, as the library has it. A null doc_id stays null; further columns are left out.
    """
    table: Broadcast = docs.sparkSession.sparkContext.broadcast(frequent(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _workers.get(path)
        if counts is None or counts.source is not table.value:
            counts = _workers[path] = Counts(path, table.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for texts in chunks(batch["text"]):
                split = [counts.split(t) for t in texts]
                known = counts.learn(set().union(*(s for s, _ in split)))
                n_tokens += [sum(map(known.__getitem__, s)) + n for s, n in split]
                n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": [n > limit for n in n_tokens]})

    return map_pandas(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
