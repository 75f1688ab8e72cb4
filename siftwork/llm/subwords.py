"""Byte-level BPE over whole blocks: each distinct unit is encoded once.

The pieces of the tokenizer's pattern never run on from a printed character
into white space, so a text's encoding is the encodings of its units (white
space, then what stands up to the next white space) put together.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import SparkSession

from siftwork.llm.textbatch import SPACE, Block

#: The split pattern that belongs to the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct units that one Python worker remembers.
REMEMBER = 100_000
#: White space beyond the ASCII kind, which units don't look for (UTF-8).
WIDE_SPACE = "[" + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"


def vocabulary(spark: SparkSession, path: str = DEFAULT) -> bytes:
    """The rank file, read where the driver runs; under 1 MB for 50k entries."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


class Memo:
    """Results by the 64-bit hash of a unit's bytes, at most REMEMBER of them."""

    def __init__(self, work):
        self.work, self.known = work, {}

    def __call__(self, block: Block, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        """Codes of the units, and each code's result."""
        codes, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.known) > REMEMBER:
            self.known.clear()
        known, out = self.known, []
        raw = None
        for h, i in zip(distinct.tolist(), first.tolist()):
            got = known.get(h)
            if got is None:
                if raw is None:
                    raw = block.buf.tobytes()
                got = known[h] = self.work(raw[starts[i] : ends[i]])
            out.append(got)
        return codes, out


@lru_cache(2)
def leads(ranks: bytes) -> np.ndarray:
    """Of each subword: whether it begins with a blank."""
    out = np.zeros(encoding(ranks).n_vocab, bool)
    for a, b in map(bytes.split, ranks.splitlines()):
        out[int(b)] = base64.b64decode(a).startswith(b" ")
    return out


def word_ids(ranks: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of the words, each with a blank before it, end to end, and how many
    each has. A word holds no blank, so in their joint encoding a subword that begins
    with one begins a word. Words with wide white space, which could draw the next
    word's blank to itself, are encoded alone."""
    enc = encoding(ranks)
    odd = np.zeros(len(words), bool)
    text = b" ".join([b"", *words]).decode("utf-8", "replace")
    if not text.isascii() and re.search(WIDE_SPACE, text):
        odd[:] = [re.search(WIDE_SPACE, w.decode("utf-8", "replace")) is not None for w in words]
        text = b" ".join([b"", *(w for w, x in zip(words, odd) if not x)]).decode("utf-8", "replace")
    ids = np.array(enc.encode_to_numpy(text, disallowed_special=()), np.int32)
    size = np.zeros(len(words), np.int64)
    size[~odd] = np.diff(np.append(np.flatnonzero(leads(ranks)[ids]), len(ids)))
    if odd.any():
        alone = [enc.encode_ordinary(" " + words[i].decode("utf-8", "replace")) for i in np.flatnonzero(odd)]
        size[odd] = [len(x) for x in alone]
        own = np.repeat(odd, size)
        ids, joint = np.empty(len(own), np.int32), ids
        ids[~own] = joint
        ids[own] = [i for x in alone for i in x]
    return ids, size


@lru_cache(2)
def count_memo(ranks: bytes) -> Memo:
    enc = encoding(ranks)
    return Memo(lambda w: len(enc.encode_ordinary(w.decode("utf-8", "replace"))))


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a block's units, and the texts' offsets among them."""
    n = len(block.buf)
    space = SPACE[block.buf]
    cut = np.zeros(n + 1, bool)
    cut[block.off] = True
    first = np.empty(n, bool)
    if n:
        first[0] = True
        first[1:] = space[1:] & ~space[:-1]
    starts = np.flatnonzero(first | cut[:n])
    return starts, np.append(starts[1:], n), np.searchsorted(starts, block.off)
