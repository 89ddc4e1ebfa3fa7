"""Token ids of the public byte-level vocabulary."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: Two white-space characters in a row: only there does the pattern's look-ahead matter.
BLANKS = re.compile(r"\s\s")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + k)] = b
    return out


@lru_cache(2)
def _encodings(path: str):
    import public_tokenizers
    import tiktoken

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        # ids of single bytes and merges rank as they merge; other entries are special tokens
        ranks = {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if all(c in byte for c in token)}
        merged = {"".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]}
        ranks = {k: n for k, n in ranks.items() if len(k) == 1} | {
            bytes(byte[c] for c in token): model["vocab"][token] for token in merged
        }
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return make("full", public_tokenizers.PATTERN), make("plain", plain)


@lru_cache(2)
def _added(path: str) -> re.Pattern | None:
    """A pattern of the vocabulary's added tokens; None where the file names none."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        strings = [t["content"] for t in json.load(f).get("added_tokens") or []]
    return re.compile("|".join(map(re.escape, strings))) if strings else None


@lru_cache(2)
def _tokenizer(path: str):
    """Loaded only where a text needs it: it takes as much memory as all else here."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """encode(text) gives the ids that the vocabulary's own tokenizer gives, as little-endian uint32.

    Texts with the string of an added token go to ``tokenizers`` itself, which gives that token's id for it.  All others
    have the same ids from ``tiktoken``, which is faster; those without two white-space characters in a row take a pattern
    without look-ahead, which cuts them alike and is faster still.
    """

    def __init__(self, path: str):
        self.full, self.plain = _encodings(path)
        self.path, self.added = path, _added(path)

    def encode(self, text: str) -> np.ndarray:
        if self.added and self.added.search(text):
            return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, dtype="<u4")
        encoding = self.full if BLANKS.search(text) else self.plain
        return np.array(encoding.encode_ordinary(text), dtype="<u4")
