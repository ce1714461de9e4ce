"""Byte-level BPE ids on Arrow batches.

The ids are those of the ``tokenizers`` file ``byte_bpe_50k.json`` (byte-level
BPE, no special tokens added). They are computed with the same vocabulary in
rank form, which is several times faster; tests hold the two against each other.
"""

from __future__ import annotations

import base64
import re

from vigil.llm.common import cached

VOCABULARY = "byte_bpe_50k.tiktoken"
# Without two white-space characters in a row, the look-ahead of the vocabulary's split
# pattern never decides, and this pattern splits alike.
_SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_PAIR = re.compile(r"\s\s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Text to uint32 ids."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full, self.fast = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                                for name, p in (("full", public_tokenizers.PATTERN), ("single", _SINGLE)))

    def ids(self, text: str) -> list[int]:
        return (self.full if _PAIR.search(text) else self.fast).encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """The worker's encoder."""
    return cached(("encoder", path), lambda: Encoder(path))
