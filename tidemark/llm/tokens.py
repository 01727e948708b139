"""Token ids by the public byte-level BPE vocabulary.

The contract is the ids that the ``tokenizers`` library gives. ``tiktoken`` holds the same vocabulary as ranks and
is several times faster, so texts in scripts whose character classes both libraries share go there; the others, and
texts that hold the special token's own string, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa

from tidemark.llm.textblock import TextBlock

BPE_JSON, BPE_RANKS, SPECIAL = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "<|endoftext|>"
_RARE = re.compile("[^\x00-Կ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")
_loaded: dict[tuple, tuple] = {}


def _libraries(json_path: str | None, ranks_path: str | None) -> tuple:
    """The two encoders, once in each Python worker. A path of None means the public file of that name."""
    key = (json_path, ranks_path)
    if key not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path or public_tokenizers.path(BPE_RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[key] = fast, Tokenizer.from_file(json_path or public_tokenizers.path(BPE_JSON))
    return _loaded[key]


class BpeEncoder:
    """Encodes Arrow string columns to one uint32 array for each text; null counts as empty."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        self.fast, self.plain = _libraries(json_path, ranks_path)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        wide = TextBlock(texts)
        wide = wide.counts(wide.buf >= 0xD5)  # bytes that begin U+0540 or beyond
        out = []
        for text, odd in zip(texts.to_pylist(), wide, strict=True):
            if not text:
                out.append(np.zeros(0, np.uint32))
            elif SPECIAL in text or odd and _RARE.search(text):
                out.append(np.asarray(self.plain.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.fast.encode_to_numpy(text, disallowed_special=()))
        return out
