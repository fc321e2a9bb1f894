"""Token ids of whole texts as the ``tokenizers`` library gives them, at the speed of its ``tiktoken`` twin.

The same vocabulary exists as a ``tokenizers`` file and as ranks for ``tiktoken``, which is several times faster. The two
can only differ where their Unicode tables differ, so each character is compared once, when first seen: a text holding one
that the two classify differently is encoded by ``tokenizers``, and so is one that ``tiktoken`` refuses.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer


class TokenIds:
    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("twin", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.same = set(map(chr, range(128)))
        self.other: set[str] = set()

    def _agree(self, ch: str) -> bool:
        return all(self.fast.encode(s, allowed_special="all") == self.slow.encode(s, add_special_tokens=False).ids for s in ("a" + ch + "1", "!" + ch + "! " + ch + " a", "1" + ch + ch + "a"))

    def __call__(self, text: str) -> np.ndarray:
        if not text.isascii():
            for ch in set(text) - self.same:
                if ch not in self.other:
                    (self.same if self._agree(ch) else self.other).add(ch)
            if self.other and not self.other.isdisjoint(text):
                return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its pattern runs out of stack on a million white-space characters in a row
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def bpe_50k() -> TokenIds:
    """Ids by byte_bpe_50k.json."""
    return TokenIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
