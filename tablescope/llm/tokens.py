"""Token ids of a public byte-level BPE vocabulary, by the merge ranks of its tokenizer file."""

from __future__ import annotations

import json

import numpy as np

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of texts in the vocabulary and merge order of the tokenizer file at ``path``; its added tokens in a text are one id, as `tokenizers` gives them by default."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or default_path(), encoding="utf-8") as file:
            stored = json.load(file)
        letters = _byte_letters()
        special = {added["content"]: added["id"] for added in stored.get("added_tokens", [])}
        ranks = {bytes(map(letters.__getitem__, token)): rank for token, rank in stored["model"]["vocab"].items() if token not in special}
        self.inner = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; none for null."""
        return self.inner.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
