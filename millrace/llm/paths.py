"""Places of files outside the repository."""

from __future__ import annotations


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's vocabulary file by name."""
    import public_tokenizers

    return public_tokenizers.path(name)
