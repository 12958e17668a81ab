"""Token counts with public tokenizers, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

FOLDER = "/opt/tokenizers"
#: How byte-level vocabularies cut a text before merging (the published pattern of that family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or os.environ.get("TOKENIZER_FOLDER", FOLDER), name)


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """The number of tokens of a text; its attribute ``longest``, where it has one, is how many
    characters a token holds at most."""
    if path.endswith(".tiktoken"):
        known = encoding(path)
        encode = known.encode_ordinary
        count = lambda text: len(encode(text))
        count.longest = max(map(len, known.token_byte_values()))  # bytes, of which a character has one at least
        return count
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
