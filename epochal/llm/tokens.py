"""Public byte-level vocabularies, opened once in each Python worker."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    """The strings that a ``tokenizers`` file takes out of a text before all else, and their ids."""
    with open(path) as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=4)
def encoder(path: str, special: tuple[tuple[str, int], ...] = ()):
    """A tiktoken encoder for a rank file.

    byte_bpe_50k.tiktoken holds byte_bpe_50k.json's vocabulary: with that file's ``special_tokens`` the ids
    (``allowed_special="all"``) are those of ``tokenizers``, several times faster.
    """
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


@lru_cache(maxsize=4)
def fragments(path: str) -> np.ndarray:
    """Per id: is the token a piece of a character only (what a byte fallback leaves)?"""
    own = encoder(path)
    out = np.zeros(own.max_token_value + 1, dtype=bool)
    for i in range(len(out)):
        try:
            own.decode_single_token_bytes(i).decode("utf-8")
        except KeyError:
            continue
        except UnicodeDecodeError:
            out[i] = True
    return out
