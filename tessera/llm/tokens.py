"""Token ids of texts, by a byte-level BPE vocabulary of the public tokenizers."""

from __future__ import annotations

import base64
import json
from pathlib import Path

import numpy as np
import pyarrow as pa

#: GPT-2's published split pattern: a fixed value of the vocabulary
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file on this machine; executors ask for their own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the json file beside a rank file adds to its vocabulary; none without such a file."""
    known = Path(path).with_suffix(".json")
    added = json.loads(known.read_bytes()).get("added_tokens") or [] if known.exists() else []
    if odd := [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"]]:
        raise ValueError(f"added tokens that take in or need their surroundings: {odd}")
    return {t["content"]: t["id"] for t in added}


def encoder(path: str | None = None):
    """The encoder of a rank file; loaded once a worker.

    The rank file ``byte_bpe_50k.tiktoken`` holds the vocabulary of ``byte_bpe_50k.json``
    and gives the same ids (a test compares them) at several times the speed.  Its special
    tokens are those that the json file adds."""
    import tiktoken

    path = path or vocabulary_path()
    if path not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added_tokens(path))
    return _LOADED[path]


def encode(texts: pa.Array, end_id: int, path: str | None = None):
    """For each text its ids and the end id, as unsigned 32-bit numbers; null counts as empty.

    As in the tokenizers library, an added token that stands in a text is its own id."""
    known = encoder(path)
    added = known.special_tokens_set
    for text in texts:
        text = text.as_py()
        if text and any(token in text for token in added):
            ids = known.encode(text, allowed_special="all")
        else:
            ids = known.encode_ordinary(text) if text else []
        ids.append(end_id)
        yield np.array(ids, dtype="<u4")
