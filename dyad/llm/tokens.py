"""Token ids of a public byte-level BPE vocabulary, given as a rank file and its list of added tokens."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable


@functools.cache
def encoder(ranks_path: str) -> Callable[[str], list[int]]:
    """Text to ids, as `tokenizers` gives them for this vocabulary; the strings of added tokens are one id each.

    One per Python worker and file. The added tokens stand in the JSON file of the same name, if there is one.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(ranks_path))
    return functools.partial(encoding.encode, allowed_special="all")


def added_tokens(ranks_path: str) -> dict[str, int]:
    try:
        with open(ranks_path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    except FileNotFoundError:
        return {}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
