"""Token ids of whole texts by a public vocabulary file, a parameter everywhere.

`.json` files are read by `tokenizers`. `.tiktoken` files hold ranks of the same kind of
vocabulary and are several times faster; both give the same ids for the same vocabulary
(tests compare them). Where a text holds the string of an added token, such as the end of a
text, the ids are those of the plain call of the `.json` file's library, in which it is one.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers

END_ID = 0
#: Runs of white space from this length are beyond what the reader of ranks can match; such
#: texts go to the same vocabulary's `.json` file.
LONG_SPACE = 20_000


@cache
def encoder(name: str) -> Callable[[str], list[int]]:
    """The function from a text to its ids; built once per process. `name` is a path, or
    a name that `public_tokenizers` knows."""
    path = name if "/" in name else public_tokenizers.path(name)
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        return lambda text: made.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaces = re.compile(rf"\s{{{LONG_SPACE}}}")
    plain = name.removesuffix(".tiktoken") + ".json"
    added = added_tokens(plain)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or (len(text) >= LONG_SPACE and spaces.search(text)):
            return encoder(plain)(text)
        return made.encode_ordinary(text)

    return encode


def added_tokens(name: str) -> list[str]:
    """Strings that a `.json` vocabulary reads as one token wherever they stand; none if a
    vocabulary comes without that file."""
    path = name if "/" in name else public_tokenizers.path(name)
    if not os.path.exists(path):
        return []
    with open(path) as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def ids_of(text: str | None, name: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of a text (null: none) and then `end_id`."""
    return np.array([*encoder(name)(text or ""), end_id], np.uint32)
