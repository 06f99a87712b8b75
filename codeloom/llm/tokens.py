"""Token ids of whole texts by a public byte-level BPE file.

A file whose ids are in the order of its merges also defines a byte-pair encoder
that merges by rank. That gives the same ids about six times as fast, so it is used
where the file allows it; any other file goes through its own library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

# A space with something other than white space on both sides: a pre-token begins at it, whatever stands further away.
CUT = re.compile(r"(?<=\S) (?=\S)")

# Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_rank(path: str):
    """The encoder by ranks of a byte-level file, None where the file's ids are not in the order of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, before = whole["model"], whole.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or whole.get("normalizer"):
        return None
    letters, vocabulary = _byte_letters(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("by rank", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        self.path, self.by_rank = path, _by_rank(path)

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def added(self) -> re.Pattern:
        """Names of added tokens, which a text may hold and only the file's own library knows."""
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        return re.compile("|".join(map(re.escape, names)) or r"(?!)")

    def ids(self, text: str) -> list[int]:
        if self.by_rank is None or self.added.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.by_rank.encode_ordinary(text)

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return array("I", self.ids(text)).tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per file and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
