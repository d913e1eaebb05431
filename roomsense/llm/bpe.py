"""Byte-level BPE for one vocabulary file of the ``tokenizers`` library, and where a text may be cut.

``ByteBpe.encode`` gives the ids that the library gives.  Where the file's merges are in rank order (every byte-level
file of the GPT-2 kind), ``tiktoken``'s core, built from the same file, encodes texts whose characters all versions of
Unicode classify alike; any other text goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Latin letters, Greek, Cyrillic and general punctuation: assigned alike since Unicode 6.
OLD = re.compile(r"[\x00-ɏΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞€]*")


def byte_chars() -> list[str]:
    """Byte -> the printable character that byte-level BPE writes for it."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class ByteBpe:
    def __init__(self, path: str):
        import tokenizers

        self.lib = tokenizers.Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.chars = byte_chars()
        back = {c: b for b, c in enumerate(self.chars)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.bytes: dict[int, bytes] = {i: bytes(back[c] for c in w) for w, i in vocab.items()}
        merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.core = None
        if spec.get("normalizer") is None and merges == sorted(merges) and len(vocab) == 256 + len(merges):
            import tiktoken

            self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()},
                                          special_tokens=self.special)
        self.bytes |= {i: w.encode() for w, i in self.special.items()}
        top = max(self.bytes) + 1
        self.table = [self.bytes.get(i, b"") for i in range(top)]
        self.lengths = [len(b) for b in self.table]

    def encode(self, text: str) -> list[int]:
        if self.core is not None and OLD.fullmatch(text):
            return self.core.encode(text, allowed_special="all", disallowed_special=())
        return self.lib.encode(text, add_special_tokens=False).ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge the bytes of one pre-token, without splitting it."""
        chars = self.chars
        return [t.id for t in self.lib.model.tokenize("".join([chars[b] for b in piece]))]

    def decode(self, ids) -> str:
        """The library's ``decode(ids, skip_special_tokens=False)``: bytes joined, ill-formed ones replaced."""
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One encoder per vocabulary file and Python worker."""
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_BREAK = frozenset(" \t\n\r\x0b\x0c")


def proven(text: str, p: int) -> bool:
    """True if every encoding has a pre-token boundary before ``text[p]``, whatever stands to the left or right.

    The split pattern has no alternative in which a white-space character follows any other character, and a
    match looks only forward from its start; so what follows such a place is encoded as if the text began there.
    """
    return 0 < p < len(text) and text[p] in _BREAK and not text[p - 1].isspace()


def last_proven(text: str, low: int, high: int) -> int:
    """The largest proven boundary in [low, high), or -1."""
    p = min(high, len(text)) - 1
    while p >= max(low, 1):
        if text[p] in _BREAK and not text[p - 1].isspace():
            return p
        p -= 1
    return -1
