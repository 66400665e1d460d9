"""Byte-level BPE ids of whole texts, with the words seen so far kept per worker.

A space followed by anything but white space always begins a new pre-token, so
the stretches between single spaces are encoded apart and repeat often. Texts
with wider white space or special tokens go through the library as they are.
"""

from __future__ import annotations

import json
import re

import numpy as np

from panelspark.llm.common import worker_state

_CACHED_WORDS = 600_000
# the published pre-token pattern of this vocabulary (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE_SPACE = re.compile(r"\s\s")


class _Stretches(dict):
    """Ids of ' ' + stretch as little-endian unsigned 16-bit numbers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        ids = self[stretch] = np.array(self.encode(" " + stretch), "<u2").tobytes()
        return ids


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _load(vocabulary: str):
    """The library for whole texts, and a faster encoder of the same file for stretches.

    In such a vocabulary the ids follow the order of the merges, so it can be
    handed over as ranks; a file where they don't goes through the library alone.
    """
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.no_truncation()
    library.no_padding()
    if library.get_vocab_size() > 1 << 16:
        raise ValueError("ids of 16 bits are needed")
    specials = {t.content for t in library.get_added_tokens_decoder().values()}

    def encode(text: str) -> list:
        return library.encode(text, add_special_tokens=False).ids

    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model["vocab"]
    joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    quick = encode
    if joined == sorted(joined):
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in specials}
        quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return encode, _Stretches(quick), sorted(specials)


def byte_bpe_ids(texts: list, vocabulary: str, ordinary: bool = False) -> list[bytes]:
    """Ids of every text, null as empty, as the tokenizers library gives them.

    With ``ordinary``, the strings of special tokens are text like any other.
    """
    encode, stretches, specials = worker_state(("byte-bpe", vocabulary), lambda: _load(vocabulary))
    found = []
    for text in texts:
        text = text or ""
        if _WIDE_SPACE.search(text) or any(s in text for s in specials):
            found.append(np.array((stretches.encode if ordinary else encode)(text), "<u2").tobytes())
            continue
        parts = text.split(" ")
        first = np.array(encode(parts[0]), "<u2").tobytes()
        found.append(first + b"".join(map(stretches.__getitem__, parts[1:])))
    return found
