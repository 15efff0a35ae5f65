"""Byte-pair token ids from public vocabulary files; the folder is a parameter."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

VOCABULARY_DIR = os.environ.get("TARIFOLD_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokenisation of the byte-level vocabularies, as published with them.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in runs of about this many characters, cut where no token can span.
RUN_CHARS = 400_000
#: A special token that is never allowed, so never given out. Without any, the search for special tokens matches the empty string at every character.
NEVER = "<|tarifold-never|>"

_loaded: dict[tuple[str, str], object] = {}


def encoder(name: str, folder: str = VOCABULARY_DIR):
    """The encoder of a .tiktoken vocabulary, loaded once per Python worker."""
    key = (folder, name)
    if key not in _loaded:
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _loaded[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={NEVER: max(ranks.values()) + 1})
    return _loaded[key]


def _runs(text: str) -> list[str]:
    """The text in runs cut between a word character and a single space before another one."""
    out, start = [], 0
    cut = re.compile(r"(?<=\w) (?=\w)")
    while len(text) - start > RUN_CHARS:
        found = cut.search(text, start + RUN_CHARS)
        if found is None:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def encode(enc, text: str) -> np.ndarray:
    """Token ids of the whole text; text that looks like a special token is ordinary text."""
    if len(text) <= RUN_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(run, disallowed_special=()) for run in _runs(text)])
