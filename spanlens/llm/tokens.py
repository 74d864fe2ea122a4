"""Ids of texts under a public byte-level tokenizer file, in numpy arrays."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Characters between two texts that are encoded both ways.
CHECK = 1 << 18
#: Characters for which both libraries split and merge alike; a text with another one goes to the library whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False.

    The library reads the file and encodes any text that holds a special token or a character outside the common
    ranges. For all other texts its vocabulary is run by tiktoken, which gives the same ids several times faster. Every
    text that begins another CHECK characters of these is encoded both ways, from a worker's first text on; should
    two differ, the task fails.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        stand, self.fast, self.since = _bytes_of(), None, CHECK
        ranks = {bytes(stand[c] for c in piece): i for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if piece not in added}
        model = json.loads(self.tokenizer.to_str())
        if model["model"]["type"] == "BPE" and model["normalizer"] is None and (model["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"]:
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _OTHER.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        out = np.array(self.fast.encode_ordinary(text), np.uint32)
        self.since += len(text)
        if self.since >= CHECK and text:
            self.since = 0
            if not np.array_equal(out, self.whole(text)):
                raise RuntimeError("tiktoken and the tokenizers library give different ids for a text")
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
