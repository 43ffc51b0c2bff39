"""Token ids of texts by a tokenizer file.

The ``tokenizers`` library defines the ids. Where the file is a plain byte-level BPE, its
vocabulary is also given to ``tiktoken``, which does the same merges several times faster;
it encodes texts of Latin-1 characters, on whose classes all versions of Unicode agree.
All other texts, and such with special tokens in them, go to ``tokenizers``.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def encoder(path: str, kind: str = "<u4", literal: bool = False) -> Encoder:
    """The one encoder that a worker's tasks share."""
    return Encoder(path, kind, literal)


class Encoder:
    """Ids of texts as little-endian bytes of ``kind``; made on the worker that uses it.

    ``literal`` has the strings of special tokens read as ordinary text.
    """

    def __init__(self, path: str, kind: str = "<u4", literal: bool = False) -> None:
        from tokenizers import Tokenizer

        self.kind = np.dtype(kind)
        self._tokenizer = Tokenizer.from_file(path)
        if literal:
            self._tokenizer.encode_special_tokens = True
        special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = () if literal else tuple(special)
        self._fast = _byte_level(path, set(special))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = []
        slow: list[int] = []
        for k, data in enumerate(texts):
            text = data.decode("utf-8", "replace")
            if self._fast is not None and _latin(text) and not any(x in text for x in self._special):
                out.append(np.array(self._fast.encode_ordinary(text), self.kind).tobytes())
            else:
                out.append(None)
                slow.append(k)
        if slow:
            found = self._tokenizer.encode_batch([texts[k].decode("utf-8", "replace") for k in slow], add_special_tokens=False)
            for k, one in zip(slow, found, strict=True):
                out[k] = np.array(one.ids, self.kind).tobytes()
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_level(path: str, special: set[str]) -> object | None:
    """The file's vocabulary as an encoding of tiktoken, if it has nothing that this leaves out."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, split = whole["model"], whole.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("dropout")
    plain = plain and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not whole.get("normalizer")
    byte_level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not (plain and byte_level):
        return None
    byte_of = {written: byte for byte, written in enumerate(_written_bytes())}
    vocabulary = {token: number for token, number in model["vocab"].items() if token not in special}
    merged = [vocabulary.get("".join(x.split(" ") if isinstance(x, str) else x)) for x in model["merges"]]
    # Merges apply in the order of their results' ids, or the ids are no ranks.
    if None in merged or merged != sorted(merged) or any(x not in byte_of for token in vocabulary for x in token):
        return None
    ranks = {bytes(byte_of[x] for x in token): number for token, number in vocabulary.items()}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _written_bytes() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(byte) if byte in shown else chr(next(others)) for byte in range(256)]
