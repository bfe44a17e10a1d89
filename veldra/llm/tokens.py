"""Public tokenizers inside tasks: packed ids of whole texts.

The files are read on the driver and go to the workers as bytes (some two megabytes), so workers need no path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np

from veldra.llm.bpe import byte_chars

#: How the byte-level tokenizer's file cuts a text before it merges.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that a task encodes at once.
AT_ONCE = 1 << 20


class ByteLevel:
    """Byte-level BPE from a file of the tokenizers library.

    Its merges come in the order of the merged tokens' ids, so the tiktoken engine, which is several times faster,
    gives the same ids; the tests hold it against the library, with every code point.  ``special``: strings of special
    tokens in a text are these tokens, else they are ordinary text.
    """

    def __init__(self, spec: bytes, special: bool):
        import tiktoken

        found = json.loads(spec)
        inverse = {c: b for b, c in enumerate(byte_chars())}
        own = {t["content"]: t["id"] for t in found["added_tokens"]}
        ranks = {bytes(inverse[c] for c in t): i for t, i in found["model"]["vocab"].items() if t not in own}
        self.lengths = np.zeros(max([*ranks.values(), *own.values()]) + 1, "int64")
        for b, i in ranks.items():
            self.lengths[i] = len(b)
        engine = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=own)
        allowed: set[str] = set(own) if special else set()
        self.encode = lambda text: engine.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


class PieceBPE:
    """BPE with byte fallback from a sentencepiece model, which sets a space before each text by itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.engine = engine = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [engine.id_to_piece(i) for i in range(engine.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if engine.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], "int64")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.engine.encode(texts, num_threads=1)

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def portions(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters; a longer text has one of its own."""
    first = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and size + n > most:
            yield slice(first, k)
            first, size = k, 0
        size += n
    if len(texts) > first:
        yield slice(first, len(texts))


#: The tokenizers of this worker's present job, for its next tasks.
_LIVE: dict[str, object] = {}


def live(job: str, make):
    """What ``make`` gives, once a job in each worker."""
    if job not in _LIVE:
        _LIVE.clear()
        _LIVE[job] = make()
    return _LIVE[job]
