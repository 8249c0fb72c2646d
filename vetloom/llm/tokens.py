"""Token ids of whole texts, as little-endian unsigned 32-bit integers.

A vocabulary is given as ranks, or as a tokenizer file.  A tokenizer file that
is plain byte-level BPE whose merges come in the order of their ids is the same
thing as ranks, and is run as such, which is several times faster; any other
file is run by its own library.  Either way a text has the ids that its library
gives: the strings of a tokenizer file's added tokens are those tokens, while a
rank file has none.

The libraries cannot match white space of about a million characters in a row.
By :data:`BYTE_LEVEL` such a run is one pre-token, without its last character
where a text goes on behind it, so it is cut out and encoded as that.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: How byte-level tokenizer files split texts.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space from this length on is cut out of a text.
RUN = 1 << 16
_ID = np.dtype("<u4")

Encoder = Callable[[list[str]], list[bytes]]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _cut(text: str) -> Iterator[tuple[str, bool]]:
    """The parts of a text, and whether each is a long run of white space: one pre-token."""
    import regex

    at = 0
    if len(text) >= RUN:
        # behind a character of a run none begins, so that each run is matched once
        for run in regex.finditer(r"(?<!\p{White_Space})\p{White_Space}{%d,}+" % RUN, text):
            stop = run.end() - (run.end() < len(text))
            yield text[at : run.start()], False
            yield text[run.start() : stop], True
            at = stop
    yield text[at:], False


def _encoder(own: dict[bytes, int], pattern: str, added: dict[str, int]) -> Encoder:
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={})
    split = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else None

    @lru_cache(maxsize=1)
    def single() -> tiktoken.Encoding:
        return tiktoken.Encoding("single", pat_str="(?s:.+)", mergeable_ranks=own, special_tokens={})

    def run(text: str, by: tiktoken.Encoding) -> bytes:
        return by.encode_to_numpy(text, disallowed_special=()).astype(_ID, copy=False).tobytes()

    def ids(text: str) -> bytes:
        if any(name in text for name in added):
            return b"".join(_ID.type(added[t]).tobytes() if t in added else ids(t) for t in split(text))
        if pattern != BYTE_LEVEL or len(text) < RUN:
            return run(text, encoding)
        return b"".join(run(t, single() if one else encoding) for t, one in _cut(text))

    return lambda texts: [ids(t) for t in texts]


@lru_cache(maxsize=2)
def by_ranks(path: str, pattern: str) -> Encoder:
    """Byte-level BPE by ranks; strings of special tokens are ordinary text."""
    return _encoder(ranks(path), pattern, {})


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def file_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The ranks and added tokens that a tokenizer file amounts to, null if it is not of that kind."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or not level or file.get("normalizer"):
        return None
    byte_of, vocab = _byte_of(), model["vocab"]
    tokens = file.get("added_tokens", [])
    added = {t["content"]: t["id"] for t in tokens}
    if any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word")) or any(a != b and b in a for a in added for b in added):
        return None
    own = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    if made != sorted(set(made)) or len(own) != 256 + len(made) or any(i >= made[0] for t, i in own.items() if len(t) == 1):
        return None
    return own, added


@lru_cache(maxsize=2)
def by_tokenizer(path: str) -> Encoder:
    """A tokenizer file, without the tokens that it would add around a text."""
    if (found := file_ranks(path)) is not None:
        return _encoder(found[0], BYTE_LEVEL, found[1])
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [np.array(x.ids, _ID).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
