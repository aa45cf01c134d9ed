"""Public tokenizers on executors: encoders, and the bytes that each id stands for.

Files are named by path and opened once per Python worker. The byte-level table is read from its JSON
file and run by tiktoken, which gives the same ids as the file's own library in a third of its time.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np

#: How byte-level tables cut a text into words, and the sign that stands for a blank in piece tables (fixed values).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_BLANK = "▁"
#: Longer stretches without a letter or digit are encoded by the file's own library: the other one backtracks there.
LONGEST_BLANK = 100_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _letters() -> dict[str, int]:
    """Letter of a byte-level table -> byte: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[Callable, list[bytes]]:
    """``encode(text, special)`` as a uint32 array, and the bytes of each id, for a byte-level BPE file.

    ``special`` tells whether the strings of special tokens inside a text become their ids, as in the
    file's own library, or are plain text.
    """
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    letters = _letters()
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for word, i in ranks.items():
        table[i] = word
    for word, i in special.items():
        table[i] = word.encode()
    quick = tiktoken.Encoding(path, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.lru_cache(maxsize=2)
    def own(plain: bool) -> tokenizers.Tokenizer:
        t = tokenizers.Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        return t

    def encode(text: str, special_ids: bool = False) -> np.ndarray:
        if len(text) > LONGEST_BLANK and _long_blank(text):
            return np.array(own(not special_ids).encode(text, add_special_tokens=False).ids, np.uint32)
        allowed = set(special) if special_ids else set()
        return quick.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    return encode, table


def _long_blank(text: str) -> bool:
    import re

    return re.search(r"\s{%d}" % LONGEST_BLANK, text) is not None


@functools.lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[Callable, list[bytes]]:
    """``encode(texts)`` as lists of ids, and the bytes of each id, for a piece file with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        table.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace(PIECE_BLANK, " ").encode())
    return functools.partial(model.encode, num_threads=1), table
