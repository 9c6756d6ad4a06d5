"""Whole texts as pieces between which the byte-level tokenizer always cuts, so that tokens of pieces add up."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: A cut before a space is safe if what precedes it isn't white space. Python's class holds all that the tokenizer's pattern calls white space.
_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer, once a worker, without threads of its own, padding or truncation."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def split(text: str) -> tuple[str, list[str]]:
    """The first piece, and the others without the space that each begins with."""
    if _UNSAFE.search(text):
        head, *rest = _CUT.split(text)
        return head, [x[1:] for x in rest]
    head, *rest = text.split(" ")
    return head, rest


def cut(text: str) -> list[str]:
    """Pieces that join to the text; all but the first begin with a space."""
    if not text:
        return []
    head, rest = split(text)
    return ([head] if head else []) + [" " + x for x in rest]


@lru_cache(maxsize=4)
def begins(path: str) -> np.ndarray:
    """Whether each token of a byte-level vocabulary begins with a space."""
    tokenizer = load(path)
    return np.array([(tokenizer.id_to_token(k) or "").startswith("\u0120") for k in range(tokenizer.get_vocab_size())])


def encode_pieces(path: str, pieces: list[str]) -> list[bytes]:
    """Ids, four bytes each, of pieces that are given without the space before them. Many are encoded as one text, cut again where tokens begin with a space."""
    tokenizer, starts, out = load(path), begins(path), {}
    plain = [x for x in pieces if x and " " not in x and not x[-1].isspace()]  # before the next one's space a cut is safe
    lines = [plain[k : k + 256] for k in range(0, len(plain), 256)]
    for line, found in zip(lines, tokenizer.encode_batch_fast(["".join([" " + x for x in line]) for line in lines], add_special_tokens=False), strict=True):
        ids = np.asarray(found.ids, "<u4")
        edges = np.flatnonzero(starts[ids])
        if len(edges) == len(line):
            data = ids.tobytes()
            ends = [*(edges[1:] * 4).tolist(), len(data)]
            out.update((x, data[a:b]) for x, a, b in zip(line, (edges * 4).tolist(), ends, strict=True))
    rest = [x for x in pieces if x not in out]
    for x, found in zip(rest, tokenizer.encode_batch_fast([" " + x for x in rest], add_special_tokens=False), strict=True):
        out[x] = np.asarray(found.ids, "<u4").tobytes()
    return [out[x] for x in pieces]
