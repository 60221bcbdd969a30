"""Texts cut where a byte-level BPE tokenizer always cuts, so that each distinct piece is encoded once.

The tokenizer's pattern never lets a token reach over a space that a non-space character follows: words and marks take no
trailing space, and a run of white space leaves its last one to what follows. The pieces' ids, joined, are the text's ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Python's \s holds every Unicode white space, so a cut here is one for the tokenizer too.
_IRREGULAR = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")
#: Pieces kept by one Python worker; beyond it the store starts afresh. Workers outlive their tasks, so it counts as memory.
MAX_PIECES = 2_000_000


class PieceEncoder:
    """Ids of texts as little-endian 32-bit bytes. ``encode``: the ids' bytes of each of a list of short strings.

    ``encode_spaced``, if given, does so for strings that each begin with a cut.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], special: Iterable[str],
                 encode_spaced: Callable[[list[str]], Iterable[bytes]] | None = None, max_pieces: int = MAX_PIECES):
        self._encode, self._special, self._encode_spaced = encode, tuple(special), encode_spaced or encode
        self._max = max_pieces
        self._heads: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def forget(self) -> None:
        self._heads.clear()
        self._spaced.clear()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self._heads) + len(self._spaced) > self._max:
            self.forget()
        whole = {i: next(iter(self._encode([t]))) for i, t in enumerate(texts) if any(s in t for s in self._special)}
        parts = [[""] if i in whole else _CUT.split(t) if _IRREGULAR.search(t) else t.split(" ") for i, t in enumerate(texts)]
        heads = [p[0] for p in parts]
        spaced: set[str] = set()
        for p in parts:
            spaced.update(p[1:])
        for known, used, space, encode in ((self._heads, {*heads}, "", self._encode),
                                           (self._spaced, spaced, " ", self._encode_spaced)):
            if new := [x for x in used if x not in known]:
                known.update(zip(new, encode([space + x for x in new])))
        get = self._spaced.__getitem__
        out = [b"".join([self._heads[h], *map(get, p[1:])]) for h, p in zip(heads, parts)]
        return [whole.get(i, x) for i, x in enumerate(out)]


def library_encoder(tokenizer_json: str, specials_are_text: bool = False) -> PieceEncoder:
    """The tokenizers library's encoding without added special tokens. ``specials_are_text``: their strings are ordinary."""
    import json
    import os
    from struct import pack

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = specials_are_text

    specials = [x["content"] for x in json.loads(tokenizer_json)["added_tokens"]]
    sizes = np.array([len(tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size())])  # a letter for each byte

    def encode(strings: list[str]) -> list[bytes]:
        return [pack(f"<{len(e.ids)}I", *e.ids) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def encode_spaced(strings: list[str]) -> Iterator[bytes]:
        """One call for all: their ids follow each other and are told apart by their bytes."""
        ids = np.array(tokenizer.encode("".join(strings), add_special_tokens=False).ids, "<u4")
        ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in strings])
        cuts = (np.searchsorted(np.cumsum(sizes[ids]), ends) + 1).tolist()
        data = ids.tobytes()
        return (data[4 * i : 4 * j] for i, j in zip([0, *cuts], cuts))

    return PieceEncoder(encode, [] if specials_are_text else specials, encode_spaced)


_encoders: dict = {}


def worker_encoder(tokenizer_json: str, specials_are_text: bool = False) -> PieceEncoder:
    """One encoder for each Python worker and tokenizer, kept over its tasks."""
    key = (hash(tokenizer_json), specials_are_text)
    if key not in _encoders:
        _encoders[key] = library_encoder(tokenizer_json, specials_are_text)
    return _encoders[key]
