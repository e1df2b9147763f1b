"""Token ids of the public byte-level BPE file, exact and cached by piece of text.

The pre-tokenizer of the file cuts a text at places that depend on the white space around them only: before
a space that a visible character follows, and around other white space. So a text is cut at those places,
each distinct piece is looked up in a cache of the worker process, and only pieces not met before go through
the pre-tokenizer pattern and the merges. Where the file numbers its tokens in the order of their merges, these are worked
out from the tokens' numbers, otherwise (and for very long pre-tokens) by the model of the ``tokenizers`` library. The ids equal those of
``Tokenizer.encode`` on the whole text with ``add_special_tokens=False``. A text that spells out one of the
file's added tokens is rare, and goes through the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from struct import pack

import regex

from .common import owned, working_for

#: The white space and the pattern of the byte-level pre-tokenizer, and its map of bytes.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Pre-tokens of more bytes than this are merged by the library, whose time does not grow with their square.
LONG_TOKEN = 200

_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_ODD_SPACE = re.compile(f" (?:[{_WHITE}]|$)")
_MARKS = frozenset(".,;:!?")
_TOKEN = regex.compile(PATTERN, regex.V0)


def _byte_letters() -> dict[int, str]:
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in _VISIBLE else chr(next(hidden)) for b in range(256)}


def _merger(path: str):
    """A function from the bytes of a pre-token to its ids, or None where ids do not follow the order of the merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order, bytes_of = [model["vocab"][m] for m in merged], {c: b for b, c in _byte_letters().items()}
    single = [t for t in model["vocab"] if len(t) == 1]
    if order != sorted(set(order)) or len(single) != 256 or len(single) + len(merged) != len(model["vocab"]) or not bytes_of.keys() >= set(single):
        return None
    ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in model["vocab"].items()}
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class Encoder(dict):
    """A cache from a piece of text to its ids (little-endian unsigned 32-bit, as bytes).

    Keys are pieces that follow a space, without the space; a piece that no space precedes is looked up by
    ``(piece,)``. At most ``entries`` pieces and ``words`` pre-tokens are kept.
    """

    def __init__(self, path: str, entries: int = 600_000, words: int = 200_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters, self.entries, self.words, self.most_words = _byte_letters(), entries, {}, words
        self.merge = _merger(path)

    def _ids(self, token: str) -> bytes:
        """The ids of one pre-token."""
        data = token.encode("utf-8", "surrogatepass")
        if self.merge is not None and len(data) <= LONG_TOKEN:
            ids = self.merge(data)
        else:
            ids = [t.id for t in self.model.tokenize(data.decode("latin-1").translate(self.letters))]
        return pack("<%dI" % len(ids), *ids)

    def _word(self, token: str) -> bytes:
        found = self.words.get(token)
        if found is None:
            found = self._ids(token)
            if len(self.words) >= self.most_words:
                self.words.clear()
            self.words[token] = found
        return found

    def __missing__(self, key) -> bytes:
        piece = key[0] if type(key) is tuple else " " + key
        # A space and letters are one pre-token, and one mark after them is another.
        if piece[0] == " " and piece[1:].isalpha():
            found = self._ids(piece) if len(piece) <= 40 else self._word(piece)
        elif piece[0] == " " and piece[-1] in _MARKS and piece[1:-1].isalpha():
            found = self._word(piece[:-1]) + self._word(piece[-1])
        else:
            found = b"".join(map(self._word, _TOKEN.findall(piece)))
        if len(piece) <= 40 and "\n" not in piece:
            if len(self) >= self.entries:
                super().clear()
            self[key] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.words.clear()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(map(text.__contains__, self.added)):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return pack("<%dI" % len(ids), *ids)
        if _ODD_SPACE.search(text) is None:
            first, *others = text.split(" ")
            start = self[(first,)] if first else b""
            return start + b"".join(map(self.__getitem__, others))
        look = self.__getitem__
        return b"".join([look(p[1:]) if p[0] == " " and len(p) > 1 and p[1] != " " else look((p,)) for p in _PIECE.findall(text)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for the file at ``path``."""
    working_for("subwords")
    if path not in _ENCODERS:
        _ENCODERS[path] = owned("subwords", Encoder(path))
    return _ENCODERS[path]
