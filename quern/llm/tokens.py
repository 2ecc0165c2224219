"""Exact and fast encoding with a public tokenizer file.

A tokenizer of the ``tokenizers`` library cuts a text into pieces before it merges, and the
kinds used here never join what a blank separates.  So a text may be cut there first,
and each distinct piece is encoded once and remembered; natural text repeats its words, and
the result is the same ids that encoding the whole text gives (tests compare them).

* byte-level files: cut before each blank that something other than white space follows; the
  blank goes with what follows, and white space before it stays together, as in the file's own pattern.
* word files (lower case, white space dropped): lowered first, then cut at ASCII white space.

A piece met for the first time is cut further where the file's pattern does so in any case (at
single line breaks, before last marks), and what is a word of letters alone goes to the bare
merging model of the file: the pattern has nothing to cut there.  For any other file,
``Encoder`` encodes whole texts.

The library reads the string of an added token (``<|endoftext|>``, say) inside a text as that token,
also with ``add_special_tokens=False``, and so does ``Encoder``: a text is cut at these strings first.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from codecs import charmap_decode
from functools import cached_property

import numpy as np

#: Distinct pieces of one generation, by kind of file; a worker remembers two.
REMEMBERED = {"bytes": 450_000, "words": 300_000, "whole": 0}
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s']+)")
_BLANKS = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r"(?= \S)")

#: The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in turn from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_LETTERS = "".join(BYTES[b] for b in range(256))

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task is one thread
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _Known(dict):
    """piece -> ids as bytes, made when first asked for; pieces not asked for in two generations are forgotten."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        added = spec.get("added_tokens") or []
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in added}
        # where one string begins another, the longer is meant
        self.added_in = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        verbatim = not any(x.get(k) for x in added for k in ("normalized", "lstrip", "rstrip", "single_word"))
        self.kind = "bytes" if pre.get("type") == "ByteLevel" and not norm and pre.get("use_regex") and not pre.get("add_prefix_space") else "words" if steps == ["NFC", "Replace", "Lowercase"] and (spec["model"].get("end_of_word_suffix") == "</w>") else "whole"
        if not verbatim:
            self.kind = "whole"
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in added)], default=-1) if isinstance(spec["model"].get("vocab"), dict) else self.tokenizer.get_vocab_size()
        if self.kind != "whole":
            # between added tokens: a text that is lowered to their string does not hold it
            self.between = Tokenizer.from_str(json.dumps(spec | {"added_tokens": []}))
            bare = spec | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder", "truncation", "padding")) | {"added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(bare)).model
            if hasattr(self.model, "_resize_cache"):
                self.model._resize_cache(0)  # pieces are remembered here; a second memory only costs time
        most = REMEMBERED[self.kind]
        self.first = _Known(lambda p: self._make(p, "", self.first), most)
        self.spaced = _Known(lambda p: self._make(p, " ", self.spaced), most)  # keys without their blank

    @cached_property
    def tokenizer(self):
        """The file as it is; the fast paths do without it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, tokenizer, text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _make(self, piece: str, blank: str, own: _Known) -> bytes:
        if piece.isalpha():
            letters, _ = charmap_decode((blank + piece).encode(), "strict", _LETTERS)
            return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if (m := _WORD_AND_MARKS.fullmatch(piece)) and m[1].isalpha():
            return own[m[1]] + self.first[m[2]]
        if "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                return self.first["\n"].join([own[lines[0]], *(self.first[x] for x in lines[1:])])
        return self._ids(self.between, blank + piece)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids, as unsigned 32-bit numbers, without special tokens around them."""
        if not text:
            return np.empty(0, np.uint32)
        if self.kind == "whole":
            return np.frombuffer(self._ids(self.tokenizer, text), np.uint32)
        if any(x in text for x in self.added):
            return np.frombuffer(b"".join(self.added.get(part) or self._between(part) for part in self.added_in.split(text) if part), np.uint32)
        return np.frombuffer(self._between(text), np.uint32)

    def _between(self, text: str) -> bytes:
        """The ids of a text, or of what lies between added tokens."""
        if self.kind == "bytes":
            if _BLANKS.search(text):
                return b"".join(self.spaced[p[1:]] if p[0] == " " and len(p) > 1 else self.first[p] for p in _CUT.split(text) if p)
            head, *rest = text.split(" ")
            return b"".join([*([self.first[head]] if head else []), *map(self.spaced.__getitem__, rest)])
        if self.kind == "words":
            low = text.lower()
            # a last sigma is lowered by its place in a word, and a lowered text need not be normal: leave those to the library
            if "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                for c in "\t\n\r\x0b\x0c":
                    low = low.replace(c, " ")
                return b"".join(map(self.first.__getitem__, filter(None, low.split(" "))))
        return self._ids(self.between, text)
