"""Token ids of whole texts from the public tokenizers, fast enough for a corpus."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The normalising and splitting rules that the chunk path below relies on.
CHUNKED_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters on which Python and the library agree: printable ASCII, Latin-1 and Latin Extended-A.
PLAIN = re.compile("[!-~¡-ſ]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by the public rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class WordCoder:
    """Ids of a text as little-endian uint32 bytes, equal to the library's.

    White space ends a word in this kind of vocabulary, so ids are looked up
    by white-space chunk and remembered. Unseen plain chunks go to the
    library's merge model, others and texts with special strings to the
    whole library. A tokenizer with other rules is given whole texts.
    """

    def __init__(self, path: str, limit: int = 600_000):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        norm = [x["type"] for x in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        pre = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.chunked = norm == CHUNKED_NORMALIZERS and pre.get("pattern", {}).get("Regex") == WORD_PATTERN
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.memo: dict[bytes, bytes] = {}
        self.limit = limit

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text):
            ids = [t.id for p in self.pieces(text.lower()) for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
            found = np.array(ids, "<u4").tobytes()
        else:
            found = self.library(text)
        if len(self.memo) < self.limit:
            self.memo[word] = found
        return found

    def encode(self, data: bytes) -> bytes:
        if not self.chunked or any(s in data for s in self.special):
            return self.library(data.decode("utf-8", "replace"))
        words = data.lower().split()
        if any(s in data.lower() for s in self.special):  # lower-casing would make a special string of it
            return self.library(data.decode("utf-8", "replace"))
        try:
            return b"".join(map(self.memo.__getitem__, words))
        except KeyError:
            get = self.memo.get
            return b"".join([x if (x := get(w)) is not None else self.chunk(w) for w in words])


@functools.cache
def word_coder(path: str) -> WordCoder:
    """One coder for each worker process; workers are reused between tasks."""
    return WordCoder(path)
