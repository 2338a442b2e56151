"""Token ids of whole texts with a public vocabulary file.

Ids are those of the `tokenizers` library for a byte-level BPE file. A text
splits at white space before any merge, so words are encoded once per worker
and looked up afterwards: a space or a line feed between two visible characters
always starts a new piece. Words go through tiktoken with the ranks of the same
file, which is faster for single words. A text with any other white space goes
to `tokenizers` as a whole. The two tables of known words, those that begin a
line and all others, hold `KNOWN_WORDS` words of about 200 bytes each at most.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Iterable

from signalmill.llm.common import once_per_worker

VOCABULARY = "byte_bpe_50k.json"
KNOWN_WORDS = 200_000
LONGEST_WORD = 48
_LETTER_THEN = frozenset(".,")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level files write visible Latin-1 bytes as themselves and the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


_PLAIN = array("I").itemsize == 4 and sys.byteorder == "little"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _PLAIN else b"".join(i.to_bytes(4, "little") for i in ids)


class _Known(dict):
    """Ids by word, as bytes; `lead` is put before each word."""

    def __init__(self, encode, lead: str, limit: int):
        self.encode, self.lead, self.limit = encode, lead, limit
        self.ends = {c: _packed(encode(c)) for c in _LETTER_THEN}

    def __missing__(self, word: str) -> bytes:
        end = self.ends.get(word[-1:])
        if end is not None and len(word) > 2 and word[-2].isalpha() and word[-2] < "ɐ":
            # A full stop or comma after a letter is a piece of its own.
            ids = self[word[:-1]] + end
        else:
            ids = _packed(self.encode(self.lead + word))
        if len(word) <= LONGEST_WORD:
            if len(self) >= self.limit:
                # Start again rather than grow; the words in use come back at once.
                self.clear()
            self[word] = ids
        return ids


def worker_encoder(path: str | None) -> Encoder:
    """The encoder of this worker; it keeps the words it knows from task to task."""
    return once_per_worker(("encoder", path), lambda: Encoder(path))


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str | None = None, known_words: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        path = path or vocabulary_path()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {x["content"] for x in content["added_tokens"]}
        at = _bytes_of_characters()
        ranks = {bytes(at[c] for c in k): v for k, v in content["model"]["vocab"].items() if k not in special}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = sorted(special)
        self.first = _Known(self.words.encode_ordinary, "", known_words)
        self.later = _Known(self.words.encode_ordinary, " ", known_words)
        self.line = _packed(self.words.encode_ordinary("\n"))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        if not self._regular(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        first, later, out = self.first.__getitem__, self.later.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first(words[0]) + b"".join(map(later, words[1:])))
        return self.line.join(out)

    def _regular(self, text: str) -> bool:
        """All white space is a space or a line feed alone between two visible characters."""
        if any(m in text for m in self.marks) or "᠎" in text:
            return False
        words = text.split()
        gaps = len(words) - 1
        return text.count(" ") + text.count("\n") == gaps and sum(map(len, words)) + gaps == len(text)
