"""Encoders over the public tokenizer files, loaded once in each Python worker."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Outside these characters the byte-level encoder leaves the work to the tokenizers library, so that differences
#: between the Unicode tables of two regex engines cannot matter.
_WIDE = re.compile("[^\t-\r -~ -ɏ‐-‧€]")
#: White space as the tokenizer's own pattern has it (without the four separators that Python's ``split`` adds).
_PY_ONLY_SPACE = re.compile("[\x1c-\x1f]")
_WORDS = re.compile("[^\t-\r \x85   -     　]+")


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_bpe(name: str = "byte_bpe_50k.json") -> "ByteBPE":
    return ByteBPE(path(name), path(name.replace(".json", ".tiktoken")))


@functools.cache
def word_bpe(name: str = "word_bpe_49k.json", cache_words: int = 600_000) -> "WordBPE":
    return WordBPE(path(name), cache_words)


class ByteBPE:
    """Byte-level BPE; ids equal those of the tokenizers library without added special tokens."""

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.library.no_truncation()
        self.library.no_padding()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or _WIDE.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def to_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``: invalid byte runs become U+FFFD."""
        return self.to_bytes(ids).decode("utf-8", "replace")


def _alphabet() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; emptied when it has grown to ``most`` words.

    Words of Latin letters and signs go to a rank-based merger in which byte 255, which no text holds, marks a word's
    end; all others go to the tokenizers library.
    """

    #: Code points below this are their own normal form, and lower-case letter by letter.
    LATIN = "\u0250"
    END = b"\xff"

    def __init__(self, json_path: str, library, most: int):
        import regex
        import tiktoken

        self.library, self.most = library, most
        with open(json_path) as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], _alphabet()
        plain = {b: vocab[c] for c, b in letters.items()} | {bytes([b]) + self.END: vocab[c + "</w>"] for c, b in letters.items() if b != 255}
        ids = {bytes([k]) if isinstance(k, int) else k: i for k, i in plain.items()}
        for merge in spec["model"]["merges"]:
            token = "".join(merge if isinstance(merge, list) else merge.split(" "))
            stem = token.removesuffix("</w>")
            ids[bytes(map(letters.__getitem__, stem)) + self.END * (stem != token)] = vocab[token]
        self.code = [int(i).to_bytes(4, "little") for i in ids.values()]  # by rank: bytes, ended bytes, merges
        self.merge = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks={k: n for n, k in enumerate(ids)}, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.odd = re.compile("[\x00-\x20\x7f-\xa0]|<\\|").search

    def piece(self, small: str) -> bytes:
        code = self.code
        return b"".join([code[n] for n in self.merge(small.encode() + self.END)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        small = word.lower()
        if word.isalpha() and (word.isascii() or max(small) < self.LATIN):
            found = self.piece(small) if small == word else self[small]
        elif (stem := word.rstrip(".,;:!?")) != word and stem.isalpha():  # signs after a letter are a piece of their own
            found = self[stem] + self[word[len(stem) :]]
        elif max(small) >= self.LATIN or self.odd(word):
            found = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            found = b"".join([self.piece(x) for x in self.pieces(small)])
        self[word] = found
        return found


class WordBPE:
    """BPE whose pre-tokenizer drops white space, so that each run between white space is encoded by itself, once."""

    def __init__(self, json_path: str, cache_words: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = _WordIds(json_path, self.library, cache_words)

    def encode(self, text: str) -> np.ndarray:
        words = _WORDS.findall(text) if _PY_ONLY_SPACE.search(text) else text.split()
        ids = b"".join(map(self.words.__getitem__, words))
        return np.frombuffer(ids, "<u4")
