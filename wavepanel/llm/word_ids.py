"""Token ids of whole texts, with the work shared between equal words.

The vocabulary's tokenizer never lets a token cross a space or a line break,
so a text's ids are the ids of its space-separated chunks in a row.  Chunks
repeat, so a worker keeps the ids of the chunks that it met (a cache of
bounded size; it is emptied when full and never changes a result).

In a text of Latin letters, a full stop or comma after a letter or digit and
before a space is a token run of its own, and is cut off so that a word has
one entry.  A chunk of small Latin letters goes straight to the vocabulary's
merges (``_letter_merges``); any other chunk goes through the whole
tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from .common import hold

#: Entries kept in the cache of a worker process.
CACHE_ENTRIES = 400_000
#: Chunks longer than this are not kept.
CACHE_CHARS = 48
#: Characters that normalisation changes by more than case, or that are beyond the Latin blocks.
_LAST_LATIN = "ɏ"
_NOT_LATIN = re.compile("[^\0-įı-ɏ]")
#: Letters, then marks that are a run of their own.
_MARKED = re.compile(r"([^\W\d_]+)([.,;:!?*$%&#|)\"]+)")
#: A full stop or comma that belongs to a longer run of marks.
_RUN_OF_MARKS = re.compile(r"[.,][ \n](?<=[\W_]..)", re.DOTALL)


_ENCODERS: dict[str, "WordEncoder"] = {}


def encoder(path: str) -> "WordEncoder":
    """One encoder for each vocabulary and worker process."""
    hold("word_ids", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: Where the symbols of bytes above 127 start, inside a word and at its end.
_INNER, _LAST = 0x100, 0x200


def _inner(data: bytes) -> str:
    """Bytes inside a word, each as one character."""
    return "".join(chr(b if b < 128 else _INNER + b) for b in data)


def _last(data: bytes) -> str:
    """Bytes up to a word's end: the vocabulary has symbols of their own for
    last bytes, so these get characters of their own."""
    return _inner(data[:-1]) + (chr(data[-1]).upper() if data[-1] < 128 else chr(_LAST + data[-1]))


_INNER_LETTERS = {c: _inner(chr(c).encode()) for c in range(128, ord(_LAST_LATIN) + 1)}
_LAST_LETTERS = {chr(c): _last(chr(c).encode()) for c in (*range(97, 123), *range(128, ord(_LAST_LATIN) + 1))}


def _letter_merges(path: str):
    """The vocabulary's tokens of small letters as ranks for tiktoken.

    Vocabularies of this kind number their merges in order, so a token's id
    is its rank.  The bytes of a symbol beyond ASCII come together first.
    """
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    # the character by which the vocabulary writes each byte
    by_character = {}
    for b in range(128, 256):
        lead, at = (bytes([b]), 0) if b >= 0xC0 else (b"\xc2", 1)
        text = (lead + b"\x80" * 3)[:_utf8_length(lead[0])] if at == 0 else lead + bytes([b])
        try:
            written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text.decode())
        except UnicodeDecodeError:
            continue
        by_character[written[0][0][at]] = b
    ranks: dict[bytes, int] = {}
    for token, i in vocab.items():
        body = token.removesuffix("</w>")
        data = [ord(c) if c.isascii() else by_character.get(c, -1) for c in body]
        if not data or any(b < 0 or b < 128 and not 97 <= b <= 122 for b in data):
            continue
        ranks[(_inner(bytes(data)) if body == token else _last(bytes(data))).encode()] = i
    raw = max(vocab.values()) + 1
    for b in range(256):
        if bytes([b]) not in ranks:
            ranks[bytes([b])] = raw
            raw += 1
    return tiktoken.Encoding("letters", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})


def _utf8_length(lead: int) -> int:
    return 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class _Cache(dict):
    """Ids of chunks; a chunk that isn't there is encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _letter_merges(path)

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > CACHE_CHARS:
            return _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if chunk.isalpha() and chunk.islower() and not _NOT_LATIN.search(chunk):
            inner = chunk[:-1]
            if not inner.isascii():
                inner = inner.translate(_INNER_LETTERS)
            data = _packed(self.merges.encode_ordinary(inner + _LAST_LETTERS[chunk[-1]]))
        elif (m := _MARKED.fullmatch(chunk)) and not _NOT_LATIN.search(chunk):
            data = self[m[1].lower()] + _packed(self.tokenizer.encode(m[2], add_special_tokens=False).ids)
        else:
            data = _packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        self[chunk] = data
        return data


def _packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache = _Cache(path)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
            cache[""] = b""
        if not _NOT_LATIN.search(text):
            if not _RUN_OF_MARKS.search(text):
                text = text.replace("\n", " ").replace(", ", " , ").replace(". ", " . ")
            text = text.lower()
        return b"".join(map(cache.__getitem__, text.replace("\n", " ").split(" ")))
