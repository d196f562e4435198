"""Token ids of whole texts by the tokenizers library, with a bounded cache of the words it has encoded.

A batch of texts is cut into words and its distinct words are found by Arrow; Python sees each of them once a
batch, and the library's model sees only those that no earlier batch had. The ids of the texts are then gathered
from those of their words.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import keep_only

#: Words that one generation of a worker's cache holds; two generations are kept, about 200 MB.
CACHE_WORDS = 500_000
#: Bytes of text whose words are told apart at once.
SLICE_BYTES = 8 << 20

#: How the two vocabularies cut a text into pieces before they merge bytes.
GLUED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOWER = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks that are no letter, digit or space in any library: those at the end of a word are one piece.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters whose lower case, normal form and classes are alike in every library.
_simple = regex.compile(r"[\n\x20-\x7e\xa1-\xff]*").fullmatch
#: White space besides line ends at an edge of a word or next to more white space: what it is cut into depends on its neighbours.
_unsure = re.compile(r"(?:\A|\s)[^\S\n]|[^\S\n](?:\s|\Z)").search


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """The ids of whole texts as the library gives them, special tokens in a text included.

    A text is cut at spaces and line ends, where neither vocabulary merges anything across. In the glued (byte)
    vocabulary a word takes the space before it along, so texts with other runs of white space than one or two
    line ends go to the library whole, as do those that hold the string of a special token. A null text counts as empty.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.glued = os.path.basename(path).startswith("byte")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.pattern = regex.compile(GLUED if self.glued else LOWER).findall
        self.cache_words = cache_words
        self.new: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        self.pieces: dict[str, bytes] = {}  # of words that are cut

    def ids(self, text: str) -> bytes:
        """The library's ids of a text as little-endian uint32 bytes."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, x: str) -> bytes:
        """Of one piece of simple characters, as the pattern cuts them."""
        x = x if self.glued else x.lower()
        own = ("Ġ" + x[1:] if x[0] == " " else x) if x.isascii() and "\n" not in x else x.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words into the new generation; None for those whose texts the library must have whole."""
        new, pieces, glued = self.new, self.pieces, self.glued
        space = " " if glued else ""
        if len(pieces) > self.cache_words // 2:
            pieces.clear()

        def known(x: str) -> bytes:
            """Of a piece that other words have too."""
            found = pieces.get(x)
            if found is None:
                found = pieces[x] = self.piece(x)
            return found

        for w in words:
            if w.isalpha() and (w.isascii() or _simple(w)):
                found = pieces.get(space + w)  # what a cut word has left
                new[w] = self.piece(space + w) if found is None else found
                continue
            core = w.rstrip(MARKS)
            if "<" in w and any(s in w for s in self.special):
                new[w] = None
            elif core.isalpha() and (core.isascii() or _simple(core)):
                found = new.get(core) or self.old.get(core) or known(space + core)
                new[w] = found + known(w[len(core) :])
            elif _simple(w):
                if w[:1] != "\n":
                    w_ = space + w
                    new[w] = b"".join(map(known, self.pattern(w_ if glued else w.lower()))) if w_ else b""
                else:  # begins a line
                    new[w] = b"".join(map(known, self.pattern(w)))
            elif glued and _unsure(w):
                new[w] = None
            else:
                new[w] = self.ids(w if w[:1] == "\n" else space + w)

    def of_words(self, words: list[str]) -> list[bytes | None]:
        if len(self.new) > self.cache_words:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            old, missing = self.old, []
            for i in gaps:
                w = words[i]
                v = old.get(w)
                if v is not None:
                    self.new[w] = found[i] = v
                else:
                    missing.append(i)
            self.learn([words[i] for i in missing])
            for i in missing:
                found[i] = self.new[words[i]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        parts = [self._encode(t) for t in _slices(texts)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)  # texts that the library gets whole
        heads: list[str] = []
        if self.glued:
            for run in ("  ", " \n", "\n ", "\n\n\n"):
                whole |= pc.match_substring(texts, run).to_numpy(zero_copy_only=False)
            for edge in (pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.ends_with(texts, "\n\n")):  # line ends at the end are one piece
                whole |= edge.to_numpy(zero_copy_only=False)
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        found = self.of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter([-1 if v is None else len(v) >> 2 for v in found], np.int64, len(found))
        flat = np.frombuffer(b"".join([v for v in found if v]), "<u4")
        begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        if (size < 0).any():
            at = np.flatnonzero((size < 0)[codes])
            whole[np.searchsorted(offsets, at, "right") - 1] = True
        first = offsets[:-1]
        sizes, begins = size[codes], begin[codes]
        if self.glued:  # the first word of a text has no space before it
            heads = cut.flatten().take(pa.array(first)).to_pylist()
            own = [b"" if not h else self.ids(h) if h[0] != "\n" else None for h in heads]
            length = np.fromiter([-1 if v is None else len(v) >> 2 for v in own], np.int64, len(own))
            given = np.flatnonzero(length >= 0)
            extra = np.frombuffer(b"".join([v for v in own if v]), "<u4")
            sizes[first[given]] = length[given]
            begins[first[given]] = len(flat) + np.cumsum(length[given]) - length[given]
            flat = np.concatenate((flat, extra))
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        sizes[whole[doc]] = 0
        rest = np.flatnonzero(whole)
        if len(rest):  # stand in place of their first words
            more = [self.ids(t) for t in texts.take(pa.array(rest)).to_pylist()]
            length = np.fromiter([len(v) >> 2 for v in more], np.int64, len(more))
            sizes[first[rest]] = length
            begins[first[rest]] = len(flat) + np.cumsum(length) - length
            flat = np.concatenate((flat, np.frombuffer(b"".join(more), "<u4")))
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins - ends + sizes, sizes) + np.arange(total)]
        counts = np.diff(np.append(0, ends)[offsets])
        return ids, counts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), np.cumsum(counts) * 4
        return [raw[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in order, about SLICE_BYTES at a time, nulls as empty ones."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    sizes = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


_kept: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    keep_only(_kept.clear)
    if path not in _kept:
        _kept[path] = WordTokenizer(path)
    return _kept[path]
