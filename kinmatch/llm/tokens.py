"""Exact, cached encoding with a public tokenizer.

White space never lies inside a token of this tokenizer, so a text is the
concatenation of its chunks between spaces and line feeds, and the ids of a
chunk are kept from one text to the next (two generations of bounded bytes).
Of unknown chunks, lower-case words of Latin letters, which normalisation leaves
as they are and pre-tokenisation never cuts, go straight to the library's model,
and what begins with such a word is cut after it.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Bytes that a kept chunk takes besides its characters and ids.
ENTRY = 160
#: Characters of texts that are cut into chunks at a time.
PIECE = 4 << 20
#: Beyond these letters lower-casing is left to the tokenizer.
_OTHER = re.compile("[^\x00-ɏ]")
#: Letters before a digit or a mark of ASCII, but for the apostrophe, which may stand in a token with letters.
_HEAD = re.compile(r"[^\W\d_]+(?=[!-&(-@\[-`{-~])")


def _settled(word: str) -> bool:
    """Whether normalisation keeps the word's letters apart from what follows: a dotted capital I, for one, leaves a mark that joins it."""
    return word.isascii() or word == word.lower() and not _OTHER.search(word)


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for the code points from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids by chunk; a chunk that is not there yet is learnt when it is asked for. A word with marks behind it is put together, not kept."""

    def __init__(self, tokenizer, old: dict):
        super().__init__({"": b""})
        self.encode, self.tokenize, self.old, self.taken = tokenizer.encode, tokenizer.model.tokenize, old, 0

    def __missing__(self, c: str) -> bytes:
        if c[-1] in ",." and (head := c[:-1]).isalpha() and _settled(head):  # pre-tokenisation cuts after a run of letters
            return self[head] + self[c[-1]]
        word = c.isalpha()
        if not word and (m := _HEAD.match(c)) and m[0].isalpha() and _settled(m[0]):
            return self[m[0]] + self[c[m.end() :]]
        if (ids := self.old.get(c)) is None:  # get() learns nothing
            if word and c.isascii() and c.islower():
                ids = array("I", [t.id for t in self.tokenize(c)]).tobytes()
            elif word and c == c.lower() and not _OTHER.search(c):
                ids = array("I", [t.id for t in self.tokenize(c.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
            else:
                ids = self.whole(c)
        self[c] = ids
        self.taken += ENTRY + len(c) + len(ids)
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, generation: int = 64 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.generation = Tokenizer.from_file(path), generation
        self.young = _Known(self.tokenizer, {})

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is empty. PIECE characters of texts, or one longer text, are in hand at a time."""
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t or "") > PIECE:
                out += self._group(group)
                group, size = [], 0
            group.append(t or "")
            size += len(t or "")
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[bytes]:
        """Every distinct chunk of the texts is looked up once; Arrow puts the ids in order."""
        whole = {i: self.young.whole(t) for i, t in enumerate(texts) if "<|" in t}  # may hold a special token: nothing is cut or lower-cased
        if self.young.taken > self.generation:
            self.young.old = {}
            self.young = _Known(self.tokenizer, self.young)
        plain = ["" if i in whole else t.lower() if t.isascii() or not _OTHER.search(t) else t for i, t in enumerate(texts)]
        cut = pc.split_pattern(pc.replace_substring(pa.array(plain, pa.large_string()), "\n", " "), " ")
        chunks = cut.values.dictionary_encode()
        known = pa.array(list(map(self.young.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False))), pa.large_binary())
        ids = known.take(chunks.indices)
        _, ends, data = ids.buffers()
        at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [whole[i] if i in whole else bytes(data[a:b]) for i, (a, b) in enumerate(zip(at, at[1:], strict=False))]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, generation: int = 64 << 20) -> ChunkEncoder:
    """One encoder for each tokenizer file in a Python worker, with at least so many bytes for chunks (twice, at most)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, generation)
    _ENCODERS[path].generation = generation
    return _ENCODERS[path]
