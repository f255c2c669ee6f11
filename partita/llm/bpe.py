"""Byte-level BPE ids of whole texts, through the tokenizers library, with a bounded memo of chunks.

A text is cut before white space that follows other text. The byte-level pre-tokenizer's pattern always ends a token
there and never looks back, so encoding the chunks one by one gives exactly the ids of the whole text. Each distinct
chunk is encoded by the library once and then looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress
from operator import not_

import numpy as np

from .common import cached

#: White space before which a cut is sure, and characters that pattern engines class differently, at which there is none.
_SURE = " \t\n\r"
_UNSURE = "\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: A run of Latin letters is cut off before what is no letter, too: punctuation then shares the word's entry in the memo.
_chunks = re.compile(
    f"[{_SURE}{_UNSURE}]*+[{_LATIN}]++(?![^\\W\\d_])|[{_SURE}{_UNSURE}]*[^{_SURE}{_UNSURE}]+(?:[{_UNSURE}][{_SURE}{_UNSURE}]*[^{_SURE}{_UNSURE}]*)*|[{_SURE}{_UNSURE}]+"
).findall
#: Such a chunk is one pre-token.
_single = re.compile(f" ?[{_LATIN}]+").fullmatch

#: Chunks held in each of the memo's two generations, and the longest chunk held.
MEMO_CHUNKS = 600_000
MEMO_CHARS = 48


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.plain = Tokenizer(self.tok.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        shown = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        self.table = {b: shown.get(b, 0) or 256 + sum(x not in shown for x in range(b)) for b in range(256)}
        self.blank = chr(self.table[32])
        self.lengths = np.zeros(self.tok.get_vocab_size() + 1, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.lengths[i] = len(token)
        self.limit = memo_chunks
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Chunks that are one pre-token each go to the library's model many at a time, split at line ends only."""
        out: list[bytes] = []
        for k in range(0, len(words), 512):
            some = words[k : k + 512]
            mapped = [w.replace(" ", self.blank) if w.isascii() else w.encode().decode("latin-1").translate(self.table) for w in some]
            ids = array("I", self.plain.encode_batch_fast(["\n".join(mapped)], add_special_tokens=False)[0].ids)
            ends = np.cumsum(self.lengths[ids])
            at = np.searchsorted(ends, np.cumsum(list(map(len, mapped)), dtype=np.int64)) + 1
            cuts, ids = [0, *(4 * at[:-1]).tolist()], ids.tobytes()
            out += map(ids.__getitem__, map(slice, cuts, [*cuts[1:], len(ids)]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_chunks(t) for t in texts]
        new, old = self.new, self.old
        got = [list(map(new.get, c)) for c in cut]
        gaps = [list(compress(range(len(v)), map(not_, v))) for v in got]
        missing = {c[i] for c, g in zip(cut, gaps) for i in g}
        if old:
            new.update((c, old[c]) for c in missing if c in old)
            missing = [c for c in missing if c not in new]
        words = [c for c in missing if _single(c)]
        new.update(zip(words, self._words(words)))
        rest = [c for c in missing if c not in new]
        new.update(zip(rest, self._library(rest)))
        for c, v, g in zip(cut, got, gaps):
            for i in g:
                v[i] = new[c[i]]
        for c in missing:
            if len(c) > MEMO_CHARS:
                del new[c]
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return [b"".join(v) for v in got]


def encoder(path: str, memo_chunks: int = MEMO_CHUNKS) -> ChunkEncoder:
    """This process's encoder for a vocabulary file."""
    return cached(("bpe", path, memo_chunks), lambda: ChunkEncoder(path, memo_chunks))
