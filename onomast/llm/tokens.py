"""Encoding of whole columns of texts with the tokenizers library.

The library spends most of its time on strings, not on merges, and most words
come again.  So texts are cut at single spaces, where the tokenizers used here
never join, and each distinct unit is encoded once per worker; a text for which
the cut isn't certain goes to the library whole.
"""

from __future__ import annotations

import gc
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bound on remembered units of a worker, some 250 bytes each; beyond it units are encoded anew.
CACHE = 700_000
# How the tokenizers of either kind cut a text into pieces.
SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BARE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class Encoder:
    """kind "spaced": byte-level BPE whose pieces may begin with a space.
    kind "bare": pieces never hold white space; words are normalised and lower-cased."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.spaced = kind == "spaced"
        self.cut = SPACED if self.spaced else BARE
        self.units: dict[str, bytes] = {}
        self.chars = str.maketrans({chr(b): c for b, c in _byte_chars().items()})
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in 16 bits")

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        if (path, kind) not in _ENCODERS:
            gc.freeze()
            _ENCODERS[path, kind] = cls(path, kind)
        return _ENCODERS[path, kind]

    def whole(self, text: str) -> bytes:
        return array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(self.units) < CACHE:
            self.units[text] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """What the tokenizer's own cutting leaves whole.  Pieces are remembered, not the words with commas and line ends that they make up."""
        found = self.units.get(piece)
        if found is None:
            mapped = piece.encode().decode("latin1").translate(self.chars)
            found = self._keep(piece, array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes())
        return found

    def unit(self, word: str, lead: str) -> bytes:
        """A word and what stands before it ('' or ' '); in the Latin blocks the
        library's own cutting is done here, as all versions of Unicode agree on these."""
        found = self.units.get(lead + word)
        if found is not None:
            return found
        if not word or max(word) >= "ƀ" or "İ" in word:
            return self._keep(lead + word, self.whole(lead + word))
        if not self.spaced:
            word = unicodedata.normalize("NFC", word).lower()
        core, tail = (word[:-1], word[-1]) if word[-1] in ",.:;" else (word, "")
        if core.isalpha():
            return self._piece(lead + core) + (self._piece(tail) if tail else b"")
        return b"".join(map(self._piece, self.cut.findall(lead + word)))

    def _unsure(self, texts: pa.Array) -> np.ndarray:
        """Texts that go to the library whole: special tokens are written out, or (spaced) spaces follow each other or end it."""
        bad = pc.match_substring(texts, "<|")
        if self.spaced:
            bad = pc.or_(bad, pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " ")))
        return bad.to_numpy(zero_copy_only=False).astype(bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint16, one text after the other, and where each text begins, with the end last.  Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        unsure = self._unsure(texts)
        held = np.flatnonzero(unsure)
        if len(held):
            whole = {i: self.whole(texts[i].as_py()) for i in held.tolist()}
            texts = pc.if_else(pa.array(unsure), "", texts)
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        lead = " " if self.spaced else ""
        known = [self.unit(w, lead) for w in words]
        if self.spaced:  # the first word of a text has no space before it
            firsts = index[at[:-1]]
            index[at[:-1]] = len(known) + np.arange(n)
            known += [self.unit(words[j], "") for j in firsts.tolist()]
        if len(held):
            index[at[held]] = len(known) + np.arange(len(held))
            known += [whole[i] for i in held.tolist()]
        # 32 bits do: a call holds no more than some megabytes of text, or one text.
        size = np.fromiter(map(len, known), np.int64, len(known)) // 2
        flat = np.frombuffer(b"".join(known), "<u2")
        del known
        length = size[index]
        done = np.cumsum(length)
        total = int(done[-1]) if len(done) else 0
        wide = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        source = np.repeat(((np.cumsum(size) - size)[index] - (done - length)).astype(wide), length)
        source += np.arange(total, dtype=wide)
        return flat[source], np.concatenate([[0], done[at[1:] - 1]])


def slices(batch: pa.RecordBatch, size: int = 6_000_000):
    """Parts of a batch of about ``size`` bytes of text, the last column; a row is never cut."""
    text = batch.column(batch.num_columns - 1)
    n = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end
