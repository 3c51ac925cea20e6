"""Token ids of words through a tokenizer file, each different word encoded once per Python worker."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfpace.llm.arrowtext import ragged

KEPT = 1_000_000  # words remembered by a worker; those not in use are forgotten when there would be more
TOGETHER = 1024  # plain words encoded at once
PLAIN = "^[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+$"
TAIL = ".,;:!?"  # marks split off behind a letter: no pre-tokenizer used here joins a letter to one of them


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, one thread per task because Spark already uses the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of pieces that the tokenizer treats independently of what stands around them.

    ``prefix`` is put before each piece (a space for vocabularies whose words carry it). With ``ends`` the vocabulary
    marks ends of words by that suffix, and plain words are encoded many at a time. Known pieces and their ids are flat
    arrays: all ids one after the other, and where those of each piece begin.
    """

    def __init__(self, path: str, prefix: str = "", ends: str = "", kept: int = KEPT):
        self.tok, self.prefix, self.ends, self.kept = tokenizer(path), prefix, ends, kept
        self.known = pa.array([], pa.string())
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if ends:
            table = self.tok.get_vocab(with_added_tokens=True)
            self.closing = np.zeros(max(table.values()) + 1, bool)
            for token, i in table.items():
                self.closing[i] = token.endswith(ends)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each), piece by piece."""
        found = [e.ids for e in self.tok.encode_batch_fast([self.prefix + p for p in pieces], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of Latin letters: each is one word to the tokenizer and ends with one closing token."""
        parts = []
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            closed = np.flatnonzero(self.closing[ids])
            parts.append((ids, np.diff(closed, prepend=-1)) if len(closed) == len(some) else self.encode(some))
        return np.concatenate([p[0] for p in parts] or [self.ids[:0]]), np.concatenate([p[1] for p in parts] or [self.first[:0]])

    def _learn(self, pieces: pa.Array, used: np.ndarray) -> None:
        """Add pieces; when there would be too many, those not ``used`` now are forgotten first."""
        if len(self.known) + len(pieces) > self.kept:
            size = np.diff(self.first)[used]
            self.ids = self.ids[ragged(self.first[used], size)]
            self.known, self.first = self.known.take(pa.array(used)), np.concatenate(([0], np.cumsum(size)))
        groups = [(pieces, self.encode)]
        if self.ends:
            plain = pc.match_substring_regex(pieces, PLAIN)
            groups = [(pieces.filter(plain), self.encode_plain), (pieces.filter(pc.invert(plain)), self.encode)]
        for some, encode in groups:
            if len(some):
                ids, sizes = encode(some.to_pylist())
                self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
                self.ids = np.concatenate((self.ids, ids))
                self.known = pa.concat_arrays([self.known, some])

    def _places(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of distinct pieces; unknown ones are encoded."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count:
            self._learn(pieces.filter(pc.is_null(at)), pc.unique(at.drop_null()).to_numpy(zero_copy_only=False))
            at = pc.index_in(pieces, value_set=self.known)
        at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        return self.first[at], self.first[at + 1] - self.first[at]

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        words = words.cast(pa.string())
        stems = pc.utf8_rtrim(words, characters=TAIL)
        stems = pc.if_else(pc.match_substring_regex(stems, r"\p{L}$"), stems, words)
        coded = stems.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        first, size = (x[which] for x in self._places(coded.dictionary))
        cut = np.flatnonzero(pc.not_equal(stems, words).to_numpy(zero_copy_only=False))
        lengths = size.copy()
        if not len(cut):
            return self.ids[ragged(first, size)], lengths
        stem_size = pc.binary_length(stems).to_numpy(zero_copy_only=False)[cut]
        ends = [w[n:] for w, n in zip(words.take(pa.array(cut)).cast(pa.binary()).to_pylist(), stem_size.tolist(), strict=True)]
        kinds = {t: k for k, t in enumerate(dict.fromkeys(ends))}
        tail_ids = [np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for t in kinds]
        kind = np.array([kinds[t] for t in ends])
        tail_size = np.array([len(t) for t in tail_ids])
        lengths[cut] += tail_size[kind]
        out = np.empty(int(lengths.sum()), np.uint32)
        start = np.cumsum(lengths) - lengths
        out[ragged(start, size)] = self.ids[ragged(first, size)]
        flat, tail_first = np.concatenate(tail_ids), np.cumsum(tail_size) - tail_size
        out[ragged(start[cut] + size[cut], tail_size[kind])] = flat[ragged(tail_first[kind], tail_size[kind])]
        return out, lengths


@lru_cache(maxsize=4)
def word_ids(path: str, prefix: str = "", ends: str = "") -> WordIds:
    """The worker's own ``WordIds``, kept from task to task."""
    return WordIds(path, prefix, ends)
