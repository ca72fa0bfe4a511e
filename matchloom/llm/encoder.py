"""Byte-level BPE ids of whole texts with the tokenizers library, a word at a time where that is the same."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Words remembered in a worker, for all its tasks; others are encoded once a batch.
REMEMBER = 800_000
#: A space before white space or the end is not always the start of a pre-token.
UNSAFE = re.compile(r" (?:\s|\Z)")


class WordEncoder:
    """encode(texts) -> for each text its ids as little-endian uint32 bytes, as Tokenizer.encode gives them without
    special tokens.

    The pre-tokenizer of a byte-level BPE starts a new pre-token at every space that text follows, so the ids of a text
    are those of its space-separated words, each with its space. The library encodes each distinct word once; texts
    with double or trailing spaces it encodes whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.library.get_vocab_size()
        self.starts = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.words: dict[str, bytes] = {}
        self.marks = {m: self._whole(m) for m in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spaced(self, words: list[str], step: int = 500) -> dict[str, bytes]:
        """Ids of each word with a space before it."""
        out = {}
        chunks = [words[i : i + step] for i in range(0, len(words), step)]
        done = self.library.encode_batch_fast(["".join([f" {w}" for w in chunk]) for chunk in chunks], add_special_tokens=False)
        for chunk, encoding in zip(chunks, done):
            ids = np.array(encoding.ids, "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(chunk) and at[0] == 0:
                raw, ends = ids.tobytes(), [*(at[1:] * 4).tolist(), len(ids) * 4]
                out.update(zip(chunk, [raw[a:b] for a, b in zip([0, *ends], ends)]))
            else:  # a word with a space of another kind inside
                out.update((w, self._whole(f" {w}")) for w in chunk)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 4_000_000:
                out += self._some(held)
                held, size = [], 0
        return out + self._some(held)

    def _some(self, texts: list[str]) -> list[bytes]:
        get = self.words.get
        split = [None if not t or UNSAFE.search(t) else t.split(" ") for t in texts]
        first = [x and x.pop(0) for x in split]
        found = [x and list(map(get, x)) for x in split]
        gaps = [[k for k, i in enumerate(ids) if i is None] if ids else () for ids in found]
        lacking = {x[k] for x, at in zip(split, gaps) for k in at}
        # " word." is " word" and "." where word has letters only
        bases = {w: w[:-1] for w in lacking if w[-1:] in self.marks and w[:-1].isalpha()}
        new = self._spaced(list((lacking - bases.keys()).union(b for b in bases.values() if b not in self.words)))
        if len(self.words) < REMEMBER:
            self.words.update(new)
        for w, base in bases.items():
            new[w] = (get(base) or new[base]) + self.marks[w[-1]]
        out = []
        for text, one, x, ids, at in zip(texts, first, split, found, gaps):
            if x is None:
                out.append(self._whole(text) if text else b"")
            else:
                for k in at:
                    ids[k] = new[x[k]]
                out.append((self._whole(one) if one else b"") + b"".join(ids))
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One a worker and file."""
    return WordEncoder(path)
