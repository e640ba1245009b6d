"""Whole-text token ids, as little-endian unsigned 32-bit bytes.

The vocabulary's pre-tokenizer cuts a text into words before any merge, so a
text's ids are those of its words, one after another. Texts of plain letters
are cut here by the same rule and each word's ids, given by the tokenizers
library, are kept in a bounded cache; all other texts go to the library whole.
The results are the library's own, several times faster.
"""

from __future__ import annotations

import functools
import os
import re
import struct

import numpy as np

#: The vocabulary's own pre-tokenizer rule, for lower-cased text of ASCII and
#: Latin letters, whose case and composition rules are one to one. Whatever else
#: a text holds ends up in a word of the last kind, where _OTHER finds it.
_WORD = re.compile("[a-zß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-zß-öø-ſ0-9]+")
#: Words that the rule does not hold for, and parts of special tokens.
_OTHER = re.compile("[^!-~à-ÿ×ß-ſ]|<\\|")
#: Stands for such a word; its text goes to the library whole.
_WHOLE = b"whole"


def default_vocab() -> str:
    """The word-level BPE vocabulary of the public_tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCache(dict):
    """Word to ids; words that it lacks read as nothing and are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.new.append(word)
        return b""


def next_empty(ids: list[bytes], start: int) -> int:
    try:
        return ids.index(b"", start)
    except ValueError:
        return -1


class WordEncoder:
    """Encode texts through a bounded word cache.

    ``max_entries`` bounds the cache; beyond it the cache starts anew, which
    changes speed and no result.
    """

    def __init__(self, vocab_path: str, max_entries: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocab_path)
        # The same merges for words that are lower-cased, composed and cut already.
        self.merger = Tokenizer.from_file(vocab_path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.max_entries, self.cache, self.odd = max_entries, WordCache(), False
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _pack(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> None:
        """Encode new words in long lines; a word's last id carries its end."""
        if odd := [w for w in words if _OTHER.search(w)]:
            self.cache.update(dict.fromkeys(odd, _WHOLE))
            self.odd = True
            words = [w for w in words if w not in self.cache]
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.merger.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, a = ids.tobytes(), 0
                for word, b in zip(part, (4 * stops).tolist(), strict=True):
                    self.cache[word] = raw[a:b]
                    a = b
            else:
                self.cache.update((word, self._pack(word)) for word in part)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null counts as empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts, group: int = 16) -> list[bytes]:
        """Ids of each text; new words of ``group`` texts are learned at once."""
        out = []
        for at in range(0, len(texts), group):
            part = texts[at : at + group]
            cut = [_WORD.findall(t.lower()) if t else [] for t in part]
            new = self.cache.new
            found, late = [], []
            for words in cut:
                before = len(new)
                found.append(list(map(self.cache.__getitem__, words)))
                late.append(len(new) > before)
            if new:
                if len(self.cache) + len(new) > self.max_entries:
                    self.cache = WordCache()
                self._learn(list(set(new)))
                self.cache.new.clear()
            get, odd = self.cache.get, self.odd
            for t, words, ids, some in zip(part, cut, found, late, strict=True):
                gap = next_empty(ids, 0) if some else -1
                while gap >= 0:  # the words learned just now
                    ids[gap] = get(words[gap])
                    gap = next_empty(ids, gap + 1)
                out.append(self._pack(t) if odd and _WHOLE in ids else b"".join(ids))
        return out


@functools.lru_cache(maxsize=4)
def encoder(vocab_path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    return WordEncoder(vocab_path)


def as_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
