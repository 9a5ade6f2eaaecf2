"""Word splitting and cached word encoding with a public BPE vocabulary file.

The vocabulary splits a text into words that are encoded independently, so the ids
of a text are the ids of its words in order. The splitter below reproduces the
file's normaliser and splitter for Latin texts; every other text goes through the
tokenizers library itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Characters below this are left unchanged by composition and have stable classes.
_LATIN_END = 0x250
#: Words in each of a worker's two cache generations.
CACHE_WORDS = 400_000
#: Words that go to the library as one text.
LINE = 300


def default_vocabulary() -> str:
    """Path of the vocabulary file that the queries use by default."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _class(kind: str) -> str:
    chars = [chr(c) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == kind]
    return "".join(re.escape(c) for c in chars)


def _fast_patterns() -> tuple[re.Pattern, re.Pattern]:
    letters, numbers = _class("L"), _class("N")
    split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
    plain = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-ɏ]*")
    return split, plain


class WordSplitter:
    """Texts to the words that the vocabulary file encodes one by one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._split, self._plain = _fast_patterns()
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def words(self, text: str) -> list[str]:
        """The words in order; a special token's own string stands for that token."""
        if not text:
            return []
        if self._added is not None and "<|" in text and self._added.search(text):
            out: list[str] = []
            at = 0
            for m in self._added.finditer(text):
                out += self._words(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._words(text[at:])
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self._plain.fullmatch(text):
            return self._split.findall(text.lower())
        return self._slow(text)

    def _slow(self, text: str) -> list[str]:
        """By the library's own normaliser and splitter; words come from the normalised text."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self._pre(normal)]

    def _pre(self, normal: str):
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)


class WordEncoder(WordSplitter):
    """Encodes words through a bounded cache; a word is sent to the library once while cached."""

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self._ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)]) if suffix else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word.

        Plain words go to the library joined by spaces, LINE at a time: it splits them
        again, and every word's last piece carries the vocabulary's word-end mark. Where
        the ends don't add up, and for all other words, each word goes by itself.
        """
        out: list[bytes | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w not in self.added and self._plain.fullmatch(w)] if self._ends is not None else []
        lines = [plain[lo : lo + LINE] for lo in range(0, len(plain), LINE)]
        found = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in line]) for line in lines], add_special_tokens=False) if lines else []
        size = self.dtype.itemsize
        for line, e in zip(lines, found, strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = (np.flatnonzero(self._ends[ids]) + 1) * size
            if len(ends) == len(line) and ends[-1] == ids.nbytes:
                raw, lo = ids.tobytes(), 0
                for i, hi in zip(line, ends.tolist(), strict=True):
                    out[i] = raw[lo:hi]
                    lo = hi
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out

    def _fill(self, words: set[str]) -> None:
        """Have all words in the cache; when it is full it becomes the older generation,
        out of which words that are met again move back without being encoded again."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.older, self.cache, new = self.cache, {}, words
        known = new.intersection(self.older)
        older, cache = self.older, self.cache
        for w in known:
            cache[w] = older[w]
        rest = list(new.difference(known))
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            cache.update(zip(part, self.encode_words(part), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts (null: none) as little-endian integers of ``dtype``."""
        split = [self.words(t) if t else [] for t in texts]
        self._fill(set().union(*split))
        get = self.cache.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The process's encoder for a vocabulary file: workers are reused between tasks."""
    return WordEncoder(path)
