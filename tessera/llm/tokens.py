"""Token ids of whole texts with a word-level BPE vocabulary, at the speed of a word cache."""

from __future__ import annotations

import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
_CACHE_LIMIT = 450_000
_LONGEST = 64  # longer words are not kept

# Characters for which lower-casing, NFC and the letter, digit and white-space classes are the same in every library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Word -> ids; notes the words it lacks.  Once full, it keeps of its words those that are met again."""

    def __init__(self):
        super().__init__()
        self.missing: list[str] = []
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes | None:
        code = self.old.get(word)
        if code is None:
            self.missing.append(word)
        else:
            self[word] = code
        return code

    def age(self) -> None:
        if len(self) > _CACHE_LIMIT:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Encodes texts exactly as the tokenizer file does (no special tokens added).

    Words are split and looked up in a cache filled by the tokenizer itself; a text with characters outside `_PLAIN`, or with the mark of a
    special token, is given to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Cache()
        vocabulary = self.tokenizer.get_vocab()
        self.raw = [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        probe = ["a", "the", "tokens", "qzxjkvw"]  # whether the tokenizer leaves plain words to its model as they are
        self.alone = all([x.id for x in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        """Encodes new words: plain ones, which the tokenizer neither changes nor splits, by its model alone, others in one go; the last id of each
        word is one that ends words."""
        model, raw = self.tokenizer.model.tokenize, self.raw
        plain = [word for word in words if self.alone and word.isascii() and word.isalpha()]
        for word in plain:
            self.cache[word] = b"".join([raw[x.id] for x in model(word)])
        if len(plain) == len(words):
            return
        words = [word for word in words if word not in self.cache]
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            codes = (np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))
            self.cache.update(zip(words, codes))
            return
        raw, begin = ids.tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist()):
            self.cache[word] = raw[begin:stop]
            begin = stop

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cache, get = self.cache, self.cache.__getitem__
        cache.age()
        found: list = []
        for text in texts:
            if "<|" in text or not _PLAIN.fullmatch(text):
                found.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
                continue
            words = _PIECES.findall(text.lower())
            codes = list(map(get, words))
            found.append((words, codes) if None in codes else b"".join(codes))
        wanted = list(dict.fromkeys(cache.missing))
        cache.missing.clear()
        for at in range(0, len(wanted), 5_000):
            self._learn(wanted[at : at + 5_000])
        for i, x in enumerate(found):
            if not isinstance(x, bytes):
                words, codes = x
                at = -1
                for _ in range(codes.count(None)):
                    at = codes.index(None, at + 1)
                    codes[at] = cache[words[at]]
                found[i] = b"".join(codes)
        for word in wanted:
            if len(word) > _LONGEST:
                del cache[word]
        return found


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process: its word cache stays warm from one task of a worker to the next."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
