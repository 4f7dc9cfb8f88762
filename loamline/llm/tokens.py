"""Exact token ids of whole texts by a public tokenizer, a white-space chunk at a time.

The tokenizer's pre-tokenizer never joins characters across white space and
drops the white space itself, so a text's ids are its chunks' ids in order; nor
does it join letters and punctuation, and it lower-cases. So a chunk of letters
with ASCII punctuation behind it is the word and the punctuation, either in
order, unless the word's lower case ends in a mark, which may join what follows.
Most words repeat: each task encodes a distinct word once.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np

#: Distinct chunks a task remembers before it starts anew.
MEMORY = 400_000
#: Longer chunks are encoded each time.
LONG = 64
#: Of Latin-1 bytes: letters and digits, the marks that are set apart, a space, and all else.
_KIND = bytes(ord("s" if i == 32 else "m" if i in b",." else "a" if chr(i) in string.digits or chr(i).isalpha() and chr(i) not in "ªºµ" else "x") for i in range(256))
#: Characters that are split up at a time, words that are encoded as one string, and strings in one call.
AT_ONCE, WORDS, CALL = 1 << 20, 512, 128


class ChunkEncoder:
    """ids as little-endian unsigned 32-bit bytes. path: a tokenizers JSON file of the kind described above, with an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case words of Latin-1 letters, which neither its normalizer nor its pattern changes or parts: white space alone.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, chunks: list[str], tokenizer=None) -> list[bytes]:
        tokenizer = tokenizer or self.tokenizer
        return [np.asarray(e.ids, "<u4").tobytes() for at in range(0, len(chunks), CALL) for e in tokenizer.encode_batch_fast(chunks[at : at + CALL], add_special_tokens=False)]

    def _words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of words of letters alone, many to a call; the end-of-word tokens tell them apart."""
        latin, others = [], []
        for w in words:
            (latin if w.isascii() or max(w) <= "ÿ" else others).append(w)
        for some, tokenizer in ((latin, self.plain), (others, self.tokenizer)):
            parts = [some[at : at + WORDS] for at in range(0, len(some), WORDS)]
            for part, found in zip(parts, self._encode([" ".join(p) for p in parts], tokenizer)):
                ids = np.frombuffer(found, "<u4")
                ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(ends) != len(part):
                    yield from zip(part, self._encode(part))
                else:
                    yield from zip(part, [found[lo:hi] for lo, hi in zip([0, *ends], ends)])

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Enter what is new into the memory; what is too long for it is returned."""
        known, words, whole, parts = self.known, {}, [], []
        marks, long = string.punctuation, LONG
        for c in chunks:
            if len(c) > long:
                whole.append(c)
            elif c.isalpha() and c.islower():
                words[c] = None
            else:
                word = c.rstrip(marks)
                low = word.lower()
                if word.isalpha() and low[-1].isalpha():
                    tail = c[len(word) :]
                    if low != word and max(word) <= "ÿ":
                        word = low
                    parts.append((c, word, tail))
                    if word not in known:
                        words[word] = None
                    if tail and tail not in known:
                        whole.append(tail)
                else:
                    whole.append(c)
        known.update(self._words(words))
        whole = list(dict.fromkeys(whole))
        rest = dict(zip(whole, self._encode(whole)))
        known.update((c, ids) for c, ids in rest.items() if len(c) <= LONG)
        known[""] = b""
        known.update((c, known[word] + known[tail]) for c, word, tail in parts)
        return {c: ids for c, ids in rest.items() if len(c) > LONG}

    @staticmethod
    def _chunks(text: str) -> list[str]:
        """At white space that every part of the tokenizer counts as such. In lower case if that is certain to be the tokenizer's: in Latin-1, and where it can't make a special token. There a comma or full stop at a word's end is a chunk of its own, if all that come before white space stand behind a letter or digit, as the tokenizer parts them."""
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" in text:
            return spaced.split(" ")
        try:
            spaced.encode("latin-1")
        except UnicodeEncodeError:
            return spaced.split(" ")
        spaced = spaced.lower()
        kinds = spaced.encode("latin-1").translate(_KIND)
        if b"xms" not in kinds and b"mms" not in kinds:
            spaced = spaced.replace(", ", " , ").replace(". ", " . ")
        return spaced.split(" ")

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size + len(texts[at]) <= AT_ONCE):
                split.append(self._chunks(texts[at]))
                size += len(texts[at])
                at += 1
            known = self.known
            if len(known) > MEMORY:
                known.clear()
            new = set().union(*split).difference(known)
            extra = self._learn(new) if new else {}
            for chunks in split:
                yield b"".join([known[c] if c in known else extra[c] for c in chunks] if extra else map(known.__getitem__, chunks))
