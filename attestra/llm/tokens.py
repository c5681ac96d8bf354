"""Token ids of whole texts with a word BPE of the tokenizers library, a chunk of a text at a time.

The tokenizer composes (NFC), lower-cases and splits at white space, and no token crosses white space; so a text's ids
are those of its white-space chunks, one after another. Chunks repeat: each worker keeps the packed ids of those it has
seen. The store is bounded; at `most` chunks it starts anew.

New chunks go through tiktoken with the tokenizer's own merges as ranks, which gives the same ids for a vocabulary whose
every token is what its own characters merge to (tests hold both against each other over the whole vocabulary and over
texts). Chunks with characters that the two treat apart go through tokenizers itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

# str.split() also splits at these four, the tokenizer doesn't
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[" + "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
#: Stands for the end of a word.
_END = chr(0xE000)
#: Control characters, the capital sigma (lower case depends on its neighbours in Python), the private range of _END.
_APART = re.compile("[\x00-\x1f\x7f" + chr(0x3A3) + _END + "-" + chr(0xE03F) + "]|<\\||.{200}")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ChunkIds:
    def __init__(self, path: str, most: int = 400_000):
        self.encoder = Tokenizer.from_file(path)
        self.most = most
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self._ranks(spec["model"]["vocab"], spec["model"]["merges"])

    def _ranks(self, vocab: dict[str, int], merges: list) -> None:
        letters, end = _byte_letters(), _END.encode()
        as_bytes = lambda t: bytes(letters[c] for c in t.removesuffix("</w>")) + end * t.endswith("</w>")
        singles = [t for t in vocab if len(t) == 1]
        ends = [t + "</w>" for t in singles]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        order = [(as_bytes(t), vocab[t]) for t in singles] + [(end[:2], -1), (end, -1)] + [(as_bytes(t), vocab[t]) for t in (*ends, *merged)]
        ranks: dict[bytes, int] = {}
        for k, (b, _) in enumerate(order):
            ranks.setdefault(b, k)
        self.ids = np.array([i for _, i in order], "<i8")
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_END}]*{_END}", mergeable_ranks=ranks, special_tokens={})
        self.newline = vocab[next(c for c, b in letters.items() if b == 10) + "</w>"]

    def _learn(self, chunks: set[str]) -> None:
        apart = [c for c in chunks if _APART.search(c)]
        for chunk, enc in zip(apart, self.encoder.encode_batch(apart, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(enc.ids, "<u4").tobytes()
        if not (plain := list(chunks.difference(apart))):
            return
        text = unicodedata.normalize("NFC", "\n".join(plain)).lower() + "\n"
        found = self.fast.encode_ordinary(_END.join(self.pieces.findall(text)) + _END)
        ids = self.ids[found]
        packed = ids.astype("<u4").tobytes()
        start = 0
        for chunk, at in zip(plain, np.flatnonzero(ids == self.newline).tolist(), strict=True):
            self.known[chunk] = packed[4 * start : 4 * at]
            start = at + 1

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit; null texts are empty."""
        split = [[] if not t else [c for c in _WHITE.split(t) if c] if _SEPARATORS.search(t) else t.split() for t in texts]
        out, start = [], 0
        while start < len(split):
            need: set[str] = set()
            stop = start
            while stop < len(split) and len(need) < self.most // 8:
                need.update(split[stop])
                stop += 1
            new = need - self.known.keys()
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = need
            self._learn(new)
            out += [b"".join(map(self.known.__getitem__, words)) for words in split[start:stop]]
            start = stop
        return out


@lru_cache(2)
def chunk_ids(path: str) -> ChunkIds:
    """One for each worker process and vocabulary."""
    return ChunkIds(path)
