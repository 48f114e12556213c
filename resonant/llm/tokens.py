"""Ids of the public word-piece BPE, fast for Latin-1 texts.

The tokenizer normalises (NFC, white space to a space, lower case), splits into
runs of letters, single digits, contractions and runs of other characters, and
encodes each split on its own. For a text within Latin-1 these steps need no
normaliser: lower-casing maps characters one to one and NFC changes nothing. The
splits of many such texts are found at once on their bytes, told apart by a hash,
and only splits that are new are encoded. Every other text goes through the
tokenizer as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

EOS = 2

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


def _kind(byte: int) -> int:
    if byte in (0x20, 0x85, 0xA0) or 0x09 <= byte <= 0x0D:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(byte))[0], _OTHER)


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def find_splits(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the splits of lower-cased Latin-1 bytes."""
    kind = _KINDS[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    solid = kind[starts] != _SPACE
    starts, ends = starts[solid], ends[solid]
    # an apostrophe alone takes the first letters after it if they make a contraction
    alone = np.flatnonzero((raw[starts] == 0x27) & (ends - starts == 1))
    alone = alone[alone + 1 < len(starts)]
    alone = alone[starts[alone + 1] == ends[alone]]
    if len(alone):
        one = raw[ends[alone]]
        two = np.append(raw, 0)[ends[alone] + 1]
        take = np.isin(one, list(b"stmd")).astype(int)
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        take[pair] = 2
        starts, ends = starts.copy(), ends.copy()
        ends[alone] += take
        starts[alone + 1] += take
        left = starts < ends
        starts, ends = starts[left], ends[left]
    return starts, ends


class WordBpe:
    """encode_batch(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    The ids of splits met are kept, up to most_kept.
    """

    def __init__(self, path: str, most_kept: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.kept: dict[bytes, bytes] = {}
        self.most_kept = most_kept

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, splits: list[bytes]) -> None:
        """Ids of splits in one call: each ends at an id with a word end."""
        texts = [s.decode("latin-1") for s in splits]
        (whole,) = self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)
        ids = np.asarray(whole.ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(splits) or stops[-1] != len(ids):
            self.kept.update((s, self._whole(t)) for s, t in zip(splits, texts))
            return
        raw = ids.tobytes()
        self.kept.update(zip(splits, map(lambda a, b: raw[4 * a : 4 * b], [0, *stops[:-1]], stops)))

    def _ids(self, splits: list[bytes]) -> list[bytes]:
        if len(self.kept) > self.most_kept:
            self.kept = {s: self.kept[s] for s in splits if s in self.kept}
        new = [s for s in splits if s not in self.kept]
        for lo in range(0, len(new), 20_000):
            self._learn(new[lo : lo + 20_000])
        return list(map(self.kept.__getitem__, splits))

    def _encode_plain(self, parts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        joined = b"\n".join(parts)
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = find_splits(raw)
        if not len(starts):
            return [b""] * len(parts)
        up, down = _powers(max(1 << 16, 1 << len(raw).bit_length()))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        hashes = (total[ends] - total[starts]) * down[starts]
        hashes ^= hashes >> np.uint64(31)
        hashes += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids = self._ids([joined[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.array([len(x) for x in ids]) // 4
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        each = sizes[which]
        after = np.cumsum(each)
        place = np.arange(after[-1]) + np.repeat(begins[which] - (after - each), each)
        out = flat[place].tobytes()
        stops = np.cumsum([len(p) + 1 for p in parts])  # where the next text begins
        upto = np.concatenate([[0], after])[np.searchsorted(starts, stops)]
        return [out[4 * a : 4 * b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        out: list = [None] * len(texts)
        plain: dict[int, bytes] = {}
        for i, t in enumerate(texts):
            try:
                if "<|" in t and self.special.search(t):
                    raise ValueError
                plain[i] = t.lower().encode("latin-1")
            except ValueError:  # of which a UnicodeEncodeError is one
                out[i] = self._whole(t)
        if plain:
            for i, ids in zip(plain, self._encode_plain(list(plain.values()))):
                out[i] = ids
        return out


@lru_cache(maxsize=2)
def shared_bpe(path: str) -> WordBpe:
    """One tokenizer for each Python worker, so that later tasks find its table filled."""
    return WordBpe(path)
