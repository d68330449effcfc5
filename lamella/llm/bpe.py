"""Byte-level BPE ids of whole texts, many texts at a time.

The pre-tokens of a byte-level tokenizer (contractions, runs of letters, digits or other signs with one leading space, white
space) tile the text, so they are found from character classes with array operations, told apart by Arrow's dictionary
encoding, and only pre-tokens not met before go through the merges. Ids equal those of ``tokenizers`` with
``add_special_tokens=False``. Texts outside the plain case (characters whose class may differ between Unicode versions, a
special token's string) are encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import resident

#: Characters beyond this one go the general way.
_PLAIN = 0x0590
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
#: Pre-tokens that a process remembers (more only if texts given at a time have more), and the bytes of text that it should be given at a time.
_KNOWN_MOST = 250_000
SLICE_BYTES = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    return resident(f"bpe {path}", lambda: Encoder(path))


def _classes() -> np.ndarray:
    table = np.full(_PLAIN, _OTHER, np.int8)
    for c in range(_PLAIN):
        kind = unicodedata.category(chr(c))[0]
        table[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    table[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return table


def _merger(path: str, special: list[str]):
    """The same merges in ``tiktoken``, which is many times faster on single pre-tokens; None if ids aren't in merge order."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
    ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = _merger(path, self.special)
        self.table = _classes()
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(1 << 20, np.int32)
        self.offsets = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _learn(self, tokens: list[bytes]) -> None:
        if self.merger:
            found = [self.merger.encode_ordinary(t.decode()) for t in tokens]
        else:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)]
        flat = np.fromiter((i for x in found for i in x), np.int32)
        n = len(self.known)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.empty(max(len(flat), len(self.ids)), np.int32)))
        if n + len(found) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets[: n + 1], np.zeros(max(len(found) + 1, len(self.offsets)), np.int64)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.offsets[n] = self.used
        self.offsets[n + 1 : n + 1 + len(found)] = self.used + np.cumsum([len(x) for x in found])
        self.used += len(flat)
        self.known.update(zip(tokens, range(n, n + len(found)), strict=True))

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``first`` has the places where texts begin."""
        kind = self.table[points]
        n = len(kind)
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[first] = True
        run = np.flatnonzero(begins)
        after = np.append(run[1:], n)
        # the last blank before something joins it if it is a space, else it stands alone; the rest of the run is one
        blank = (kind[run] == _SPACE) & (after < n)
        head = np.zeros(n + 1, bool)
        head[first] = True
        blank &= ~head[after]
        last = after[blank] - 1
        begins[last] = True
        joined = last[points[last] == 32]
        begins[joined + 1] = False
        # contractions: only where a quote begins a pre-token
        quote = np.flatnonzero((points == 39) & begins)
        if len(quote):
            padded = np.append(points, np.zeros(2, points.dtype))
            ends = np.zeros(n + 1, np.int64)
            ends[:n] = np.cumsum(head[:n])
            one, two = padded[quote + 1], padded[quote + 2]
            here = np.append(ends[:n], [-1, -1])
            same1, same2 = here[quote + 1] == here[quote], here[quote + 2] == here[quote]
            short = same1 & np.isin(one, [ord(c) for c in "stmd"])
            long = same1 & same2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for at, width in ((quote[short], 2), (quote[long & ~short], 3)):
                for k in range(1, width):
                    begins[at + k] = False
                nxt = at + width
                nxt = nxt[nxt < n]
                begins[nxt[~head[nxt] & (kind[nxt] == _LETTER)]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one entry more than texts). A null text has none."""
        plain, odd = [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            s = text.decode("utf-8", "replace")
            if (not s.isascii() and max(s) >= chr(_PLAIN)) or any(x in s for x in self.special):
                odd[i] = np.asarray(self.tokenizer.encode(s, add_special_tokens=False).ids, np.int32)
            else:
                plain.append((i, s, text))
        counts = np.zeros(len(texts), np.int64)
        flat = np.empty(0, np.int32)
        if plain:
            raw = b"".join(t for _, _, t in plain)
            points = np.frombuffer("".join(s for _, s, _ in plain).encode("utf-32-le"), np.uint32)
            sizes = np.fromiter((len(s) for _, s, _ in plain), np.int64, len(plain))
            first = np.cumsum(sizes) - sizes
            at = self._starts(points, first)
            width = np.ones(len(points) + 1, np.int64)
            width[1:] += points >= 0x80
            width[0] = 0
            offsets = np.append(np.cumsum(width)[at], len(raw)).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
            names = tokens.dictionary.to_pylist()
            if fresh := [x for x in names if x not in self.known]:
                if len(self.known) + len(fresh) > _KNOWN_MOST:  # forgets before all of these texts' are learnt, never between
                    self.known.clear()
                    self.used = 0
                    fresh = names
                self._learn(fresh)
            code = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[tokens.indices.to_numpy(zero_copy_only=False)]
            begin, size = self.offsets[code], self.offsets[code + 1] - self.offsets[code]
            total = np.cumsum(size)
            flat = self.ids[np.repeat(begin - (total - size), size) + np.arange(total[-1])]
            ends = np.append(np.searchsorted(at, first)[1:], len(at))
            cum = np.concatenate(([0], total))[ends]
            counts[[i for i, _, _ in plain]] = np.diff(cum, prepend=0)
        for i, ids in odd.items():
            counts[i] = len(ids)
        starts = np.concatenate(([0], np.cumsum(counts)))
        if odd:
            out = np.empty(starts[-1], np.int32)
            normal = np.ones(len(out), bool)
            for i, ids in odd.items():
                out[starts[i] : starts[i + 1]] = ids
                normal[starts[i] : starts[i + 1]] = False
            out[normal] = flat
            flat = out
        return flat, starts
