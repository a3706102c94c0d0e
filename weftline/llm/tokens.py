"""Byte-level BPE ids by the ``tokenizers`` library, with a word cache in front of it.

The pre-tokenizer never joins a non-space character with a space or newline that follows it,
so a text may be cut there and its pieces encoded apart. Invented and natural prose repeats
most pieces, which then cost one lookup a batch. Texts with other white space, or with an
added token's string, go to the library whole; so the ids always equal the library's own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than space and newline, as any Unicode version or library may define it.
_ODD_SPACE = re.compile("[^\\S \\n]|[\u180e\u200b\ufeff]")
#: A Latin word and one mark after it.
_MARKED = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,;:!?]").fullmatch
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_LOADED: dict[tuple[str, int], WordCachedTokenizer] = {}


class WordCachedTokenizer:
    """Encodes texts to uint32 ids. At most ``limit`` pieces are remembered, then all are forgotten."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.cache: dict[str, bytes | None] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True  # how byte-level tokens write a space
        self.newline = newline[0] if len(newline) == 1 else None
        self.cuts = self.newline is not None and not any(re.search(r"\s", t) for t in self.added) and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[str]) -> None:
        """Add keys to the cache. ``U+DC00`` before a key stands for no space before it, ``\\n`` for a newline,
        anything else for a space. None marks a key whose text must not be cut there."""
        cache, plain, later = self.cache, [], []
        joined = "\n".join(keys)
        odd = _ODD_SPACE.search(joined.replace("\udc00", "")) or any(t in joined for t in self.added)
        for k in keys:
            if k in ("", "\n", "\udc00") or odd and (_ODD_SPACE.search(k.lstrip("\udc00")) or any(t in k for t in self.added)):
                cache[k] = None
            elif _MARKED(k):
                stem = k[:-1]
                later.append((k, stem))
                if stem not in cache:
                    plain.append(stem)
            else:
                plain.append(k)
        plain = list(dict.fromkeys(plain))
        spaced = [k for k in plain if k[0] not in "\udc00\n"]
        # One call for many: the only spaces are those before them, so each begins with the one token that begins with a space.
        for at in range(0, len(spaced), 400):
            part = spaced[at : at + 400]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(self.spaced[ids]) * 4).tolist()
            cache.update(zip(part, [raw[x:y] for x, y in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))
        # The others begin a text or a line: each is put on a line of its own, whose newline is one token.
        rest = [k for k in plain if k[0] in "\udc00\n"]
        if any("\n" in k[1:] or k[1] == " " for k in rest):  # not from pieces but from runs
            cache.update(zip(rest, self._whole([k.lstrip("\udc00") for k in rest]), strict=True))
            return self._join(later)
        for at in range(0, len(rest), 400):
            part = rest[at : at + 400]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(["\n" + k[1:] for k in part])], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.newline) * 4).tolist()
            cache.update(zip(part, [raw[x if k[0] == "\n" else x + 4 : y] for k, x, y in zip(part, cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))
        self._join(later)

    def _join(self, later: list[tuple[str, str]]) -> None:
        """Add words with a mark to the cache, once their stems are there."""
        cache = self.cache
        if later:
            marks = ["\udc00" + m for m in ".,;:!?"]
            self._learn([m for m in marks if m not in cache])
            for k, stem in later:
                cache[k] = cache[stem] + cache["\udc00" + k[-1]]

    def _cut(self, text: str) -> bytes | None:
        """Ids of a text with runs of spaces and newlines; None if it holds what must not be cut."""
        cache, keys = self.cache, ["\udc00" + p for p in _RUNS.findall(text)]
        self._learn([k for k in dict.fromkeys(keys) if k not in cache])
        try:
            return b"".join(map(cache.__getitem__, keys))
        except TypeError:
            return None

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        """For each text its ids as little-endian uint32 bytes; null has none.

        The distinct pieces of all the texts are looked up once each, then their ids are gathered
        for all places at a time.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cuts:
            return self._whole(["" if t is None else t for t in column.to_pylist()])
        if not len(column):
            return []
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        pieces = pc.split_pattern(pc.replace_substring(column.fill_null(""), "\n", " \n"), " ")
        ends = pieces.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = pieces.flatten().dictionary_encode()
        codes, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # the first piece of a text has no space before it
        firsts, which = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(keys) + which
        keys += ["\udc00" + keys[k] for k in firsts.tolist()]
        found = list(map(cache.get, keys))
        missing = [k for k, ids in zip(keys, found, strict=True) if ids is None and k not in cache]
        if missing:
            self._learn(missing)
            found = list(map(cache.get, keys))
        uncut = np.array([ids is None for ids in found])
        found = [b"" if ids is None else ids for ids in found]
        table, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        n = lengths[codes]
        to = np.cumsum(n)
        raw = table[np.repeat(begins[codes] - to + n, n) + np.arange(to[-1])].tobytes()
        bounds = np.concatenate(([0], to * 4))[ends].tolist()
        out = [raw[x:y] for x, y in zip(bounds, bounds[1:])]
        if uncut.any():
            empty = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) == 0
            for i in np.flatnonzero(np.logical_or.reduceat(uncut[codes], ends[:-1]) & ~empty).tolist():
                text = column[i].as_py()
                ids = self._cut(text)
                out[i] = self._whole([text])[0] if ids is None else ids
        return out


def tokenizer(path: str, limit: int = 1_000_000) -> WordCachedTokenizer:
    """One tokenizer a worker process and file."""
    key = (path, limit)
    if key not in _LOADED:
        _LOADED[key] = WordCachedTokenizer(path, limit)
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
