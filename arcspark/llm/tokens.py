"""Token ids by a public tokenizer, word by word, with a bounded cache.

A vocabulary whose file has the settings in ``SETTINGS`` never joins characters across ASCII
white space, ignores it and the case of letters, and splits punctuation that ends a word from
the letter or digit before it. So the ids of a text are those of its lower-cased
white-space-separated words, one after the other, and those of a word are those of its core
and of its last punctuation. The distinct words of a slice are cut by Arrow; the cache holds
cores and punctuation only, and each is encoded once per worker while it is there.
A core of Latin-1 letters alone is one word to such a vocabulary and is in normal form
once it is in lower case, so it goes to the byte-pair model without the normaliser and the splitter,
many at once and told apart by the suffix that ends a word's last token. Texts for any other
vocabulary are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from arcspark.llm.common import _CACHES, claim

#: Words in each of the two generations of the cache.
CACHE_WORDS = 400_000
TOKENIZER = "word_bpe_49k.json"
_ASCII_CORE = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))
#: The normaliser and splitter (as in the vocabulary file) that the above holds for.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
#: UTF-8 of lower-case ASCII letters and of Latin-1 letters.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++")
#: The second bytes of capital Latin-1 letters, to those of small ones.
_SMALL = bytes.maketrans(bytes(range(0x80, 0x9F)), bytes(range(0xA0, 0xBF)))
#: How byte-level vocabularies write the bytes that don't print: in order, from 256 on.
_BYTES = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Those of them in small Latin-1 letters.
_HIDDEN = [(chr(b), chr(_BYTES[b])) for b in (0x9F, 0xA0, 0xAD)]
_AT_ONCE, SLICE_BYTES = 500, 4 << 20


def _cut(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Which words end in ASCII punctuation after a letter or digit; all words without it, and that of these words."""
    trimmed = pc.ascii_rtrim(words, string.punctuation)
    sizes, kept = pc.binary_length(words).to_numpy(), pc.binary_length(trimmed).to_numpy()
    cut = (kept < sizes) & (kept > 0)
    _, ends, held = trimmed.buffers()
    data, ends = np.frombuffer(held or b"", np.uint8), np.frombuffer(ends, np.int32)[trimmed.offset + 1 :][: len(trimmed)]
    last = np.zeros(len(trimmed), np.uint8)
    last[cut] = data[ends[cut] - 1]
    cut &= _ASCII_CORE[last] | (last > 127)
    if (last[cut] > 127).any():
        open_ = np.flatnonzero(cut & (last > 127))
        cut[open_] = [x.decode("utf-8", "replace").lower()[-1].isalpha() for x in _listed(trimmed.take(pa.array(open_)))]
    cut &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
    where = pa.array(cut)
    return cut, pc.if_else(where, trimmed, words), _from(words.filter(where), kept[cut])


def _from(words: pa.Array, start: np.ndarray) -> pa.Array:
    """Each word from byte ``start`` of it on."""
    sizes = pc.binary_length(words).to_numpy() - start
    ends = np.cumsum(sizes, dtype=np.int64)
    _, offsets, data = words.buffers()
    first = np.frombuffer(offsets, np.int32)[words.offset :][: len(words)] + start if len(words) else start
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.frombuffer(data or b"", np.uint8)[at])])


def _listed(words: pa.Array) -> list[bytes]:
    return words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """``encode(raw)`` gives little-endian uint32 ids as bytes for UTF-8 bytes of a text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        told = json.loads(self._tokenizer.to_str())
        self._by_word, self._letters = self._settings(told), None
        self._last = self._last_tokens(told["model"]) if self._by_word else None
        self._ids: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        _CACHES.append(self)

    def __len__(self) -> int:
        return len(self._ids) + len(self._older)

    def clear(self) -> None:
        self._ids, self._older = {}, {}

    @staticmethod
    def _settings(told: dict) -> bool:
        """Whether the vocabulary may be used word by word."""
        plain = all(told["model"].get(k) in (None, False, "") for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        return plain and told["model"]["type"] == "BPE" and told["post_processor"] is None and all(told[k] == v for k, v in SETTINGS.items())

    @staticmethod
    def _last_tokens(model: dict) -> np.ndarray | None:
        """By id, whether a token ends a word; None if not every byte has a token within and at the end of a word."""
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        if not suffix or not all(x in vocab for b in range(256) for x in (chr(_BYTES.get(b, b)), chr(_BYTES.get(b, b)) + suffix)):
            return None
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return last

    def _encode_letters(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of words of Latin-1 letters, by the model itself."""
        if self._letters is None:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import WhitespaceSplit

            self._letters = Tokenizer(self._tokenizer.model)
            self._letters.pre_tokenizer = WhitespaceSplit()
        for k in range(0, len(words), _AT_ONCE):
            raw = b" ".join(words[k : k + _AT_ONCE])
            text = raw.translate(_SMALL).decode("latin-1")
            if not text.isascii():
                for byte, char in _HIDDEN:
                    text = text.replace(byte, char)
            ids = np.array(self._letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            packed, at = ids.tobytes(), (4 * np.flatnonzero(self._last[ids]) + 4).tolist()
            yield from map(packed.__getitem__, map(slice, [0, *at[:-1]], at))

    def _tokenize(self, words: list[bytes]) -> None:
        """Put the ids of these words into the cache."""
        letters, rest = [], []
        for word in words:
            (letters if self._last is not None and (word.isalpha() and word.islower() or _WORD.fullmatch(word)) else rest).append(word)
        self._ids.update(zip(letters, self._encode_letters(letters), strict=True))
        found = self._tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for word, encoding in zip(rest, found, strict=True):
            self._ids[word] = np.array(encoding.ids, dtype="<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of these distinct words into the cache, from the older generation where it has them."""
        if len(self._ids) + len(words) > CACHE_WORDS:
            self._ids, self._older = {}, self._ids
        if self._older:
            found = list(map(self._older.get, words))
            self._ids.update([(word, x) for word, x in zip(words, found, strict=True) if x is not None])
            words = [word for word, x in zip(words, found, strict=True) if x is None]
        self._tokenize(words)

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        ids = list(map(self._ids.get, words))
        holes = [i for i, x in enumerate(ids) if x is None]
        if holes:
            self._learn([words[i] for i in holes])
            for i in holes:
                ids[i] = self._ids[words[i]]
        return ids

    def _encode_words(self, words: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """Lists of int32 ids of distinct words, and their lengths."""
        cut, cores, tails = _cut(words)
        parts = pa.concat_arrays([cores, tails]).dictionary_encode()
        found = self._looked_up(_listed(parts.dictionary))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = _lists(sizes, pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(found))]))
        at = parts.indices.to_numpy()
        core, tail = at[: len(cut)], at[len(cut) :]
        first = np.arange(len(cut)) + np.cumsum(cut) - cut
        order = np.empty(len(at), np.int32)
        order[first], order[first[cut] + 1] = core, tail
        whole = sizes[core]
        whole[cut] += sizes[tail]
        return _lists(whole, lists.take(pa.array(order)).flatten()), whole

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Lists of int32 ids of whole texts (UTF-8 as binary), in order; null is empty."""
        if not self._by_word:
            found = [self._tokenizer.encode_batch_fast([(x or b"").decode("utf-8", "replace")], add_special_tokens=False)[0].ids for x in texts.to_pylist()]
            return pa.array(found, pa.list_(pa.int32()))
        raw = pc.fill_null(texts, b"").view(pa.string())
        special = pc.match_substring(raw, "<|")  # special tokens are told by case
        lower = pc.ascii_lower(raw)
        split = pc.ascii_split_whitespace(pc.if_else(special, raw, lower) if pc.any(special).as_py() else lower)
        words = split.values.dictionary_encode()
        lists, sizes = self._encode_words(words.dictionary)
        ids = lists.take(words.indices).flatten()
        ends = np.concatenate([[0], np.cumsum(sizes[words.indices.to_numpy()])])[split.offsets.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    def encode_many(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Ids of whole texts as little-endian uint32, in order; null is empty."""
        for part in slices(pa.array(texts, pa.binary())):
            found = self.encode_array(part)
            packed, ends = found.values.to_numpy().tobytes(), found.offsets.to_pylist()
            yield from (packed[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    def encode(self, raw: bytes | None) -> bytes:
        """Ids of one whole text."""
        return next(self.encode_many([raw]))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Slices of an array of bytes with about ``most`` of them at most, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def with_end(lists: pa.ListArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The int32 ids of all texts with ``end_id`` after each, and where each text's begin, with their total."""
    ends = lists.offsets.to_numpy() + np.arange(len(lists) + 1)
    out = np.empty(int(ends[-1]), np.int32)
    last = np.zeros(len(out), bool)
    last[ends[1:] - 1] = True
    out[last], out[~last] = end_id, lists.values.to_numpy()
    return out, ends


@lru_cache(maxsize=None)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file; other operators' caches are emptied."""
    found = _encoder(path)
    claim(found)
    return found


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
