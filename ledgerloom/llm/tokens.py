"""Token ids and counts by a public vocabulary, as its library gives them, with a memory of words.

The vocabularies of kind "word BPE" drop white space and never join text across it, so a text's ids
are those of its space-separated parts in a row. ``PartEncoder`` asks the library for each distinct
part once and remembers the answer, up to a fixed number of parts.
"""

from __future__ import annotations

import json
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np

#: Parts and pre-tokens remembered per Python worker (about 200 bytes each); beyond it a memory starts afresh.
REMEMBERED, REMEMBERED_WORDS = 800_000, 500_000
STRETCH = 1 << 13  # bytes of text whose parts are looked up together

# Fixed value: the pre-token pattern below, for lower-case printable ASCII.
_ASCII_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_PRINTABLE = re.compile(r"[\x21-\x7e]+")
#: A word of Latin letters that no normalisation joins or changes but by case, and one mark after it.
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)]?)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTER = _byte_letters()


# The steps before the merges that the memory of words relies on: white space becomes a space, letters
# become small, and what the pattern finds is merged by itself, as bytes.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_at_space(path: str) -> bool:
    """Whether this vocabulary file's own steps are those above, so that parts between white space, and pre-tokens, are
    independent. Files with any other step are left to the library, text by text."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [(spec.get(kind) or {}).get(name) for kind, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    model = spec["model"]
    return steps == [NORMALIZERS, PRETOKENIZERS] and model["type"] == "BPE" and not model.get("dropout") and not spec.get("post_processor")


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def whole_tokens(path: str) -> list[bytes]:
    """The strings of the vocabulary that the library encodes, alone, as exactly one token.

    Proved here, once and offline, by encoding each of them; at most as many as the vocabulary has.
    """
    tokenizer = load(path)
    strings = sorted({t.removesuffix("</w>") for t in tokenizer.get_vocab(with_added_tokens=False)})
    strings = [s for s in strings if s and s.isascii() and s.isprintable() and " " not in s]
    found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return [s.encode() for s, e in zip(strings, found, strict=True) if len(e.ids) == 1]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]  # of so many ids


class _Words:
    """The ids of distinct words: one library call for many, between special tokens, which the library takes
    out of a text before it does anything else."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip]
        self.separator, self.mark = special[0] if special else (None, None)

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens in lower case: the model's merges alone, over the letters of their bytes."""
        tokenize, pack = self.tokenizer.model.tokenize, _PACK
        spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(_LETTER) for w in words]
        out = []
        for w in spelt:
            ids = [t.id for t in tokenize(w)]
            out.append(pack[len(ids)](*ids) if len(ids) < len(pack) else array("I", ids).tobytes())
        return out

    def of(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian bytes; words that may hold part of a special token go by themselves."""
        if not words or self.separator is None:
            return [self.alone(w).tobytes() for w in words]
        joined = self.separator.join(words)
        ids = self.alone(joined)
        stops = np.flatnonzero(ids == self.mark)
        if len(stops) != len(words) - 1 or joined.count("<|") != len(stops) * self.separator.count("<|"):
            return [self.alone(w).tobytes() for w in words]
        raw = ids.tobytes()
        at = [-4, *(4 * stops).tolist(), len(raw)]
        return [raw[x + 4 : y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _pretokens(part: bytes) -> tuple[str, ...] | list[str] | None:
    """None: special strings and further characters are left to the library as they stand."""
    text = part.decode()
    if word := _LATIN.fullmatch(text):
        letters, mark = word.groups()
        return (letters.lower(), mark) if mark else (letters.lower(),)
    return _ASCII_PRETOKEN.findall(text.lower()) if _PRINTABLE.fullmatch(text) and "<|" not in text else None


class PartEncoder:
    """The ids of whole texts, each as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.independent = splits_at_space(path)
        self.words = _Words(path)
        self.known: dict[bytes, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.independent:
            return [self.words.alone(t.decode()).tobytes() for t in texts]
        out: list[bytes] = []
        for a, b in _stretches(texts):
            # A part is looked up once: only those that are not known are looked at again.
            parts = [t.split() for t in texts[a:b]]
            found = [list(map(self.known.get, p)) for p in parts]
            new = {w for p, ids in zip(parts, found, strict=True) if None in ids for w, x in zip(p, ids, strict=True) if x is None}
            if new:
                self._learn(new)
                known = self.known
                found = [[known[w] if x is None else x for w, x in zip(p, ids, strict=True)] if None in ids else ids for p, ids in zip(parts, found, strict=True)]
            out += map(b"".join, found)
        return out

    def _learn(self, new: set[bytes]) -> None:
        known, merged = self.known, self.merged
        if len(known) > REMEMBERED:
            known.clear()
        if len(merged) > REMEMBERED_WORDS:
            merged.clear()
        plain = {p: p.lower().decode() for p in new if p.isalpha()}  # of ASCII letters alone: one pre-token
        split = {p: _pretokens(p) for p in new.difference(plain)}
        words = list({t for ts in split.values() if ts for t in ts}.union(plain.values()).difference(merged))
        merged.update(zip(words, self.words.merge(words), strict=True))
        known.update(zip(plain, map(merged.__getitem__, plain.values()), strict=True))
        other = [p for p, ts in split.items() if ts is None]
        known.update(zip(other, self.words.of([p.decode() for p in other]), strict=True))
        known.update((p, b"".join([merged[t] for t in ts])) for p, ts in split.items() if ts is not None)


_ENCODERS: dict[str, PartEncoder] = {}


def part_encoder(path: str) -> PartEncoder:
    """This worker's encoder, which remembers words from one task to the next, until ``forget_encoders``."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def forget_encoders() -> None:
    """Give the memory of words back: called by the tasks that follow those which encode."""
    _ENCODERS.clear()


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``STRETCH`` bytes, whose parts are looked up together."""
    start, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= STRETCH or i == len(texts):
            yield start, i
            start, size = i, 0


class PartCounter:
    """The number of tokens of whole texts, by the whole-token shortcut.

    A part, or a pre-token of one, that is among ``whole`` counts as one token directly; only the rest
    go through the library's merges. Vocabularies that keep white space are counted by the library alone.
    """

    def __init__(self, path: str, whole: list[bytes]) -> None:
        self.independent = splits_at_space(path)
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda words: [len(pieces.encode(w, num_threads=1)) for w in words]
        else:
            self.words = _Words(path)
            self.library = lambda words: [len(x) // 4 for x in self.words.of(words)]
        self.whole = frozenset(x.decode() for x in whole)
        self.known: dict[bytes, int] = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.independent:
            return self.library([t.decode() for t in texts])
        out: list[int] = []
        for a, b in _stretches(texts):
            parts = [t.split() for t in texts[a:b]]
            self._learn(parts)
            known = self.known.__getitem__
            out += [sum(map(known, p)) for p in parts]
        return out

    def _learn(self, parts: list[list[bytes]]) -> None:
        known, merged, whole = self.known, self.merged, self.whole
        if len(known) > REMEMBERED:
            known.clear()
            known.update((x.encode(), 1) for x in whole)
        if len(merged) > REMEMBERED_WORDS:
            merged.clear()
        split = {p: _pretokens(p) for p in set().union(*parts).difference(known)}
        rest = list({t for ts in split.values() if ts for t in ts}.difference(merged).difference(whole))
        merged.update((t, len(x) // 4) for t, x in zip(rest, self.words.merge(rest), strict=True))
        other = [p for p, ts in split.items() if ts is None]
        known.update(zip(other, self.library([p.decode() for p in other]), strict=True))
        for p, ts in split.items():
            if ts is not None:
                known[p] = sum([1 if t in whole else merged[t] for t in ts])
