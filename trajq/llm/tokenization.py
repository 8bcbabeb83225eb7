"""Token ids by the tokenizers library, each distinct word encoded once.

A text is cut before single spaces whose neighbours are no white space. Neither of the two
supported pre-tokenizers joins anything across such a place, so the ids are those of the whole
text; a piece that was seen before costs a dictionary lookup.

Texts that are single-spaced throughout are cut for many at once by the classes of their bytes, into the
words that the pre-tokenizer makes of them, which are looked up by hash. The bytes of each are compared with those of the
word that was remembered under its hash, so a chance collision changes nothing.
"""

from __future__ import annotations

import gc
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from trajq.llm.common import Words, mix

#: Latin-1 letters, digits and other visible characters, as the pre-tokenizers class them.
LETTERS, DIGITS, OTHERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷"
PLAIN = re.compile(f" ?[{LETTERS}{DIGITS}{OTHERS}]+(?:\n[{LETTERS}{DIGITS}{OTHERS}]+)*")
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = re.compile(f"{SUFFIXES}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[{OTHERS}]+|\n")
WORD_LEVEL = re.compile(f"{SUFFIXES}|[{LETTERS}]+|[{DIGITS}]|[{OTHERS}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if visible, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Controls that count as white space (or as a cut, 0) besides space and line end, and the UTF-8 of white space beyond ASCII.
ODD_CONTROLS = bytes([0, 9, 11, 12, 13, 28, 29, 30, 31])
WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u3000\u205f\u2028\u2029\u202f"] + [b"\xe2\x80" + bytes([k]) for k in range(0x80, 0x8B)]
#: Bytes of texts that are cut at once; a longer text is cut by itself, piece by piece.
GROUP = 1 << 19
#: Bytes of remembered words beyond which the memory starts afresh.
SPELT = 64 << 20
#: Classes of bytes: between words, letters, digits, other visible characters, line ends, bytes whose whole piece is left to the pre-tokenizer.
GAP, LETTER, DIGIT, OTHER, LINE, ODD = range(6)


def byte_classes(lower: bool) -> np.ndarray:
    """The class of each byte of a single-spaced text; of the letters beyond ASCII only those from U+00C0 to U+00FF are told."""
    out = np.full(256, ODD, np.uint8)
    out[[0, 32]], out[10] = GAP, GAP if lower else LINE
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else OTHER if not chr(b).isdigit() else ODD if lower else DIGIT
    out[[39, 60]] = ODD  # contractions, special tokens
    out[[0xC3, *range(0x80, 0xC0)]] = LETTER
    out[[0x97, 0xB7]] = ODD  # after 0xC3 the signs of multiplication and division
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def single_spaced(text: str) -> bool:
    """No white space but single spaces and line ends between words."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    raw = text.encode()
    if len(raw.translate(None, ODD_CONTROLS)) != len(raw):
        return False
    return text.isascii() or not any(w in raw for w in WIDE_SPACES)


class Encoder:
    """``ids(texts)``: the ids of each text, with ``end`` appended, as uint32 arrays.

    ``most`` bounds the remembered pieces; beyond it the memory starts afresh.
    """

    def __init__(self, path: str, end: int, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end, most
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.space = self.alphabet[32]
        self.lower = self.tokenizer.normalizer is not None
        self.split = (WORD_LEVEL if self.lower else BYTE_LEVEL).findall
        self.kind, self.hashing = byte_classes(self.lower), Words(lower=False)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.words: dict[str, list[int]] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of the words known by hash, ascending
        self.bytes, self.filled = np.zeros(1 << 20, np.uint8), 0  # these words themselves, each between its two ends
        self.ends = np.zeros((1 << 16, 2), np.int32)

    def word(self, word: str) -> list[int]:
        known = self.words.get(word)
        if known is None:
            if not word.isascii():
                seen = word.encode().decode("latin-1").translate(self.alphabet)
            else:
                seen = self.space + word[1:] if word[0] == " " else word if word != "\n" else self.alphabet[10]
            known = self.words[word] = [t.id for t in self.model.tokenize(seen)]
        return known

    def learn(self, new: list[str]) -> None:
        first = self.remember(self.found(new))
        self.code.update(zip(new, range(first, self.count)))

    def found(self, new: list[str]) -> list:
        """The ids of pieces. Plain Latin ones go to the library's model word by word, all others through its whole pipeline."""
        got: list = [None] * len(new)
        odd, ids_of = [], self.word
        tokenize, lower, space, alphabet = self.model.tokenize, self.lower, self.space, self.alphabet
        code, learnt = self.code, {}  # a piece is mostly another one with a comma, a full stop or a capital
        for i, piece in enumerate(new):
            plain = piece.lower() if lower else piece
            tail = plain[-1:]
            stem = plain[:-1] if tail == "," or tail == "." else plain
            bare = stem[1:] if stem[:1] == " " else stem
            if bare.isalpha() and (bare.isascii() or max(bare) <= "\xff"):
                ids = learnt.get(stem)
                if ids is None:
                    at = code.get(stem)
                    if at is None:
                        seen = bare if bare.isascii() else bare.encode().decode("latin-1").translate(alphabet)
                        ids = [t.id for t in tokenize(seen if lower or bare is stem else space + seen)]
                    else:
                        start = self.starts[at]
                        ids = self.flat[start : start + self.sizes[at]].tolist()
                    learnt[stem] = ids
                got[i] = ids if stem is plain else ids + ids_of(tail)
            elif PLAIN.fullmatch(piece) and "<|" not in piece:
                got[i] = tuple(chain.from_iterable(map(ids_of, self.split(plain))))
            else:
                odd.append(i)
        for at in range(0, len(odd), 1024):
            for i, e in zip(odd[at : at + 1024], self.tokenizer.encode_batch([new[i] for i in odd[at : at + 1024]], add_special_tokens=False)):
                got[i] = e.ids
        return got

    def remember(self, got: list) -> int:
        """Takes ids under new codes, the first of which is returned."""
        first, last = self.count, self.count + len(got)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        need = self.used + int(sizes.sum())
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : need] = np.fromiter(chain.from_iterable(got), np.uint32, need - self.used)
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = need, last
        return first

    def learn_words(self, text: str, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> None:
        """Takes words at places of a text of bytes under new codes; odd ones are whole pieces."""
        tokenize, alphabet, space, lower = self.model.tokenize, self.alphabet, self.space, self.lower
        words = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        whole = [words[i].encode("latin-1").decode() for i in np.flatnonzero(odd).tolist()]
        of_whole, got = iter(self.found(whole)), []
        for word, as_piece in zip(words, odd.tolist()):
            if as_piece:
                got.append(next(of_whole))
                continue
            if lower:
                word = word.lower() if word.isascii() else word.encode("latin-1").decode().lower().encode().decode("latin-1")
            if not word.isascii() or word == "\n":
                word = word.translate(alphabet)
            elif word[0] == " ":
                word = space + word[1:]
            got.append([t.id for t in tokenize(word)])
        self.remember(got)

    def cut(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of single-spaced texts with 0 between them, and which are whole pieces."""
        kind = self.kind[raw]
        odd = np.flatnonzero(kind == ODD)
        if len(odd):
            inside = np.concatenate([[False], (raw != 32) & (raw != 10) & (raw != 0), [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            piece = np.unique(np.searchsorted(edge[::2], odd, "right") - 1)
            kind[ranges(edge[::2][piece], edge[1::2][piece] - edge[::2][piece])] = ODD
        at = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]])
        keep = kind[at[:-1]] != GAP
        starts, ends = at[:-1][keep], at[1:][keep]
        odd = kind[starts] == ODD
        spaced = (starts > 0) & (raw[starts - 1] == 32)
        return starts - (spaced & odd if self.lower else spaced), ends, odd

    def codes_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes of the words of single-spaced texts, and where each text's codes end. None: two words have one hash."""
        joined = b"\0".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        starts, ends, odd = self.cut(raw)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.hashing.value[raw] * self.hashing.up[: len(raw)], out=total[1:])
        coded = pa.array(mix((total[ends] - total[starts]) * self.hashing.down[starts])).dictionary_encode()
        which, hashes = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inner = place < len(self.hashes)
        known[inner] = self.hashes[place[inner]] == hashes[inner]
        if not known.all():
            first = np.empty(len(hashes), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            new = np.flatnonzero(~known)
            new = new[np.argsort(hashes[new])]
            a, b = starts[first[new]], ends[first[new]]
            codes = np.arange(self.count, self.count + len(new), dtype=np.int32)
            self.learn_words(joined.decode("latin-1"), a, b, odd[first[new]])
            self.spell(codes, raw[ranges(a, b - a)], b - a)
            self.hashes, self.codes = np.insert(self.hashes, place[new], hashes[new]), np.insert(self.codes, place[new], codes)
            place = np.searchsorted(self.hashes, hashes)
        codes, sizes = self.codes[place][which], ends - starts
        spelt = self.ends[codes]
        if (spelt[:, 1] - spelt[:, 0] != sizes).any() or (self.bytes[ranges(spelt[:, 0], sizes)] != raw[ranges(starts, sizes)]).any():
            return None
        return codes, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) - 1)

    def spell(self, codes: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> None:
        """Takes the bytes of new words."""
        if self.filled + len(letters) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(letters)), np.uint8)])
        while self.count > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.bytes[self.filled : self.filled + len(letters)] = letters
        ends = self.filled + np.cumsum(sizes)
        self.ends[codes] = np.column_stack([ends - sizes, ends])
        self.filled += len(letters)

    @staticmethod
    def pieces(text: str) -> list[str]:
        if single_spaced(text):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        first, *rest = text.split(" ")
        whole = [first]
        for word in rest:
            if not word or word[0].isspace() or not whole[-1] or whole[-1][-1].isspace():
                whole[-1] += " " + word
            else:
                whole.append(" " + word)
        return whole

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the collector rests meanwhile, since what is remembered holds no cycles."""
        gc.disable()
        try:
            return self.encoded(texts)
        finally:
            gc.enable()

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        group, held, rest = [], 0, []
        for i, text in enumerate(texts):
            raw = text.encode() if len(text) <= GROUP and single_spaced(text) else None
            if raw is None or len(raw) > GROUP:
                rest.append(i)
                continue
            if held + len(raw) > GROUP:
                self.by_words(group, out, rest)
                group, held = [], 0
            group.append((i, raw))
            held += len(raw)
        if group:
            self.by_words(group, out, rest)
        if rest:
            for i, ids in zip(rest, self.by_pieces([texts[i] for i in rest])):
                out[i] = ids
        return out

    def room(self) -> None:
        if self.count > self.most or self.filled > SPELT:
            self.forget()
        elif len(self.words) > self.most // 2:
            self.words.clear()

    def by_words(self, group: list[tuple[int, bytes]], out: list, rest: list[int]) -> None:
        """Fills in the ids of a group of single-spaced texts, or leaves it to the rest."""
        self.room()
        found = self.codes_of([raw for _, raw in group])
        if found is None:
            rest += [i for i, _ in group]
            return
        for (i, _), ids in zip(group, self.gathered(*found)):
            out[i] = ids

    def by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        self.room()
        cut = [self.pieces(t) for t in texts]
        every = list(chain.from_iterable(cut))
        codes = np.fromiter(map(self.code.get, every, repeat(-1)), np.int32, len(every))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [every[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            codes[missing] = np.fromiter(map(self.code.__getitem__, unknown), np.int32, len(unknown))
        return self.gathered(codes, np.cumsum([len(c) for c in cut]))

    def gathered(self, codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of texts from their codes and where each text's codes end; a text may have none."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.starts[codes] - (ends - sizes).astype(np.int32), sizes)
        place += np.arange(total, dtype=np.int32)
        flat = self.flat[place]
        last = np.concatenate([[0], ends])[bounds].tolist()
        out = []
        for a, b in zip([0, *last[:-1]], last):
            ids = np.empty(b - a + 1, np.uint32)
            ids[:-1] = flat[a:b]
            ids[-1] = self.end
            out.append(ids)
        return out
