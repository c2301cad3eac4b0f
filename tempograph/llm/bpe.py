"""Byte-level BPE ids by the tokenizers library, with a table of pieces.

A byte-level BPE with the usual word pattern never joins what stands on the two sides of a space between two
non-space characters: the space begins the next piece. So a text is the chain of its chunks between such spaces,
each encoded with its leading space. Arrow splits the texts and numbers a batch's distinct chunks. NumPy cuts these into the
word pattern's pieces and looks the pieces up, all at once; each new one goes to the library's model once.
"""

from __future__ import annotations

import functools
import gc
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_OF_SENTENCE = (".", "!", "?")
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split
#: The byte alphabet: bytes that print stand for themselves, the others for characters from 256 on.
_SAME = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_ALPHABET = {b: chr(b) for b in _SAME} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SAME)}
#: Kinds of bytes. Chunks with a byte of no kind are cut by the library.
NONE, LETTER, DIGIT, MARK, LINE, SPACE = range(6)
KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((LETTER, range(65, 91)), (LETTER, range(97, 123)), (DIGIT, range(48, 58)), (MARK, range(33, 48)), (MARK, range(58, 65)), (MARK, range(91, 97)), (MARK, range(123, 127)), (LINE, [10]), (SPACE, [32])):
    KIND[list(_bytes)] = _kind
#: After the byte C3: the letters from U+00C0 to U+00FF, without the signs of multiplication and division.
AFTER_C3 = np.zeros(256, bool)
AFTER_C3[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
#: What the word pattern parts after an apostrophe: one byte or two.
CONTRACTIONS = [(ord("s"), 0), (ord("t"), 0), (ord("m"), 0), (ord("d"), 0), *(tuple(x) for x in (b"re", b"ve", b"ll"))]
LANES = 4
LONGEST = 8 * LANES - 1  # bytes of a key
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def uncollected(f):
    """f without the search for cyclic garbage, of which it makes none; it would visit all that is remembered time and again."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        on = gc.isenabled()
        gc.disable()
        try:
            return f(*args, **kwargs)
        finally:
            if on:
                gc.enable()

    return run


class Remembered(dict):
    """Values by key in two generations: at `most` the young one becomes the old one, and what is met again returns."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict = {}

    def known(self, keys: list) -> list:
        """The values of keys, None where unknown."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        found = list(map(self.get, keys))
        if self.old:
            for i in [i for i, x in enumerate(found) if x is None]:
                if (x := self.old.get(keys[i])) is not None:
                    found[i] = self[keys[i]] = x
        return found


def keys_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each key of at most LONGEST bytes as four integers: its bytes, zeros, and its size as the last byte, so no two keys agree.
    data has at least 8 * LANES bytes after the last start."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.empty((len(starts), LANES), np.uint64)
    for k in range(LANES):
        out[:, k] = words[starts + 8 * k] & _MASKS[np.clip(sizes - 8 * k, 0, 8)]
    out[:, -1] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


class PieceTable:
    """Ids by key, in arrays: an open hash table whose entries are compared by all of their bytes. Beyond `most` entries, those not
    met again since the last time are forgotten."""

    def __init__(self, most: int):
        self.most, self.n, self.used = most, 0, 0
        self.keys, self.starts, self.sizes, self.met = np.empty((1024, LANES), np.uint64), np.empty(1024, np.int64), np.empty(1024, np.int64), np.zeros(1024, bool)
        self.ids, self.slots = np.empty(4096, np.uint32), np.full(4096, -1, np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys * _FACTORS).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * _FACTORS[0]) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            entry = self.slots[slot]
            there = np.flatnonzero(entry >= 0)
            todo, slot, entry = todo[there], slot[there], entry[there]
            other = (self.keys[entry] != keys[todo]).any(axis=1)
            out[todo[~other]] = entry[~other]
            todo, slot = todo[other], (slot[other] + 1) & (len(self.slots) - 1)
        self.met[out[out >= 0]] = True
        return out

    def fill(self, entries: np.ndarray) -> None:
        todo, slot = entries, self.slot(self.keys[entries])
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            lost = self.slots[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entries of new and distinct keys, whose ids stand one after the other."""
        n, used = self.n + len(keys), self.used + len(ids)
        if n > len(self.keys):
            more = max(n, 2 * len(self.keys)) - len(self.keys)
            self.keys, self.starts, self.sizes, self.met = (np.concatenate([x, np.zeros((more, *x.shape[1:]), x.dtype)]) for x in (self.keys, self.starts, self.sizes, self.met))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(used, 2 * len(self.ids)) - len(self.ids), np.uint32)])
        new = np.arange(self.n, n)
        self.keys[new], self.sizes[new], self.starts[new], self.met[new] = keys, sizes, self.used + np.cumsum(sizes) - sizes, False
        self.ids[self.used : used] = ids
        self.n, self.used = n, used
        if 2 * n > len(self.slots):
            self.slots, new = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32), np.arange(n)
        self.fill(new)
        return np.arange(n - len(keys), n)

    def forget(self) -> None:
        """Entries have other numbers afterwards."""
        if self.n > self.most:
            kept = np.flatnonzero(self.met[: self.n])[-self.most // 2 :]
            keys, ids, sizes = self.keys[kept], self.of(kept), self.sizes[kept]
            self.__init__(self.most)
            self.add(keys, ids, sizes)

    def of(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries, one after the other."""
        return gathered(self.ids, self.starts[entries], self.sizes[entries])


def places(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of large strings begins in their buffer, and its bytes."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return offsets[:-1], np.diff(offsets)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkedBPE:
    """encode(texts) gives each text's ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces, self.rest, self.heads = PieceTable(most_pieces), Remembered(most_pieces // 10), Remembered(most_pieces // 25)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = sorted({t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a token has a character for each of its bytes
        self.token_bytes[list(vocab.values())] = list(map(len, vocab))

    def cut(self, data: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin in chunks that have a space before each of them, at spaces, and which bytes are not for us to cut."""
        kind = KIND[data]
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[AFTER_C3[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        before, after = np.concatenate([[NONE], kind[:-1]]), np.concatenate([kind[1:], [SPACE]])
        begins = (kind != before) & (before != SPACE) | (kind == SPACE)
        line = np.flatnonzero((kind == LINE) & (before == LINE))
        begins[line[(after[line] != LINE) & (after[line] != SPACE)]] = True  # the last of several new lines before a word
        odd = kind == SPACE
        odd[spaces] = False
        odd |= (kind == NONE) | (kind == LINE) & (before == SPACE)
        quote = np.flatnonzero((data == 39) & begins & (after == LETTER))
        second, third = data[quote + 1], data[np.minimum(quote + 2, len(data) - 1)]
        for one, two in CONTRACTIONS:
            here = quote[(second == one) & ((third == two) | (two == 0))]
            begins[here + 1] = False
            here = here[here + 2 + (two > 0) < len(data)]
            begins[here + 2 + (two > 0)] = True
        for token in self.special:
            here = np.flatnonzero(data == token[0])
            for k, byte in enumerate(token):
                here = here[here + k < len(data)]
                here = here[data[here + k] == byte]
            odd[here] = True
        return begins, odd

    def of_chunks(self, words: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each used word with a space before it begin, and how many they are."""
        flat, starts, sizes = np.zeros(0, np.uint32), np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        if not len(used):
            return flat, starts, sizes
        at, length = places(words)
        at, length = at[used], length[used]
        stops = np.cumsum(length + 1)
        data = np.full(int(stops[-1]) + 8 * LANES, 32, np.uint8)  # each with a space before it
        data[np.repeat(stops - length - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))] = gathered(np.frombuffer(words.buffers()[2], np.uint8), at, length)
        begins, odd = self.cut(data[: stops[-1]], stops - length - 1)
        piece = np.flatnonzero(begins)
        size = np.diff(piece, append=stops[-1])
        of_word = np.cumsum(data[piece] == 32) - 1
        if odd.any() or size.max() > LONGEST:
            own = np.ones(len(used), bool)
            own[np.searchsorted(stops, np.flatnonzero(odd), "right")] = False
            own[np.searchsorted(stops, piece[size > LONGEST], "right")] = False
            return self.of_mixed(words, used, own)
        entry = self.of_pieces(data, piece, size)
        each = self.pieces.sizes[entry]
        sizes = np.bincount(of_word, each, len(used)).astype(np.int64)
        return self.pieces.of(entry), np.cumsum(sizes) - sizes, sizes

    def of_mixed(self, words: pa.Array, used: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As of_chunks, with the words that are not own by the library."""
        starts, sizes = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        flat, starts[own], sizes[own] = self.of_chunks(words, used[own])
        rest = self.of_rest(words.take(pa.array(used[~own])).to_pylist())
        sizes[~own] = n = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        starts[~own] = len(flat) + np.cumsum(n) - n
        return np.concatenate([flat, np.frombuffer(b"".join(rest), "<u4")]), starts, sizes

    def of_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The table's entries of the pieces that stand in data one after the other; new ones are put into it."""
        self.pieces.forget()
        keys = keys_of(data, starts, sizes)
        entry = self.pieces.find(keys)
        unknown = np.flatnonzero(entry < 0)
        if len(unknown):
            offsets = np.append(starts, starts[-1] + sizes[-1])
            every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
            codes = every.take(pa.array(unknown)).dictionary_encode()
            number, new = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            tokenize = self.tokenizer.model.tokenize
            tokens = [tokenize("Ġ" + p[1:] if p[0] == " " and p.isascii() else p.encode().decode("latin-1").translate(BYTE_ALPHABET)) for p in new]
            first = np.empty(len(new), np.int64)
            first[number[::-1]] = unknown[::-1]
            entry[unknown] = self.pieces.add(keys[first], np.array(array("I", [t.id for ts in tokens for t in ts]), np.uint32), np.fromiter(map(len, tokens), np.int64, len(tokens)))[number]
        return entry

    def of_rest(self, wanted: list[str]) -> list[bytes]:
        """Chunks that the library cuts."""
        found = self.rest.known(wanted)
        if missing := [w for w, ids in zip(wanted, found) if ids is None]:
            new = {}
            for at in range(0, len(missing), 5000):  # many chunks as one text, its ids cut where their bytes begin
                part = missing[at : at + 5000]
                ids = np.array(self.tokenizer.encode(" " + " ".join(part), add_special_tokens=False).ids, "<u4")
                ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(w.encode()) + 1 for w in part]), "left") + 1
                data, stops = ids.tobytes(), (4 * ends).tolist()
                new.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops)]))
            self.rest.update(new)
            found = [new[w] if ids is None else ids for w, ids in zip(wanted, found)]
        return found

    def of_heads(self, wanted: list[str]) -> list[bytes]:
        """A text's first chunk has no space before it."""
        distinct = list(set(wanted))
        found = dict(zip(distinct, self.heads.known(distinct)))
        if unknown := [w for w, ids in found.items() if ids is None]:
            for w, e in zip(unknown, self.tokenizer.encode_batch(unknown, add_special_tokens=False)):
                found[w] = self.heads[w] = np.array(e.ids, "<u4").tobytes()
        return [found[w] for w in wanted]

    @uncollected
    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        codes = split.values.dictionary_encode()
        offsets, index, words = split.offsets.to_numpy(), codes.indices.to_numpy().astype(np.int64), codes.dictionary
        odd = pc.or_(pc.equal(words, ""), pc.not_equal(words, pc.utf8_trim_whitespace(words))).to_numpy(zero_copy_only=False)
        if odd.any():  # these texts have spaces that part nothing
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[index]), "right") - 1).tolist()
            number: dict[str, int] = {}
            lists = {r: [number.setdefault(w, len(words) + len(number)) for w in BETWEEN(texts[r])] for r in rows}
            parts = [lists[r] if r in lists else index[offsets[r] : offsets[r + 1]] for r in range(len(texts))]
            offsets = np.cumsum([0, *map(len, parts)])
            index, words = np.concatenate([np.asarray(x, np.int64) for x in parts]), pa.concat_arrays([words, pa.array(list(number), pa.large_string())])
        first = offsets[:-1]
        inner = np.ones(len(index), bool)
        inner[first] = False
        wanted = np.zeros(len(words), bool)
        wanted[index[inner]] = True
        used, place = np.flatnonzero(wanted), np.cumsum(wanted) - 1
        flat, starts, sizes = self.of_chunks(words, used)
        heads = self.of_heads(words.take(pa.array(index[first])).to_pylist())
        size = np.fromiter(map(len, heads), np.int64, len(heads)) // 4
        starts, sizes = np.concatenate([starts, len(flat) + np.cumsum(size) - size]), np.concatenate([sizes, size])
        index = place[index]
        index[first] = len(used) + np.arange(len(first))
        length = sizes[index]
        ids = gathered(np.concatenate([flat, np.frombuffer(b"".join(heads), "<u4")]), starts[index], length).tobytes()
        stops = (4 * np.cumsum(length)[offsets[1:] - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def sentence_ends(self) -> np.ndarray:
        """For each id: does a sentence end with it?"""
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            out[i] = token.endswith(END_OF_SENTENCE) or "Ċ" in token  # the byte alphabet's new line
        return out


_made: dict[str, ChunkedBPE] = {}


def shared_bpe(path: str) -> ChunkedBPE:
    """One per Python worker."""
    if path not in _made:
        _made[path] = ChunkedBPE(path)
    return _made[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
