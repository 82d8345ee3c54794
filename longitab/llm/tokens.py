"""Ids of whole texts by the tokenizers library, a part at a time."""

from __future__ import annotations

import os
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from longitab.llm.common import worker_cache

#: Parts kept with their ids in each of two generations: when the newer is full, parts that were
#: not met since the older one began are let go.
CACHE_PARTS = 500_000
#: A longer part, in bytes, is encoded without being kept.
CACHE_BYTES = 40
#: Unknown words that are encoded together, none longer than so many bytes.
WORDS, WORD_BYTES = 512, 1 << 10

# Kinds of bytes: white space, letters (all beyond ASCII), other signs, the apostrophe.
_SPACE, _LETTER, _SIGN, _APOSTROPHE = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[ord("'")] = _APOSTROPHE
# Whether a part begins between two kinds, by 4 * the first + the second.
_BEGINS = np.zeros(16, bool)
_BEGINS[[4 * a + b for a, b in ((_LETTER, _SPACE), (_SIGN, _SPACE), (_APOSTROPHE, _SPACE), (_LETTER, _SIGN),
                                (_LETTER, _APOSTROPHE), (_SIGN, _LETTER))]] = True
# The same for many bytes at once.
_KIND_BYTES, _BEGINS_BYTES = _KIND.tobytes(), _BEGINS.tobytes().ljust(256, b"\0")
# Bytes that may end white space: ASCII, the four control characters, and last bytes of the wider spaces.
_MAY_SPACE = np.zeros(256, bool)
_MAY_SPACE[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


# The characters that byte-level vocabularies have for bytes; the space between words stays.
_BYTE_CHARS = np.arange(256, dtype="<u4")
_BYTE_CHARS[[*range(127, 161), 173]] = [*range(289, 324)]


def letters(chars: str) -> bool:
    """Whether all characters are letters and stay letters when they are composed and lower-cased."""
    return chars.isalpha() and normalize("NFC", chars).lower().isalpha()


class Kept:
    """Parts and their ids, as bytes in one line: part k has those from ``begin[k]`` to ``begin[k + 1]``."""

    def __init__(self):
        self.number: dict[bytes | tuple[int], int] = {}
        self.n, self.begin, self.ids = 0, np.zeros(1 << 12, np.int64), np.empty(1 << 16, np.uint8)

    def find(self, names: list) -> np.ndarray:
        """Numbers of parts, -1 where one is not kept."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))

    def add(self, names: list, ids: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of new parts with these ids."""
        new, m = np.arange(self.n, self.n + len(names)), len(names)
        offsets, data = contents(ids)
        begin, end = self.begin[self.n], self.begin[self.n] + offsets[-1]
        if self.n + m >= len(self.begin):
            self.begin = np.append(self.begin, np.zeros(self.n + m, np.int64))
        if end > len(self.ids):
            self.ids = np.append(self.ids, np.empty(end, np.uint8))
        self.begin[self.n + 1:self.n + m + 1] = begin + offsets[1:]
        self.ids[begin:end] = data
        self.n += m
        self.number.update(zip(names, new.tolist()))
        return new

    def take(self, numbers: np.ndarray) -> pa.LargeBinaryArray:
        return binary(self.begin[:self.n + 1], self.ids).take(pa.array(numbers))


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0, and bytes of a column of large strings without nulls."""
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[begin[0]:begin[-1]]
    return begin - begin[0], data


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The two public vocabularies never merge characters across the places where a text is cut
    here: before white space that follows a visible character, after letters, and before letters
    that do not follow an apostrophe. A part so has the ids that it has in the whole text, and
    one met before is looked up. Texts with marks, numbers or signs beyond ASCII (also after
    lower-casing, as in a dotted capital I), with control characters that count as white space in Python only, or with strings of special tokens are
    cut before spaces only. Texts are cut and parts numbered for all texts of a call at once, so
    that a distinct part costs one look-up a call.
    """

    def __init__(self, path: str, kept_parts: int = CACHE_PARTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kept_parts = kept_parts
        self.known, self.older = Kept(), Kept()
        # ids that begin with the space before a word, or that end a word
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ending = any(t.endswith("</w>") for t in vocabulary)
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.ending else t.startswith("\u0120"))]] = True
        # Words of letters only are cut at spaces, so the expressions of the word vocabulary need not look at them:
        # they are normalized by its normalizer and written in its characters for bytes. Takes half the time.
        self.bare = None
        if self.ending:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.CharDelimiterSplit(" ")

    @staticmethod
    def odd(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Numbers of the texts that are cut before spaces only."""
        marks = (data >= 28) & (data <= 31)
        marks[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        found = np.searchsorted(begin, np.flatnonzero(marks), "right") - 1
        beyond = np.flatnonzero(data >= 128)
        chars, at = data[beyond].tobytes(), np.searchsorted(beyond, begin)
        more = [i for i in np.flatnonzero(np.diff(at)) if not letters(chars[at[i]:at[i + 1]].decode())]
        return np.union1d(found, np.array(more, np.int64))

    def parts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where the parts of the texts begin, which lie in ``data`` from one of ``begin`` to the next."""
        kind = np.frombuffer(data.tobytes().translate(_KIND_BYTES), np.uint8)
        both = kind[:-1] << 2
        both |= kind[1:]
        first = np.ones(len(data), bool)
        first[1:] = np.frombuffer(both.tobytes().translate(_BEGINS_BYTES), bool)
        for i in self.odd(data, begin):
            text = data[begin[i]:begin[i + 1]]
            first[begin[i] + 1:begin[i + 1]] = (text[1:] == 32) & ~_MAY_SPACE[text[:-1]]
        first[begin[:-1][np.diff(begin) > 0]] = True
        return np.flatnonzero(first)

    def numbers(self, parts: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of distinct parts in ``known``."""
        if len(self.known.number) > self.kept_parts or self.known.begin[self.known.n] > 128 * self.kept_parts:
            self.known, self.older = Kept(), self.known
        names = parts.to_numpy(zero_copy_only=False)
        long = pc.binary_length(parts).to_numpy() > CACHE_BYTES
        out = self.known.find(names.tolist())
        missing = np.flatnonzero(out < 0)
        if len(missing) and self.older.n:
            old = self.older.find(names[missing].tolist())
            again, missing = missing[old >= 0], missing[old < 0]
            out[again] = self.known.add(names[again].tolist(), self.older.take(old[old >= 0]))
        if len(missing):
            new = self.ids_of(parts.take(pa.array(missing)))
            # a long part has its number for this call only
            out[missing] = self.known.add(names[missing].tolist(), new)
            for x in names[missing[long[missing]]]:
                del self.known.number[x]
        return out

    def ids_of(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of parts, none of which is empty, by the library. Words are encoded together."""
        begin, data = contents(parts)
        size = np.diff(begin)
        # a word follows one space; the word vocabulary has the same ids for it after other white space, or none
        white = _KIND[data[begin[:-1]]] == _SPACE if self.ending else data[begin[:-1]] == 32
        lead = white.astype(np.int64)
        word = (size > lead) & (size <= WORD_BYTES) & (white | self.ending)
        word &= np.add.reduceat(_KIND[data] == _LETTER, begin[:-1], dtype=np.int64) == size - lead
        start, size = begin[:-1] + lead, size - lead
        beyond = np.add.reduceat(data >= 128, begin[:-1], dtype=np.int64) > 0
        order, sizes, ids = [], [], []
        for words in (np.flatnonzero(word & ~beyond), np.flatnonzero(word & beyond)):
            for k in range(0, len(words), WORDS):
                run = words[k:k + WORDS]
                # each word with one space before it
                end = np.cumsum(size[run] + 1)
                joined = data[np.repeat(start[run] - end + size[run], size[run] + 1) + np.arange(end[-1])]
                joined[end - size[run] - 1] = 32
                joined = joined.tobytes().decode()
                n, x = self.ids_of_words(joined)
                if len(n) != len(run):
                    own = joined[1:].split(" ")
                    run = run[[letters(w) for w in own]]
                    n, x = self.ids_of_words("".join(" " + w for w in own if letters(w)))
                if len(n) == len(run):
                    order.append(run), sizes.append(n), ids.append(x)
        rest = np.ones(len(parts), bool)
        rest[np.concatenate([*order, np.empty(0, np.int64)])] = False
        rest = np.flatnonzero(rest)
        alone = [data[begin[i]:begin[i + 1]].tobytes().decode() for i in rest]
        for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False):
            ids.append(np.array(e.ids, "<u4"))
            sizes.append([len(e.ids)])
        place = np.empty(len(parts), np.int64)
        place[np.concatenate([*order, rest])] = np.arange(len(parts))
        return binary(np.append(0, 4 * np.cumsum(np.concatenate(sizes))), np.concatenate(ids)).take(pa.array(place))

    def ids_of_words(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and ids, of words that stand in one text with a space before each; nothing if they have
        other characters than letters. One id of a word is its edge; where a word has more of them after
        normalising, there are more numbers than words."""
        tokenizer = self.tokenizer
        if self.bare:
            tokenizer = self.bare
            joined = joined.lower() if joined.isascii() else self.tokenizer.normalizer.normalize_str(joined)
        if not joined.replace(" ", "").isalpha():
            return np.empty(0, np.int64), np.empty(0, "<u4")
        if self.bare and not joined.isascii():
            joined = _BYTE_CHARS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        return np.diff(np.append(-1, at) if self.ending else np.append(at, len(ids))), ids

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of each text and the end id, as unsigned 32-bit integers. Null text is empty."""
        column = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not len(column):
            return []
        begin, data = contents(column)
        first = self.parts(data, begin)
        cut = binary(np.append(first, len(data)), data).dictionary_encode()
        numbers = self.numbers(cut.dictionary)
        # the end id is one more part, after the parts of each text; no part has its name
        name = (end_id,)
        end = self.known.find([name])
        if end[0] < 0:
            end = self.known.add([name], pa.array([np.array([end_id], "<u4").tobytes()], pa.large_binary()))
        after = np.searchsorted(first, begin[1:]) + np.arange(len(column))
        number = np.empty(len(first) + len(column), np.int64)
        number[after] = end[0]
        is_part = np.ones(len(number), bool)
        is_part[after] = False
        number[is_part] = numbers[cut.indices.to_numpy()]
        offsets, ids = contents(self.known.take(number))
        return np.split(ids.view("<u4"), offsets[after[:-1] + 1] // 4)


def encoder(path: str, kept_parts: int = CACHE_PARTS) -> Encoder:
    """One encoder for each vocabulary and worker, kept from task to task."""
    kept = worker_cache()
    if path not in kept:
        kept[path] = Encoder(path)
    kept[path].kept_parts = kept_parts
    return kept[path]
