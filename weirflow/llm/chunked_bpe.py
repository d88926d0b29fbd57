"""Encoding by the tokenizers library, once for each distinct stretch of text.

Both tokenizer kinds used here cut a text at white space before they merge, so a
text's ids are those of its stretches, one after another. Each worker numbers the
stretches it meets, hands the library those that are new and keeps their ids in
one array; a batch's ids are then gathered from it by the stretches' numbers. When
the store has ``HELD`` stretches or ``POOL`` ids it keeps those that several batches
held and forgets the others, which bounds its memory.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

HELD, POOL = 300_000, 1 << 22
LONG = 64  # longer stretches are not kept

#: What the pattern languages of both tokenizer libraries call white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u024f"
_SIGNS = "!-&(-/:-@\\[-`{-~"  # ASCII without the apostrophe
_WORD = f"[{_LETTERS}]++(?![^{WHITE}{_SIGNS}])"
_MARKS = f"[{_SIGNS}]++(?![^{WHITE}{_LETTERS}])"
#: Letters before white space or signs; signs before white space or letters; any other rest of a word; each with the white space before it, and white space that ends a text.
LED = re.compile(f"[{WHITE}]*+(?:{_WORD}|{_MARKS}|[^{WHITE}]+)|[{WHITE}]+")
_WORDS_ONLY = re.compile("[" + "".join(c for c in map(chr, range(0x250)) if re.match(f"[{_LETTERS}]", c) and c == c.lower()) + "]+")  # as they are in lower case


class _Numbers(dict):
    """Numbers of stretches; a new one gets the next number and is noted."""

    def __init__(self):
        self.fresh: list[str] = []
        self.next = 0

    def __missing__(self, stretch: str) -> int:
        number = self[stretch] = self.next
        self.next += 1
        self.fresh.append(stretch)
        return number


class _Store:
    """Ids of numbered stretches in one array."""

    def __init__(self, tokenizer: Tokenizer, held: int = HELD):
        self.tokenizer, self.held = tokenizer, held
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.met = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def _renew(self) -> None:
        """Forget stretches that one batch alone has held, and as many others as leave at least half of the room."""
        known = np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        met, length = self.met[known], self.length[known]
        order = np.argsort(-met, kind="stable")
        order = order[(np.arange(len(order)) < self.held // 2) & (np.cumsum(length[order]) < POOL // 2) & (met[order] > 1)]
        stay = np.zeros(len(known), bool)
        stay[order] = True
        ids, cuts = self._gather(known[stay], np.arange(1, stay.sum() + 1))
        words = [w for w, s in zip(self.numbers, stay) if s]
        self._clear()
        self.numbers.update(zip(words, range(len(words))))
        self.numbers.next, self.learned = len(words), 0
        self._put(ids, np.diff(cuts))

    def _ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each stretch has)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _begin(self) -> None:
        if self.numbers.next > self.held or self.used > POOL:
            self._renew()
        self.learned = self.numbers.next

    def _learn(self) -> None:
        """The ids of all stretches that got a number since ``_begin``."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        for at in range(0, len(fresh), 20_000):
            self._put(*self._ids(fresh[at : at + 20_000]))
        for s in fresh:
            if len(s) > LONG:
                del self.numbers[s]

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        first = self.learned
        self.learned += len(lengths)
        while self.learned > len(self.start):
            self.start, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.met))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.length[first : self.learned] = lengths
        self.start[first : self.learned] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gather(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered stretches, and where those of each text begin; text i ends before stretch ``ends[i]``."""
        lengths = self.length[codes]
        upto = np.cumsum(lengths, dtype=np.int64)
        total = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if total < 1 << 30 else np.int64  # half the memory, but for enormous texts
        cuts = np.concatenate([[0], upto])[np.concatenate([[0], ends]).astype(np.int64)]
        first = self.start[codes].astype(kind)
        first -= upto.astype(kind)
        first += lengths
        places = np.repeat(first, lengths)
        places += np.arange(total, dtype=kind)
        return self.pool[places], cuts


class ChunkedEncoder(_Store):
    """For tokenizers that keep white space: a text is cut by the pattern ``stretch``."""

    def __init__(self, tokenizer: Tokenizer, stretch: re.Pattern):
        super().__init__(tokenizer)
        self.stretch = stretch

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin in it."""
        self._begin()
        find, number = self.stretch.findall, self.numbers.__getitem__
        coded = [np.fromiter(map(number, found), np.int64, len(found)) for found in map(find, texts)]
        self._learn()
        codes = np.concatenate(coded) if coded else np.zeros(0, np.int64)
        self.met[np.unique(codes)] += 1
        return self._gather(codes, np.cumsum([len(c) for c in coded]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[k for k in range(0x80) if re.match(f"[{_SIGNS}]", chr(k))]] = True
_RUN = 8  # longer runs of signs are not cut off


class WordEncoder(_Store):
    """For tokenizers that drop white space, lower-case, and mark each word's last token with ``word_end``.

    A batch's texts are cut at ASCII white space by Arrow; on the words' bytes A-Z
    become a-z and a short run of signs after a last letter becomes a word of its own,
    as the library would cut it off, too; then each distinct word is looked up once. Words
    with combining marks, which may compose otherwise in lower case, stay as they
    are. A text that holds one of the tokenizer's added tokens, which may reach
    across words, is given to the library whole.
    """

    def __init__(self, tokenizer: Tokenizer, word_end: str, held: int = HELD):
        super().__init__(tokenizer, held)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(word_end)]] = True
        added = tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.letters = self._alone()
        self.whole = any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added)  # matched in other ways than as they are

    def _alone(self) -> Tokenizer:
        """The tokenizer for words of lower-case Latin letters: neither its normalizer nor its splitter changes these, so they are left out."""
        spec = json.loads(self.tokenizer.to_str())
        stages = spec["pre_tokenizer"] or {}
        stages = stages["pretokenizers"] if stages.get("type") == "Sequence" else [stages]
        spec["normalizer"], spec["added_tokens"], spec["post_processor"] = None, [], None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in stages if x.get("type") == "ByteLevel")]}
        return Tokenizer.from_str(json.dumps(spec))

    def _ids(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], np.zeros(len(stretches), np.int64)
        plain = [k for k, s in enumerate(stretches) if _WORDS_ONLY.fullmatch(s)]
        together = np.zeros(len(stretches), bool)
        together[plain] = True
        # words of letters go in by the hundred: each ends with its one marked token
        lines = [" ".join([stretches[k] for k in plain[i : i + 100]]) for i in range(0, len(plain), 100)]
        got = [np.array(e.ids, np.uint32) for e in self.letters.encode_batch_fast(lines, add_special_tokens=False)]
        words = np.concatenate(got) if got else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[words])
        if len(last) != len(plain):
            raise ValueError("the tokenizer does not end each word with one marked token")
        lengths[plain] = np.diff(last, prepend=-1)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([s for s, t in zip(stretches, together) if not t], add_special_tokens=False)]
        lengths[~together] = [len(o) for o in others]
        ids = np.zeros(int(lengths.sum()), np.uint32)
        of = np.repeat(together, lengths)
        ids[of] = words
        ids[~of] = [i for o in others for i in o]
        return ids, lengths

    def _words(self, words: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words in lower case with last signs cut off, and where each text's end; ``offsets`` are those of the texts in ``words``."""
        _, at, data = words.buffers()
        kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
        at = np.frombuffer(at, kind, count=len(words) + 1, offset=words.offset * kind().itemsize).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        low = _LOWER[raw]
        marked = raw >= 0xCC
        if marked.any():  # back to what they were
            held = np.add.reduceat(np.append(marked, False), at[:-1], dtype=np.int64) * (np.diff(at) > 0) > 0
            low = np.where(np.repeat(held, np.diff(at)), raw, low)
        size = np.diff(at)
        stop = np.zeros(len(size), bool)
        begin = np.zeros(len(size), np.int64)  # of the signs that a word ends with
        some = np.flatnonzero(size > 1)
        some = some[_SIGN[low[at[1:][some] - 1]]]
        place = at[1:][some] - 1
        for _ in range(_RUN):
            before = low[place - 1]
            ended = _LETTER[before]
            stop[some[ended]], begin[some[ended]] = True, place[ended]
            on = _SIGN[before] & (place - 1 > at[some])
            some, place = some[on], place[on] - 1
        # signs are a word after the word they end
        ends = np.insert(at[1:], np.flatnonzero(stop), begin[stop])
        cut = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(low))
        return cut, offsets[1:] + np.concatenate([[0], np.cumsum(stop)])[offsets[1:]]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin in it. No text is null."""
        odd = np.full(len(texts), self.whole)
        for token in self.added:
            odd |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        self._begin()
        split = pc.ascii_split_whitespace(plain)
        words, ends = self._words(split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64))
        coded = words.dictionary_encode()
        held = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.numbers.__getitem__, held), np.int64, len(held))
        self._learn()
        self.met[codes] += 1
        ids, cuts = self._gather(codes[coded.indices.to_numpy()], ends)
        if not odd.any():
            return ids, cuts
        whole = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(odd)}
        parts = [whole[i] if i in whole else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
