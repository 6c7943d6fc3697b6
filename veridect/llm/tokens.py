"""Token ids of whole texts, by way of a cache of words.

A tokenizer that splits a text before its merges gives a word the same ids
wherever it stands. So a text is cut at places where every such tokenizer cuts,
and the tokenizers library only sees words that are not in the cache yet.
Texts with white space that the cut does not cover go through it whole, and so
do texts that hold the string of an added token, which the library reads as that
token unless ``literal`` makes it plain text.

For a byte-level vocabulary, texts that fall apart into ``STRETCHES`` with
certainty are cut and looked up as arrays of bytes, many texts at once.
"""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache
from itertools import compress
from unicodedata import is_normalized

import numpy as np

from veridect.llm.frames import ByteBoundCache, remembers
from veridect.llm.word_table import MOST, PAD, WordTable, gathered, keys

# White space beyond space, tab, line feed and return, and controls that Python but not every pattern counts as such.
UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
RUNS = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
CACHE_BYTES = 160 << 20
# Letters that are cut off from all that is no letter, and what a text must not hold for these cuts to be
# certain: spaces or line feeds side by side or at the end, other white space, other letters and digits, a mark before which a contraction can begin.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
STRETCHES = re.compile(f" ?[{LETTER}]+(?:'[{LETTER}]+)*| ?[^{LETTER} \n]+|\n+")
UNCERTAIN = re.compile(f"  | \n|\n |[ \n]$|[^\\S \n]|[^\\W0-9_{LETTER}]|(?<![{LETTER}])'(?=[{LETTER}])")
# Characters of which a text may be made without a closer look, none of which normal forms or lower case change into several.
PLAIN = re.compile("[^A-Za-zÀ-ÖØ-öø-įı-ɏ0-9 \n!-/:-@\\[-`{-~–—‘-„…«»¿¡]")
APOSTROPHE = re.compile(f"(?<![{LETTER}])'(?=[{LETTER}])")
BULK_WORDS = 500
MARKS = ",.;:!?"
#: Bytes of text cut and looked up at a time, so that the working arrays stay small.
CUT_BYTES = 1 << 20
# A byte that UTF-8 never has, to stand between texts, and what a byte is to the cuts.
BETWEEN = b"\xff"
OTHER, IN_WORD, SPACE, LINE_FEED, END = range(5)
KINDS = np.full(256, OTHER, dtype=np.uint8)
KINDS[[*map(ord, string.ascii_letters), *range(0xC3, 0xCA)]] = IN_WORD
KINDS[[ord(" "), ord("\n"), BETWEEN[0]]] = SPACE, LINE_FEED, END


def stretch_starts(data: np.ndarray) -> np.ndarray:
    """Where the ``STRETCHES`` of certain texts begin, and where each text ends; ``data`` has ``BETWEEN`` around each text."""
    kind = KINDS[data]
    # letters beyond ASCII have two bytes, the first of which is one of seven
    lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
    if len(lead):
        first, second = data[lead], data[lead + 1]
        none = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F)
        kind[lead + 1] = IN_WORD
        kind[lead[none]] = kind[lead[none] + 1] = OTHER
    mark = np.flatnonzero(data == ord("'"))
    kind[mark[(kind[mark - 1] == IN_WORD) & (kind[mark + 1] == IN_WORD)]] = IN_WORD
    before, here = kind[:-1], kind[1:]
    starts = here != before
    starts &= before != SPACE
    starts |= here == SPACE
    starts |= here == END
    return np.flatnonzero(starts) + 1


def certain(text: str, plain: bool | None = None) -> bool:
    """Whether a text of some length falls apart into ``STRETCHES`` with certainty; ``plain`` says that it has ``PLAIN`` characters only."""
    if not plain and (plain is False or PLAIN.search(text)):
        return not UNCERTAIN.search(text)
    return not (text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "'" in text and APOSTROPHE.search(text))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    New words go through the library many at a time, as one text. Where white
    space yields ids (byte-level vocabularies), the bytes that each id stands
    for tell where a word ends; otherwise the ids that close a word do.
    ``first`` holds words at the start of a text, ``rest`` words behind a space.
    """

    def __init__(self, path: str, literal: bool = False, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaces = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.size[number] = len(token) if self.spaces else token.endswith("</w>")
        # a byte-level vocabulary needs the first two for texts without certain cuts alone
        self.first = ByteBoundCache(cache_bytes // 8)
        self.rest = ByteBoundCache(cache_bytes // (8 if self.spaces else 1))
        # words too long for the table, and line feeds
        self.parts = ByteBoundCache(cache_bytes // 8)
        self.table = WordTable(cache_bytes // 2)

    def _one(self, text: str) -> bytes:
        return self._all([text])[0]

    def _all(self, texts: list[str]) -> list[bytes]:
        return [np.array(c.ids, dtype="<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, words: list[str], lead: str, into: dict[str, bytes]) -> None:
        """Ids of words that are cut off from what is before and behind them, each behind ``lead``."""
        parts = [words[start : start + BULK_WORDS] for start in range(0, len(words), BULK_WORDS)]
        for part, coded in zip(parts, self._all([lead + lead.join(part) for part in parts]), strict=True):
            size = self.size[np.frombuffer(coded, "<u4")]
            if self.spaces:
                ends = np.cumsum(size)
                wanted = np.cumsum([len(lead) + len(w.encode()) for w in part])
                last = np.searchsorted(ends, wanted)
                whole = last[-1] + 1 == len(ends) and (ends[last] == wanted).all()
            else:
                last = np.flatnonzero(size)
                whole = len(last) == len(part) and last[-1] + 1 == len(size)
            if not whole:  # not what is expected of such words: ask for each by itself
                for word in part:
                    into[word] = self._one((lead if self.spaces and lead == " " else "") + word)
                continue
            skip = 4 * (self.spaces and lead == "\n")  # the line feed's own id
            at = 0
            for word, end in zip(part, (4 * (last + 1)).tolist(), strict=True):
                into[word] = coded[at + skip : end]
                at = end

    def stretches(self, words: list[str], behind_space: bool) -> list[bytes]:
        """Ids of words of a byte-level vocabulary that certain cuts set off, with a space before each or without one."""
        found: dict[str, bytes] = {}
        self._many(words, " " if behind_space else "\n", found)
        return [found[w] for w in words]

    def line_feeds(self, run: str) -> bytes:
        """Ids of line feeds before something else, which cuts the last one off."""
        return np.array(self.tokenizer.encode(run + "a", add_special_tokens=False).ids[:-1], dtype="<u4").tobytes()

    def _learn_stretches(self, wanted: set[str]) -> None:
        missing = self.parts.unknown(wanted)
        spaced = [s for s in missing if s[0] == " "]
        bare = [s for s in missing if s[0] not in " \n"]
        self.parts.update(zip(spaced, self.stretches([s[1:] for s in spaced], True), strict=True))
        self.parts.update(zip(bare, self.stretches(bare, False), strict=True))
        self.parts.update((s, self.line_feeds(s)) for s in missing if s[0] == "\n")

    def _learn_table(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Takes different short stretches of ``data``, whose keys are ``low`` and ``high``, into the table."""
        spaced, feed = data[start] == ord(" "), data[start] == ord("\n")
        # words without a space before them go behind a line feed, whose own id is left out
        for some, lead in ((np.flatnonzero(spaced), 0), (np.flatnonzero(~spaced & ~feed), 1)):
            parts = [some[at : at + BULK_WORDS] for at in range(0, len(some), BULK_WORDS)]
            texts = []
            for part in parts:
                text = gathered(data, start[part], length[part])
                if lead:
                    text = np.insert(text, np.cumsum(length[part]) - length[part], ord("\n"))
                texts.append(text.tobytes().decode())
            for part, coded in zip(parts, self._all(texts), strict=True):
                ids = np.frombuffer(coded, "<u4")
                ends = np.cumsum(self.size[ids])
                wanted = np.cumsum(length[part] + lead)
                last = np.searchsorted(ends, wanted)
                if last[-1] + 1 == len(ends) and (ends[last] == wanted).all():
                    begin = np.append(0, last[:-1] + 1) + lead
                    self.table.add(low[part], high[part], begin, last + 1 - begin, ids)
                else:  # not what is expected of such words: ask for each by itself
                    self._learn_each(self._one, data, start, length, low, high, part)
        self._learn_each(self.line_feeds, data, start, length, low, high, np.flatnonzero(feed))

    def _learn_each(self, ask, data, start, length, low, high, some) -> None:
        if len(some):
            coded = [ask(data[a : a + n].tobytes().decode()) for a, n in zip(start[some].tolist(), length[some].tolist(), strict=True)]
            count = np.array([len(c) // 4 for c in coded])
            self.table.add(low[some], high[some], np.cumsum(count) - count, count, np.frombuffer(b"".join(coded), "<u4"))

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that fall apart into ``STRETCHES`` with certainty."""
        self.table.settle()
        self.parts.settle()
        data = np.frombuffer(BETWEEN + BETWEEN.join(texts) + BETWEEN + PAD, dtype=np.uint8)
        start = stretch_starts(data[: -len(PAD)])
        length = np.diff(start, append=len(data) - len(PAD))
        end = data[start] == BETWEEN[0]
        # stretches up to the end of each text
        upto = np.flatnonzero(end)
        upto -= np.arange(len(upto))
        start, length = start[~end], length[~end]
        short = np.flatnonzero(length <= MOST)
        first, size = start[short], length[short]
        low, high = keys(data, first, size)
        value = self.table.find(low, high)
        missing = np.flatnonzero(value == 0)
        if len(missing):
            order = missing[np.lexsort((low[missing], high[missing]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            some = order[new]
            self._learn_table(data, first[some], size[some], low[some], high[some])
            value[missing] = self.table.find(low[missing], high[missing])
        begin, count = np.zeros((2, len(start)), dtype=np.int64)
        begin[short], count[short] = self.table.runs(value)
        long = np.flatnonzero(length > MOST).tolist()
        words = [data[start[k] : start[k] + length[k]].tobytes().decode() for k in long]
        self._learn_stretches(set(words))
        coded = [self.parts[w] for w in words]
        count[long] = [len(c) // 4 for c in coded]
        ids = gathered(self.table.pool, begin, count)
        ends = np.append(0, np.cumsum(count))
        for k, c in zip(long, coded, strict=True):
            ids[ends[k] : ends[k + 1]] = np.frombuffer(c, "<u4")
        joined, at = ids.tobytes(), (4 * ends[upto]).tolist()
        return [joined[a:b] for a, b in zip([0, *at], at, strict=False)]

    def _learn_bytes(self, needed: set[str], lead: str, known: dict[str, bytes]) -> None:
        missing = known.unknown(needed)
        # letters and the marks behind them never share an id
        bare = {w: b for w in missing if (b := w.rstrip(MARKS)) != w and b.isalpha() and (b.isascii() or max(b) < "\u0250")}
        plain = [w for w in missing if w not in bare]
        plain += {b for b in bare.values() if b not in known}.difference(plain)
        # a word with white space at either end, or none at all, would run into its neighbours
        self._many([w for w in plain if w and not w[0].isspace() and not w[-1].isspace()], lead, known)
        for word in plain:
            if word not in known:
                known[word] = self._one((" " if lead == " " else "") + word)
        for mark in {w[len(b) :] for w, b in bare.items()} - self.first.keys():
            self.first[mark] = self._one(mark)
        for word, b in bare.items():
            known[word] = known[b] + self.first[word[len(b) :]]

    def _learn_words(self, needed: set[str]) -> None:
        known = self.rest
        missing = known.unknown(needed)
        # the vocabulary's pattern sets letters apart from every run of marks behind them
        bare = {w: w.rstrip(string.punctuation) for w in missing}
        letters = {
            b
            for b in set(bare.values())
            if b not in known and b.isalpha() and (b.isascii() or b.lower().isalpha() and is_normalized("NFC", b))
        }
        self._many(list(letters), " ", known)
        marks = {w[len(b) :] for w, b in bare.items()} - known.keys() - {""}
        for mark in marks:
            known[mark] = self._one(mark)
        for word, b in bare.items():
            if word not in known:
                # letters and marks never share an id
                known[word] = known[b] + known[word[len(b) :]] if b in letters or b in known and b.isalpha() else self._one(word)

    def _simple(self, text: str) -> bool:
        """Whether every space but the first character stands between words."""
        return not ("  " in text or "\n " in text or "\t " in text or "\r " in text or text[:1] == " ")

    def __call__(self, texts: list[str | None], spaced: bool = False) -> list[bytes]:
        """Ids of each text, or with ``spaced`` of a space and the text."""
        self.first.settle()
        self.rest.settle()
        texts = [t or "" for t in texts]
        # plain characters hold no unusual white space
        plain = [not PLAIN.search(t) for t in texts]
        usual = [(p or not UNUSUAL.search(t)) and not any(a in t for a in self.added) for t, p in zip(texts, plain, strict=True)]
        if not self.spaces:  # a space before the text leaves no trace
            cut = [t.split() if u else [] for t, u in zip(texts, usual, strict=True)]
            self._learn_words(set().union(*cut))
            get = self.rest.__getitem__
            return [b"".join(map(get, words)) if u else self._one(t) for t, u, words in zip(texts, usual, cut, strict=True)]
        if spaced:
            texts = [" " + t for t in texts]
        cut = [bool(u and t and certain(t, p)) for t, u, p in zip(texts, usual, plain, strict=True)]
        others = iter(self._uncertain([t for t, c in zip(texts, cut, strict=True) if not c], [u for u, c in zip(usual, cut, strict=True) if not c]))
        known: list[bytes] = []
        some: list[bytes] = []
        held = 0
        for t in compress(texts, cut):
            some.append(t.encode())
            held += len(some[-1])
            if held >= CUT_BYTES:
                known += self._looked_up(some)
                some, held = [], 0
        if some:
            known += self._looked_up(some)
        ids = iter(known)
        return [next(ids) if c else next(others) for c in cut]

    def _uncertain(self, texts: list[str], usual: list[bool]) -> list[bytes]:
        """Ids by a byte-level vocabulary of texts that are cut at spaces, or not at all if they are unusual."""
        cut, first, rest = [], set(), set()
        for t, u in zip(texts, usual, strict=True):
            if not u:
                cut.append(None)
                continue
            simple = self._simple(t)
            words = t.split(" ") if simple else RUNS.findall(t)
            cut.append((simple, words))
            if simple:
                first.add(words[0])
                rest.update(words[1:])
            else:
                first.update(words)
        self._learn_bytes(first, "\n", self.first)
        self._learn_bytes(rest, " ", self.rest)
        begin, get = self.first.__getitem__, self.rest.__getitem__
        out = []
        for t, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(self._one(t))
            elif parts[0]:
                out.append(begin(parts[1][0]) + b"".join(map(get, parts[1][1:])))
            else:
                out.append(b"".join(map(begin, parts[1])))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, literal: bool = False, cache_bytes: int = CACHE_BYTES) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(path, literal, cache_bytes)


remembers("tokens", encoder.cache_clear)
