"""Word pieces by the `tokenizers` library, each distinct pre-token once.

A pre-token here is what stands between white space, apart from punctuation behind its last letter, and
in lower case if it is Latin. For tokenizers that drop white space and lower-case texts, as
word_bpe_49k.json does, the ids of a text are those of its pre-tokens and punctuation in order. Strings that
hold a special token's mark are left as they are; the library treats them by its default.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa

from subspark.functions.memory import HELD

#: Words and pre-tokens that a worker remembers: so many of the first that it meets, and later, up to CACHE, those that it meets again.
CORES, CACHE = 100_000, 300_000
#: Places where a hash tells that a word was met.
MET = 1 << 22
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 22
#: Pre-tokens that are encoded as one string.
JOINED = 100
#: Characters of a text that are split at once.
SLICE = 1 << 20
#: Python splits here, the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[ \t\n\x0b\x0c\r]+")
MARK = "<|"
#: ASCII punctuation.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read(path: str | None) -> str:
    """The tokenizer's file as a string, to be broadcast: executors need not have the file."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def words(text: str) -> Iterator[list[str]]:
    """Lists of what stands between white space, in order."""
    start = 0
    while start < len(text):
        end = start + SLICE
        if end < len(text):
            cut = _SPACES.search(text, end)
            end = cut.start() if cut else len(text)
        part = text[start:end]
        yield [w for w in _SPACES.split(part) if w] if _ODD.search(part) else part.split()
        start = end


def _ends_in_letter(base: str) -> bool:
    """Whether it does for the library, which takes NFC and lower case first: some letters become a letter and a mark
    there, and the mark goes with the signs behind it."""
    return _is_letter(base[-1])


@lru_cache(10_000)
def _is_letter(last: str) -> bool:
    if last.isascii():
        return last.isalpha()
    return last.isalpha() and unicodedata.normalize("NFC", last).lower()[-1].isalpha()


def core(word: str) -> tuple[str, str]:
    """The pre-token, and the signs after its last letter, if any; those are a pre-token of their own."""
    if MARK in word:
        return word, ""
    base = word.rstrip(SIGNS)
    signs = word[len(base) :]
    if not base or signs and not _ends_in_letter(base):
        base, signs = word, ""
    return base.lower() if base.isascii() else base, signs


class Pieces:
    """Ids of pre-tokens, remembered."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {"": b""}
        self.met = bytearray(MET)

        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def encode(self, tokens: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each. Tokens of letters only are one pre-token each for the library too, so that
        they can be encoded together: an id that ends a word ends each of them."""
        plain = [t for t in tokens if t.isalpha()] if self.ends.any() else []
        found: dict[str, bytes] = {}
        parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                continue
            raw, stops = ids.tobytes(), (4 * stops).tolist()
            found.update((t, raw[x:y]) for t, x, y in zip(part, [0, *stops], stops, strict=False))
        rest = [t for t in tokens if t not in found]
        if rest:
            single = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
            found.update((t, np.array(e.ids, "<u4").tobytes()) for t, e in zip(rest, single, strict=True))
        return [found[t] for t in tokens]

    def _remember(self, found: dict[str, bytes]) -> None:
        known, met = self.known, self.met
        for word, ids in found.items():
            if len(known) < CORES:
                known[word] = ids
            elif len(known) < CACHE:
                place = hash(word) % MET
                if met[place]:
                    known[word] = ids
                met[place] = 1
            else:
                return

    def _learn(self, unknown: list[str]) -> list[bytes]:
        """Ids of distinct words. A pre-token has the same ids as a word, so that both are remembered together."""
        known = self.known
        parts = [(w.lower() if w.isascii() else w, "") if w.isalpha() else core(w) for w in unknown]
        found = [known.get(base) for base, _ in parts]
        signs = {after for _, after in parts}
        new = list({base for (base, _), x in zip(parts, found, strict=True) if x is None} | {after for after in signs if after not in known})
        coded = dict(zip(new, self.encode(new), strict=True))
        ends = {after: coded[after] if after in coded else known[after] for after in signs}
        out = [(coded[base] if x is None else x) + ends[after] for (base, after), x in zip(parts, found, strict=True)]
        self._remember(coded | dict(zip(unknown, out, strict=True)))
        return out

    def _of_words(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.known.get, distinct))
        unknown = [w for w, x in zip(distinct, found, strict=True) if x is None]
        learnt = iter(self._learn(unknown) if unknown else ())
        return [next(learnt) if x is None else x for x in found]

    def ids(self, text: str) -> bytes:
        return b"".join(self._together([some])[0] for some in words(text))

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """ids of each text; words of many texts are looked up together, each distinct one once."""
        out, group, n = [], [], 0
        for text in texts:
            if len(text) >= SLICE:
                out += self._together(group)
                out.append(self.ids(text))
                group, n = [], 0
                continue
            group.append(next(words(text), []))
            n += len(text)
            if n >= TOGETHER:
                out += self._together(group)
                group, n = [], 0
        return out + self._together(group)

    def _together(self, group: list[list[str]]) -> list[bytes]:
        coded = pa.array(chain.from_iterable(group), pa.string()).dictionary_encode()
        if not len(coded):
            return [b""] * len(group)
        of = self._of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, of), np.int64, len(of)) // 4
        starts, each = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(each)
        place = np.repeat(starts[at] - ends + each, each) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(of), "<u4")[place].tobytes()
        bounds = (4 * np.append(0, ends)[list(accumulate(map(len, group), initial=0))]).tolist()
        return [raw[low:high] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]


_made: dict[int, Pieces] = {}
#: Stays from task to task, until a task of another kind ends in the worker.
HELD.append(_made)


def pieces(spec: str) -> Pieces:
    """One for each worker process."""
    if hash(spec) not in _made:
        _made[hash(spec)] = Pieces(spec)
    return _made[hash(spec)]


def held() -> dict[int, Pieces]:
    return _made
