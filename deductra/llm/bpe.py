"""BPE encoding by dynamic programming over prefixes, and decoding.

Each prefix of a word has exactly one BPE encoding, and that has exactly one last token.
An automaton over the vocabulary reports, by following its suffix links, every token that
ends at a place; of these the last token is the one that may follow the last token of what
is in front of it (``Vocabulary.compatible`` undoes merges on both sides to tell whether
two neighbours would have merged otherwise). Back-pointers give the ids.

The vocabulary file's normalisation and word splitting (NFC, lower case, words of letters,
single digits, runs of other signs, English contractions) are done here too; special tokens
are found in the raw text first. Words are independent, so each worker keeps a bounded
cache of them.

Defined results. Null text: no tokens, empty decoded text. Special tokens inside texts are
encoded as such. Lone surrogates can't occur in Spark strings. Rows are independent: ties,
repeated rows, null ids and further columns need no rule; an empty table gives an empty one.
Very long texts: a task holds one text's words and ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._spark import doc_id, keyed, small_batches

#: Words that a worker remembers at most.
CACHED = 400_000
END = "Ā"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        kinds = [bytes([i]) for i in range(256)]
        letters, digits, spaces = (b"".join(re.escape(c) for c in kinds if regex.fullmatch(p, c.decode("latin-1"))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self._narrow = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[" + letters + b"]+|[" + digits + b"]|[^" + spaces + letters + digits + b"]+")
        suffix = model["end_of_word_suffix"]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in model["merges"]:
            whole = self.ids[a + b]
            x, y = self.ids[a], self.ids[b]
            if whole in self.left:
                raise ValueError("a token with two merges")
            self.left[whole], self.right[whole] = x, y
            self.pairs[x, y] = whole
        if any(w <= max(x, y) for (x, y), w in self.pairs.items()):
            raise ValueError("ids don't follow the merges' order")
        self._compatible: dict[tuple[int, int], bool] = {}
        self.proper = {}
        for i in sorted(self.names):
            x = self.left.get(i)
            self.proper[i] = x is None or self.proper[x] and self.proper[self.right[i]] and self._follows(x, self.right[i], i)
        byte_of = _byte_of_sign()
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if self.proper[i]:
                body, end = (s[: -len(suffix)], END) if s.endswith(suffix) and len(s) > len(suffix) else (s, "")
                key = "".join(byte_of[c] for c in body) + end
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()

    def _follows(self, x: int, y: int, limit: int) -> bool:
        """Whether no merge ranked below ``limit`` joins what ends ``x`` with what begins ``y`` before these are whole."""
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            whole = pairs.get((x, y))
            if whole is not None and whole < limit:
                return False
            if x > y:
                limit = x
                if x not in right:  # a single byte: look at the other side
                    if y not in left:
                        return True
                    limit, y = y + 1, left[y]
                else:
                    x = right[x]
            else:
                limit = y + 1
                if y not in left:
                    if x not in right:
                        return True
                    limit, x = x, right[x]
                else:
                    y = left[y]

    def compatible(self, x: int, y: int) -> bool:
        """Whether ``y`` may stand next to ``x`` in an encoding."""
        known = self._compatible.get((x, y))
        if known is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            known = self._compatible[x, y] = self._follows(x, y, 1 << 30)
        return known

    def encode_word(self, word: str | bytes) -> list[int]:
        """Ids of one word; bytes are Latin-1."""
        if isinstance(word, bytes):
            word = word.decode("latin-1")
        if word in self.special:
            return [self.special[word]]
        signs = word.encode("utf-8", "replace").decode("latin-1") + END
        last = [-1] * (len(signs) + 1)
        size = [0] * (len(signs) + 1)
        for end, (token, length) in self.automaton.iter(signs):
            end += 1
            start = end - length
            if start == 0 or last[start] >= 0 and self.compatible(last[start], token):
                last[end], size[end] = token, length
        out, at = [], len(signs)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Words of a text in order, special tokens among them."""
        if self._special is None or self._special.search(text) is None:
            return self._words.findall(_normal(text))
        out = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._words.findall(_normal(part))
        return out


    def keys(self, text: str) -> list:
        """Like ``words``; the words of a text within Latin-1 (all of it NFC) as Latin-1 bytes, which are found faster."""
        if self._special is None or self._special.search(text) is None:
            try:
                return self._narrow.findall(text.lower().encode("latin-1"))
            except UnicodeEncodeError:
                pass
        return self.words(text)


def _normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: letters are lowered one by one
    return text.lower()


def _byte_of_sign() -> dict[str, str]:
    """What the vocabulary writes for each byte, back to a sign of that code."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        signs[chr(256 + n)] = chr(b)
    return signs


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


class _Forms(dict):
    """Word -> number of ids, ids as text, decoded text."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def __missing__(self, word: str | bytes):
        ids = self.v.encode_word(word)
        form = self[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.v.names[i] for i in ids]))
        return form


@functools.lru_cache(maxsize=2)
def _forms(path: str) -> _Forms:
    return _Forms(vocabulary(path))


def encode(text: str | None, path: str | None = None) -> list[int]:
    """Ids of a text."""
    v = vocabulary(path or default_path())
    return [i for w in v.words(text or "") for i in v.encode_word(w)]


def decode(ids: list[int], path: str | None = None) -> str:
    """Text of ids; the file names no decoder, so tokens are joined by spaces."""
    names = vocabulary(path or default_path()).names
    return " ".join([names[i] for i in ids if i in names])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, forms = vocabulary(path), _forms(path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0), b.column(1)):
                if len(forms) > CACHED:
                    forms.clear()
                found = [forms[w] for w in v.keys(text.as_py() or "")]
                n, ids, decoded = zip(*found) if found else ((), (), ())
                out.append((doc.as_py(), sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode()).hexdigest()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = keyed(docs).mapInArrow(run, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(doc_id(), "n_tokens", "ids_sha256", "decoded_sha256")
