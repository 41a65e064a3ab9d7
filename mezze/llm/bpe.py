"""BPE encoding and decoding by prefix-sharing trie traversal.

The last token of a prefix's encoding decides everything before it, and a token may follow another exactly if the two of
them are the encoding of their joined text. So each prefix needs one state, the length of its last token, and words that
share a prefix share its states. A task gathers the distinct words of a chunk, walks their trie depth-first (sorted words
are the trie in that order, a common prefix is the path two words share) and computes each node's state once. Words that a
worker has met before come from a bounded cache.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of text that a worker splits into words at a time.
CHUNK = 1 << 20
#: Words in each of the two generations of a worker's cache.
CACHE = 300_000
#: Remembered answers on whether a token may follow another.
PAIRS = 1_000_000
SUFFIX = "</w>"


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def chunks(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[list[str]]:
    """Runs of whole texts of about `most` characters; a longer text is a run of its own."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text or "") > most:
            yield run
            run, size = [], 0
        run.append(text or "")
        size += len(text or "")
    if run:
        yield run


#: Classes in pre-token patterns, as `regex` has them, and their first members, which are the same everywhere.
CLASSES = {r"\s": (r"\p{White_Space}", r"\x20"), r"\p{L}": (r"\p{L}", "A-Za-z"), r"\p{N}": (r"\p{N}", "0-9")}


@cache
def differences(name: str) -> tuple[list[int], list[int]]:
    r"""Characters that `regex` has in \s, \p{L} or \p{N} and the `tokenizers` library, of an older Unicode, has not, and the reverse."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # What a newer Unicode leaves unassigned or to private use, an older one does too.
    every = regex.sub(r"[\p{Cn}\p{Co}]+", "", "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))))
    runs = Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(every)
    theirs, ours = set("".join([run for run, _ in runs])), set("".join(regex.findall(CLASSES[name][0] + "+", every)))
    return sorted(map(ord, ours - theirs)), sorted(map(ord, theirs - ours))


def ranges(numbers: list[int]) -> str:
    """Ascending code points as ranges of a set."""
    starts = [n for i, n in enumerate(numbers) if not i or numbers[i - 1] != n - 1]
    ends = [n for i, n in enumerate(numbers) if i + 1 == len(numbers) or numbers[i + 1] != n + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Words:
    """A pre-token pattern of the library, which finds what the library finds.

    The classes of `regex` serve up to the first character on which the two differ; texts with a character from there on
    are matched with classes that are mended by the differences.
    """

    def __init__(self, pattern: str):
        quick, exact, first = pattern.replace(r"\S", r"[^\s]"), pattern.replace(r"\S", r"[^\s]"), 0x10FFFF
        for name, (own, usual) in CLASSES.items():
            less, more = differences(name)
            first = min([first, *less[:1], *more[:1]])
            mended = f"[{own}--[{ranges(less)}]]" if less else own
            quick, exact = quick.replace(name, own), exact.replace(name, f"[{usual}{mended}{ranges(more)}]")
        if regex.search(r"\\[^pxU]", quick):
            raise ValueError(f"the pattern {pattern} has classes that are not known")
        self.quick, self.exact = regex.compile(quick), regex.compile(exact, regex.V1)
        self.rare = regex.compile(f"[\\U{first:08x}-\\U0010ffff]")

    def findall(self, text: str) -> list[str]:
        return (self.quick if text.isascii() or not self.rare.search(text) else self.exact).findall(text)


class Specials:
    """Added tokens of a vocabulary file, cut out of texts before anything else, the longest first."""

    def __init__(self, added: list[dict], normalizes: bool):
        for token in added:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"] and normalizes:
                raise ValueError(f"the added token {token['content']!r} is matched in a way that is not known here")
        self.ids = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.ids, key=len, reverse=True))) + ")")
        self.mark = os.path.commonprefix(list(self.ids))

    def split(self, text: str) -> list[str]:
        """Text and added tokens in turn, text first."""
        return self.cut.split(text) if self.ids and self.mark in text else [text]


class Bpe:
    """A BPE vocabulary with word ends, read from the file of the `tokenizers` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.lowers = self.normalizer is not None and all(self.normalizer.normalize_str(c) == c.lower() for c in map(chr, range(33, 127)))
        self.words = Words(next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"])
        self.specials = Specials(spec["added_tokens"], self.normalizer is not None)
        self.special = self.specials.ids
        vocab = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ids = vocab
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(SUFFIX)}
        self.final = {t.removesuffix(SUFFIX): i for t, i in vocab.items() if t.endswith(SUFFIX)}
        # Lengths of the tokens that end with two given letters, long ones first: what could end at a node.
        self.lengths = [self.by_ending(self.inner), self.by_ending(self.final)]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(spec["model"]["merges"])}
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.follows: dict[tuple[str, str, bool], bool] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def by_ending(tokens: Iterable[str]) -> dict[str, list[int]]:
        found: dict[str, set[int]] = {}
        for token in tokens:
            if len(token) > 1:
                found.setdefault(token[-2:], {1}).add(len(token))
        return {k: sorted(v, reverse=True) for k, v in found.items()}

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges in their order of rank, leftmost first; only ever needed for two tokens at a time."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, a: str, b: str, ends: bool) -> bool:
        """Whether `a` then `b` are the encoding of their joined text; with an empty `a`, whether `b` is its own encoding."""
        found = self.follows.get((a, b, ends))
        if found is None:
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            symbols = [*a, *b]
            if ends:
                symbols[-1] += SUFFIX
                b += SUFFIX
            found = self.follows[a, b.removesuffix(SUFFIX) if ends else b, ends] = self.merged(symbols) == ([a, b] if a else [b])
        return found

    def last_token(self, word: str, end: int, last: list[int], ends: bool) -> int:
        """Length of the last token of the first `end` letters, given the states of all shorter prefixes."""
        known, follows = self.final if ends else self.inner, self.follows
        for n in self.lengths[ends].get(word[max(0, end - 2) : end], (1,)):
            start = end - n
            if start >= 0 and (token := word[start:end]) in known:
                before = word[start - last[start] : start]
                found = follows.get((before, token, ends))
                if found or found is None and self.may_follow(before, token, ends):
                    return n
        raise ValueError(f"the vocabulary has no encoding of {word[:end]!r}")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word and its ids, in the depth-first order of their trie."""
        before, last = "", [0]
        for letters, word in sorted((w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters), w) for w in words):
            shared = 0
            for x, y in zip(letters, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(len(last), len(letters)):
                last.append(self.last_token(letters, end, last, False))
            n = self.last_token(letters, len(letters), last, True)
            at = len(letters) - n
            ids = [self.final[letters[at:]]]
            while at:
                ids.append(self.inner[letters[at - last[at] : at]])
                at -= last[at]
            yield word, ids[::-1]
            before = letters[: len(last) - 1]

    def split(self, text: str) -> list[str]:
        """The text's words and special tokens in order."""
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self.words.findall(self.normal(part))
        return out

    def normal(self, text: str) -> str:
        """As the file's normalizer leaves the text, but for white space, which no word holds."""
        if self.lowers and text.isascii():
            return text.lower()
        return self.normalizer.normalize_str(text) if self.normalizer else text

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """A cache that has all of `words`: their ids as little-endian 32-bit numbers, and their decoded text."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = words - young.keys()
        for w in new & old.keys():
            young[w] = old[w]
        fresh = new - old.keys()
        for w in fresh & self.special.keys():
            young[w] = (self.special[w].to_bytes(4, "little"), w)
        for w, ids in self.encode_words(fresh - self.special.keys()):
            young[w] = (b"".join(i.to_bytes(4, "little") for i in ids), self.decode(ids))
        return young

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space, as the library does for a vocabulary without a decoder."""
        return " ".join(self.tokens[i] for i in ids)


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One vocabulary for each worker and path."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded: whole texts encoded without added special tokens, and decoded again.

    A null or empty text has no ids and decodes to the empty text. Strings of special tokens in a text become those tokens.
    One row per input row. `path` is the vocabulary file; every executor has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            doc_ids, at = batch.column(0), 0
            for texts in chunks(x.as_py() for x in batch.column(1)):
                split = [bpe.split(t) for t in texts]
                known = bpe.learn(set().union(*split))
                raw, ends, decoded = [], [0], []
                for words in split:
                    entries = [known[w] for w in words]
                    raw.append(b"".join([e[0] for e in entries]))
                    ends.append(ends[-1] + len(raw[-1]) // 4)
                    decoded.append(" ".join([e[1] for e in entries]))
                ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(raw))])
                yield pa.record_batch([doc_ids.slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
