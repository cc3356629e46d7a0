"""BPE encoding and decoding by a prefix-sharing trie.

A word's encoding follows from its prefixes: every prefix has exactly one
valid encoding, and that is the encoding of a shorter prefix plus one *last
token*. The last token is the vocabulary entry that ends the prefix and that
stays apart from the token before it when the two are encoded together. So the
distinct words go into a trie, each node keeps its last token and the node
where that token begins, and the state is handed down depth-first: a prefix
that many words share is worked out once. Reading a word's ids is a walk from
its last node back to the root.

Defined results
  null text     encoded as the empty text: no ids, empty decoded text
  empty text    no ids, empty decoded text
  long text     encoded whole; per text the work is linear in its length; what a worker keeps
                between batches is bounded in bytes, also for texts without white space
  ties, copies  rows are independent; equal texts get equal results
  empty table   empty result with the same schema
  extra columns kept, except those named like a result column, which are replaced
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import aside, bounded_batches

END = "</w>"
#: Bytes of pieces that a worker remembers, twice over, before it forgets, and the longest piece it
#: remembers; pieces whose words share one trie, and texts that are learned from at once.
MAX_MEMO, MAX_PIECE, PER_TRIE, SLICE, SLICE_CHARS = 96 << 20, 64, 100_000, 1000, 4_000_000
#: Bytes that a remembered piece takes besides its characters and ids, about.
ENTRY = 200
#: Remembered pairs of tokens.
MAX_PAIRS = 300_000
#: Characters at which str.split() cuts though they are no white space to the tokenizer.
SEPARATORS = regex.compile("[\x1c-\x1f]").search


def _byte_alphabet() -> dict[int, str]:
    """Byte to printable character, as byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a word-level BPE file with end-of-word marks."""

    def __init__(self, path: str, max_memo: int = MAX_MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or spec.get("decoder"):
            raise ValueError("a BPE file with </w> word ends and no decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.words = regex.compile(pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.pieces = regex.compile(r"\S+").findall
        self.alphabet = _byte_alphabet()
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.max_memo = max_memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.apart: dict[tuple[str, str], bool] = {}
        #: tokens whose own encoding is themselves; only these can end a prefix
        self.whole = {t for t in self.ids if self._merge(self._symbols(t)) == [t]}

    # -- plain BPE, used for single tokens and for pairs of tokens only --

    def _merge(self, symbols: list[str]) -> list[str]:
        ranks = self.ranks
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), sys.maxsize))
            pair = (symbols[best], symbols[best + 1])
            if pair not in ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(END):
            body = token.removesuffix(END)
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether two tokens beside each other are a valid encoding."""
        if len(self.apart) >= MAX_PAIRS:
            self.apart.clear()
        known = not left or self._merge(self._symbols(left) + self._symbols(right)) == [left, right]
        self.apart[left, right] = known
        return known

    # -- the trie --

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """Ids (as 32-bit integers) of distinct words (spelled in the byte alphabet).

        Sorted words list a trie depth-first: a word enters it at the node
        where it leaves the word before. ``lasts`` and ``backs`` hold, for each
        node on the path from the root, its last token and the depth where that
        token begins; what lies above that node is not worked out again.
        """
        whole, apart, longest, ids = self.whole, self.apart, self.longest, self.ids
        out: dict[str, bytes] = {}
        lasts, backs, before = [""], [0], ""
        for word in sorted(words):
            size = len(word)
            depth, most = 0, min(size, len(before)) - 1
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del lasts[depth + 1 :], backs[depth + 1 :]
            start = backs[depth]
            while depth < size:
                depth += 1
                mark = END if depth == size else ""
                # one start is right, so the order only matters for speed: most last tokens grow by a
                # character or begin anew
                for start in (start, *range(start + 1, depth), *range(start - 1, max(-1, depth - longest - 1), -1)):
                    if (token := word[start:depth] + mark) in whole:
                        left = lasts[start]
                        if (ok := apart.get((left, token))) is None:
                            ok = self._stay_apart(left, token)
                        if ok:
                            break
                else:
                    raise AssertionError(f"no last token for {word[:depth]!r}")
                if mark:
                    found, at = [ids[token]], start
                    while at:
                        found.append(ids[lasts[at]])
                        at = backs[at]
                    out[word] = array("i", found[::-1]).tobytes()
                else:
                    lasts.append(token)
                    backs.append(start)
            before = word
        return out

    def normalized(self, text: str) -> str:
        return text.replace("Σ", "σ").lower()

    def _parts(self, text: str) -> list[tuple[bytes | None, list[str]]]:
        """The ids of a special token, or pieces without white space, in order.

        No word spans white space, so pieces between it can be looked up whole.
        """
        out: list[tuple[bytes | None, list[str]]] = []
        for part in self.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append((np.array([self.special[part]], np.int32).tobytes(), []))
                continue
            if not unicodedata.is_normalized("NFC", part):
                part = unicodedata.normalize("NFC", part)
            out.append((None, self.pieces(part) if SEPARATORS(part) else part.split()))
        return out

    def _words(self, chunk: str) -> list[str]:
        """Normalized words of a piece; letters with one mark after them need no pattern."""
        text = self.normalized(chunk)
        if text.isalpha():
            return [text]
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.words(text)

    def _learn(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """New pieces with their ids, by way of a trie of their distinct words."""
        for at in range(0, len(chunks), PER_TRIE):
            found = [(c, self._words(c)) for c in chunks[at : at + PER_TRIE]]
            spelled = {w: w if w.isascii() and w.isprintable() else "".join(map(self.alphabet.__getitem__, w.encode())) for _, ws in found for w in ws}
            ids = self.walk([*{*spelled.values()}])
            for chunk, words in found:
                yield chunk, b"".join([ids[spelled[w]] for w in words])

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. New words of all texts share a trie.

        Long pieces (texts without white space) are forgotten with the batch.
        """
        if self.held > self.max_memo:  # what is met again comes back from the older half
            self.memo, self.older, self.held = {}, self.memo, 0
        memo, older, met = self.memo, self.older, set()
        cut = [self._parts(text) for text in texts]
        for parts in cut:
            for _, chunks in parts:
                met.update(chunks)
        fresh = [c for c in met if c not in memo]
        memo.update((c, older[c]) for c in fresh if c in older)
        long = {}
        for chunk, ids in self._learn([c for c in fresh if c not in older]):
            (memo if len(chunk) <= MAX_PIECE else long)[chunk] = ids
        self.held += sum(4 * len(c) + len(memo[c]) + ENTRY for c in fresh if len(c) <= MAX_PIECE)
        find = memo.__getitem__ if not long else lambda c: long[c] if len(c) > MAX_PIECE else memo[c]
        for parts in cut:
            yield np.frombuffer(b"".join(ids if ids is not None else b"".join(map(find, chunks)) for ids, chunks in parts), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_batch([text]))

    def decode(self, ids) -> str:
        """Tokens of the ids with one space between, special tokens included."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.cache
def load(path: str) -> WordBpe:
    """The encoder for a file, once per Python process."""
    return WordBpe(path)


def slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts (null: empty) in lists of ``SLICE`` texts or ``SLICE_CHARS`` characters, about."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text.as_py() or "")
        size += len(some[-1])
        if len(some) >= SLICE or size >= SLICE_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of a text column and ``decoded``, the text of those ids."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            parts, ends, decoded = [np.empty(0, np.int32)], [0], []
            for some in slices(texts):
                for ids in bpe.encode_batch(some):
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids))
                    decoded.append(bpe.decode(ids.tolist()))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.StructArray.from_arrays([ids, pa.array(decoded, pa.string())], ["ids", "decoded"])

    bounded_batches(docs.sparkSession)
    docs, back = aside(docs, "__coded")
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    return docs.select(*kept, coded(docs[text]).alias("__coded")).select(*kept, "__coded.*").withColumnsRenamed(back)


def digest(found: DataFrame, *more: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents, and columns as they are."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
