"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The distinct words of a piece of the input form a trie, walked depth first. Each node holds the last token of the
encoding of its prefix and how many symbols that token has, so a prefix that many words share is encoded once. The
last token of a prefix p is the one suffix token t for which the pair (last token of p without t, t) is stable, that
is, for which no merge would cross the cut between the two. An automaton over the vocabulary names the suffix tokens of p,
so no other is tried; it takes some 19 MB a worker. A word's ids follow from the states on its path.

Text preparation is that of the tokenizer file: NFC, runs of white space to one blank, lower case, then pieces by the
file's split pattern, as bytes. Special tokens in the text become their ids, as in the tokenizers library.

Null or empty text: no ids. Every step is per row, so ties, repeated rows and empty tables need no care; rows pass with
all their columns, and a column named as an output is replaced. Texts are read in pieces cut at white space, so a very
long one needs memory for itself, its ids and one piece; what has no white space is one piece.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns

#: Words, and text pieces, whose encodings a Python worker keeps; pairs of tokens of which it knows whether they are
#: stable; and characters handled at once. Together some 120 MB a worker, given back when a task ends.
CACHE_WORDS = 300_000
CACHE_PAIRS = 150_000
PIECE_CHARS = 1 << 20
#: Bytes of text, one text at least, that are split and learnt together; their pieces are all held meanwhile.
BATCH_BYTES = 1 << 18
_END = "</w>"
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    spare = 0x100
    for b in range(256):
        if b not in shown:
            shown[b] = chr(spare)
            spare += 1
    return [shown[b] for b in range(256)]


@functools.cache
def _newer():
    """Characters that Python's Unicode tables don't know yet."""
    runs, first = [r"\U00040000-\U000dffff"], None  # planes without characters; those after plane 14 are for private use
    for c in [*range(0x80, 0x40001), *range(0xE0000, 0xF0001)]:
        unknown = c not in (0x40000, 0xF0000) and unicodedata.category(chr(c)) == "Cn"
        if unknown and first is None:
            first = c
        elif not unknown and first is not None:
            runs.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return re.compile(f"[{''.join(runs)}]")


@functools.cache
def _white_space():
    import regex

    return regex.compile(r"\p{White_Space}+")


class _Suffixes:
    """Automaton that reads symbols and knows, after each, the tokens that end there. A state is the longest suffix of what
    was read that some token begins with."""

    def __init__(self, inner: dict[str, int], final: dict[str, int]):
        self.go: list[dict[str, int]] = [{}]
        self.held: list[list[tuple[int, int] | None]] = [[None], [None]]  # inner and final token of a state's whole text, with its length
        for held, tokens in zip(self.held, (inner, final), strict=True):
            for s, token in tokens.items():
                at = 0
                for c in s:
                    if (then := self.go[at].get(c)) is None:
                        then = self.go[at][c] = len(self.go)
                        self.go.append({})
                        for kind in self.held:
                            kind.append(None)
                    at = then
                held[at] = (token, len(s))
        self.shorter = [0] * len(self.go)  # the state of the longest shorter suffix
        level = list(self.go[0].values())
        while level:
            for at in level:
                for c, then in self.go[at].items():
                    self.shorter[then] = self.after(self.shorter[at], c)
            level = [then for at in level for then in self.go[at].values()]
        leaf: dict[str, int] = {}
        self.go = [then or leaf for then in self.go]
        self.ending: tuple[dict, dict] = ({}, {})

    def after(self, state: int, symbol: str) -> int:
        while (then := self.go[state].get(symbol)) is None and state:
            state = self.shorter[state]
        return then or 0

    def tokens(self, state: int, final: bool) -> list[tuple[int, int]]:
        """Tokens that end in this state and their lengths, longest first."""
        held, at, found = self.held[final], state, []
        while at:
            if held[at] is not None:
                found.append(held[at])
            at = self.shorter[at]
        self.ending[final][state] = found
        return found


class WordBPE:
    """Encoder made from the text of a tokenizer file whose words end in a suffix."""

    def __init__(self, spec: str):
        import regex

        parsed = json.loads(spec)
        model = parsed["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError("a BPE file whose words end in </w> is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        # Tokens are known by (symbols, whether they end a word) and ranked by the order of the merges, base symbols first.
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for at, (left, right) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            token = vocab[left + right]
            pair = (vocab[left], vocab[right])
            self.rank.setdefault(token, at + 1)
            self.parts.setdefault(token, pair)
            self.joined.setdefault(pair, at + 1)
        inner: dict[str, int] = {}
        final: dict[str, int] = {}
        for s, i in vocab.items():
            (final.__setitem__(s[: -len(_END)], i) if s.endswith(_END) and len(s) > len(_END) else inner.__setitem__(s, i))
        self.suffixes = _Suffixes(inner, final)
        self.shown = byte_symbols()
        self.symbols = dict(enumerate(self.shown))
        split = next(p["pattern"]["Regex"] for p in parsed["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.stable_pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.spec, self.library = spec, None

    def _stable(self, left: int, right: int) -> bool:
        """Whether the encoding of left's and right's symbols together is these two tokens. The merges that made them are
        undone, latest first, along the cut; a merge across the cut that comes before the one undone would have won."""
        pair = left << 20 | right
        if (known := self.stable_pairs.get(pair)) is not None:
            return known
        rank, joined, parts = self.rank, self.joined, self.parts
        limit = float("inf")
        while True:
            across = joined.get((left, right))
            if across is not None and across < limit:
                found = False
                break
            left_rank, right_rank = rank.get(left, 0), rank.get(right, 0)
            if not left_rank and not right_rank:
                found = True
                break
            # Of merges of one rank the leftmost comes first, so right's own merge loses against an equal one across the cut.
            if left_rank > right_rank:
                limit, left = left_rank, parts[left][1]
            else:
                limit, right = right_rank + 1, parts[right][0]
        self.stable_pairs[pair] = found
        return found

    def learn(self, words: set[str], keep: bool = False) -> None:
        """Encode words not yet known: depth first through their trie, in sorted order; the stack is the path."""
        if not keep and len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        if len(self.stable_pairs) > CACHE_PAIRS:
            self.stable_pairs.clear()
        symbols_of, suffixes, stable, known_pair = self.symbols, self.suffixes, self._stable, self.stable_pairs.get
        go, shorter, tokens = suffixes.go, suffixes.shorter, suffixes.tokens
        inner, final = (ending.get for ending in suffixes.ending)
        # Plain letters stand for themselves.
        fresh = sorted((w if w.isascii() and w.isalpha() else w.encode("utf-8").decode("latin-1").translate(symbols_of), w) for w in words)
        lasts, starts, states = [-1], [0], [0]  # of the prefixes on the path
        before = ""
        for symbols, word in fresh:
            shared, most = 0, min(len(before), len(symbols) - 1, len(lasts) - 1)
            while shared < most and before[shared] == symbols[shared]:
                shared += 1
            del lasts[shared + 1 :], starts[shared + 1 :], states[shared + 1 :]
            state, depth = states[shared], shared
            # The last token is the longest suffix token that is stable beside what stands before it; the word's end has
            # tokens of its own.
            for symbol in symbols[shared:-1]:
                depth += 1
                while (then := go[state].get(symbol)) is None and state:
                    state = shorter[state]
                state = then or 0
                for token, size in inner(state) or tokens(state, False):
                    at = depth - size
                    if not at or (found if (found := known_pair((left := lasts[at]) << 20 | token)) is not None else stable(left, token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                lasts.append(token)
                starts.append(at)
                states.append(state)
            state, depth = suffixes.after(state, symbols[-1]), len(symbols)
            for token, size in final(state) or tokens(state, True):
                at = depth - size
                if not at or (found if (found := known_pair((left := lasts[at]) << 20 | token)) is not None else stable(left, token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            ids = [token]
            while at:
                ids.append(lasts[at])
                at = starts[at]
            self.known[word] = _PACK[len(ids)](*ids[::-1]) if len(ids) < len(_PACK) else np.array(ids[::-1], "<u4").tobytes()
            before = symbols

    def _words(self, chunk: str) -> list[str]:
        """The pieces of text without white space. Characters newer than this Python's Unicode tables go through the
        tokenizers library's own preparation, whose tables differ."""
        if chunk.isascii():
            return self.words_of(chunk.lower())
        if _newer().search(chunk):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.spec)
            plain = self.library.normalizer.normalize_str(chunk)
            back = {s: b for b, s in enumerate(self.shown)}
            return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        # Lower case is taken character by character, without the rule for a sigma at a word's end.
        return self.words_of(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())

    def _learn_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of text pieces that white space bounds."""
        known, single, several = self.known, {}, {}
        for c in chunks:
            if c.isascii() and c.isalpha():  # one piece, whatever its letters
                w = c.lower()
                single[c] = c if w == c else w  # one string and its ids serve both caches
            elif len(ws := self._words(c)) == 1:
                single[c] = c if ws[0] == c else ws[0]
            else:
                several[c] = ws
        used = {*single.values(), *itertools.chain.from_iterable(several.values())}
        if fresh := used.difference(known):
            self.learn(fresh)
            if lost := used.difference(known):  # the cache was emptied
                self.learn(lost, keep=True)
        look = known.__getitem__
        return {c: look(w) for c, w in single.items()} | {c: b"".join(map(look, ws)) for c, ws in several.items()}

    def _pieces(self, text: str) -> list[list[str]]:
        """Text without special tokens, cut at white space, in lists of bounded length. Words never span white space."""
        out, first = [], 0
        while first < len(text):
            last = first + PIECE_CHARS
            if last < len(text):
                # Only where the tokenizer sees white space: str.isspace() holds for four control characters more.
                cut = _white_space().search(text, last)
                last = cut.start() if cut else len(text)
            part = text[first:last] if first or last < len(text) else text
            # These four are white space to str.split alone.
            out.append(_white_space().split(part) if "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part else part.split())
            first = last
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. What the whole batch has not met before is learnt in
        one walk, so that its words share their prefixes."""
        plans: list[list[list[str] | bytes]] = []
        for text in texts:
            plan: list[list[str] | bytes] = []
            if text and self.cut_special is not None and "<|" in text:
                for part in self.cut_special(text):
                    plan += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self._pieces(part)
            elif text:
                plan += self._pieces(text)
            plans.append(plan)
        seen = set().union(*[step for plan in plans for step in plan if type(step) is list])
        found = self.chunks
        fresh = seen.difference(found)
        if len(found) + len(fresh) > CACHE_WORDS:
            self.chunks = found = {c: found[c] for c in seen - fresh}
        found.update(self._learn_chunks(fresh))
        look = found.__getitem__
        return [b"".join([step if type(step) is bytes else b"".join(map(look, step)) for step in plan]) for plan in plans]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def forget(self) -> None:
        """Give the caches' memory back."""
        self.known, self.chunks, self.stable_pairs = {}, {}, {}


class Decoder:
    """Text from ids. The file names no decoder, so its tokens stand with a blank between."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        strings = {i: s for s, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self.table = [strings.get(i, "").encode() for i in range(max(strings) + 1)]

    def decode(self, ids: bytes | None) -> bytes:
        """ids: as encode() gives them. The text in UTF-8."""
        table = self.table
        return b" ".join([table[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


_models: dict[tuple, object] = {}


def _model(kind: type, spec: str):
    """One model for each Python worker, which later tasks find warm."""
    key = (kind.__name__, hash(spec))
    if key not in _models:
        if len(_models) > 1:
            _models.clear()
        _models[key] = kind(spec)
    return _models[key]


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(df: DataFrame, spec: str, text: str = "text", ids: str = "token_ids", drop_text: bool = False, decoded: str | None = None) -> DataFrame:
    """Add the binary column ids. spec: text of the tokenizer file, sent to the executors (its size does not depend on the
    data). decoded: also add this binary column, what the ids decode to, in the same pass over the rows."""
    sent = df.sparkSession.sparkContext.broadcast(spec)

    def make():
        model = _model(WordBPE, sent.value)
        decoder = _model(Decoder, sent.value) if decoded else None

        def step(values: list) -> tuple[list, ...]:
            found = model.encode_batch(values)
            return (found,) if decoder is None else (found, [decoder.decode(v) for v in found])

        step.close = model.forget
        return step

    added = [(ids, T.BinaryType(), pa.binary()), *([(decoded, T.BinaryType(), pa.binary())] if decoded else [])]
    return add_columns(df, make, text, added, drop=(text,) if drop_text else (), max_bytes=BATCH_BYTES)


def decode(df: DataFrame, spec: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the column text, in UTF-8, decoded from the binary column ids."""
    sent = df.sparkSession.sparkContext.broadcast(spec)

    def make():
        model = _model(Decoder, sent.value)
        return lambda values: ([model.decode(v) for v in values],)

    return add_columns(df, make, ids, [(text, T.BinaryType(), pa.binary())], max_bytes=BATCH_BYTES)


def with_token_digests(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Token count and digests in place of the ids and the decoded text."""
    return df.select(
        *[c for c in df.columns if c not in (ids, decoded)],
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
