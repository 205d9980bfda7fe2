"""Byte-level BPE encoding of whole texts with a public vocabulary file, and streaming decoding.

The merges are compiled into a finite-state transducer over bytes whose states are made when first
reached. For a read prefix s[:i], the only positions a later token can start from are those j for which
s[j:i] begins some token; the state keeps, for each of them, the place in the token trie and the tokens
from the last settled boundary to j. A byte moves all places on; the one finished token that BPE
itself would leave next to the token before it ends the new prefix. Tokens that all open positions
share are settled and emitted, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the vocabulary's word pattern; white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WORDS = 1 << 17  # words whose ids a task remembers
STATES = 1 << 18  # states a task keeps before it starts afresh


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte: printable bytes themselves, others from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class State:
    __slots__ = ("live", "before", "end", "next")

    def __init__(self, live, before):
        self.live = live  # ((trie node, tokens since the settled boundary), ...), the read prefix's own last
        self.before = before  # last settled token, -1 at the start
        self.end = live[-1][1]
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        spell = {t: bytes(letter[c] for c in t) for t in model["vocab"]}
        self.bytes_of = {i: spell[t] for t, i in model["vocab"].items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        vocab = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, word in self.bytes_of.items():
            at = 0
            for b in word:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                at = self.trie[at][b]
            self.token[at] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.states: dict = {}
        self.start = self._state(((0, ()),), -1)

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of a short byte string, by rank; settles which tokens may stand side by side."""
        t = [self.single[b] for b in word]
        while len(t) > 1:
            r, to, i = min(((*self.rank.get((t[i], t[i + 1]), (1 << 30, -1)), i) for i in range(len(t) - 1)), key=lambda x: (x[0], x[2]))
            if to < 0:
                return t
            t[i : i + 2] = [to]
        return t

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b whole right after token a (a = -1: at the start)."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            left = self.bytes_of[a] if a >= 0 else b""
            self.fits[key] = self.merge(left + self.bytes_of[b]) == ([a, b] if a >= 0 else [b])
        return self.fits[key]

    def _state(self, live, before) -> State:
        key = (before, live)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = State(live, before)
        return got

    def _step(self, s: State, byte: int) -> tuple[State, tuple[int, ...]]:
        live, end = [], None
        for node, pending in s.live:
            to = self.trie[node].get(byte)
            if to is None:
                continue
            if self.trie[to]:
                live.append((to, pending))
            t = self.token[to]
            if t >= 0 and end is None and self._fits(pending[-1] if pending else s.before, t):
                end = (*pending, t)
        live.append((0, end))
        k, least = 0, min(len(p) for _, p in live)
        first = live[0][1]
        while k < least and all(p[k] == first[k] for _, p in live):
            k += 1
        out = first[:k]
        return self._state(tuple((n, p[k:]) for n, p in live), out[-1] if k else s.before), out

    def word(self, text: str) -> tuple[int, ...]:
        got = self.words.get(text)
        if got is not None:
            return got
        s, out = self.start, []
        for b in text.encode("utf-8", "surrogatepass"):
            hit = s.next.get(b)
            if hit is None:
                hit = s.next[b] = self._step(s, b)
            s = hit[0]
            if hit[1]:
                out += hit[1]
        got = (*out, *s.end)
        if len(self.states) > STATES:
            self._clear()
        if len(text) <= 32:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for w in self.split(text):
            out += self.word(w)
        return out

    def decode(self, ids) -> str:
        return "".join(decode_stream(self.bytes_of[i] for i in ids))


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of byte pieces as it becomes certain; a character may span pieces. Malformed bytes become U+FFFD.

    The machine's state is how many continuation bytes are due, the bits so far and the range the next
    byte must lie in (which shuts out overlong forms, surrogates and values past U+10FFFF).
    """
    due, code, low, high = 0, 0, 0x80, 0xBF
    for piece in pieces:
        if not due and piece.isascii():
            yield piece.decode("ascii")
            continue
        out = []
        for b in piece:
            if due:
                if low <= b <= high:
                    code, due, low, high = code << 6 | b & 63, due - 1, 0x80, 0xBF
                    if not due:
                        out.append(chr(code))
                    continue
                out.append("�")
                due, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                due, code = 1, b & 31
            elif 0xE0 <= b <= 0xEF:
                due, code = 2, b & 15
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                due, code = 3, b & 7
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        yield "".join(out)
    if due:
        yield "�"


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per Python worker."""
    if path not in _made:
        _made[path] = Transducer(path)
    return _made[path]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """id and ids (array<int>) of each row's text. Null and empty texts have the empty list. Special tokens'
    strings are ordinary text. Rows with equal ids are encoded each; an empty table gives no rows."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            offsets, values = [0], []
            for text in b.column(1).to_pylist():
                if text:
                    values += t.encode(text)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_column(df: DataFrame, id_col: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    """id and text of each row's ids; the inverse of encode_column for valid texts (null comes back empty)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(ids or ()) for ids in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return df.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")
