"""Token counts by a finite-state transducer compiled from the tokenizer's merges.

Inside a pre-token, a sequence of tokens is what byte-pair merging gives just if each
pair of neighbours is what merging gives for their own bytes. So each prefix has one
last token, which depends on the last tokens of the shorter prefixes that a token can
start after. A state is the longest suffix that starts some token, with the last token
and the relative count at each position of it; a transition on a byte (or on a byte that
ends the pre-token, which leads back to the start) is annotated with the number of
tokens it emits, negative where a longer token replaces shorter ones. States and
transitions are compiled as texts need them and kept for a worker's later batches.

Texts are cut into chunks of equal length that run side by side. What follows a chunk's
first pre-token end doesn't depend on the state it is entered in, so its state map is
one exit state and one count, but for the head before that end. Heads run next, from the
exit state of the chunk before. Chunks inside one long pre-token get whole state maps:
entry states are guessed (the exit of the chunk before, run from the start), what a guess
leads to is added to the next chunk's map until nothing new comes, and the maps compose
through a parallel prefix scan (by doubling). Counts are summed by document.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import common

TOKENIZER = "word_bpe_49k.json"
#: The pre-tokenizer's pattern; a tokenizer file with another one is refused.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
CHUNK = 512
#: Symbols that are run before the table of states can be emptied.
SEGMENT = 1 << 22
#: Entry states in a chunk's map; chunks that are entered in another one run again after the scan.
MAP_STATES = 32
MAX_STATES = 100_000
SPACE, LETTER, NUMBER, OTHER = range(4)
_loaded: dict = {}


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind  # no run crosses the surrogates
    out[0x1C:0x20] = OTHER
    return out


class Transducer:
    """Symbols are bytes, plus 256 where the byte ends its pre-token. State 0 is the start of a pre-token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or split != PATTERN or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} isn't a tokenizer of the kind that this transducer is compiled from")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = set(model["vocab"])
        self.starts = {""}
        for t in self.tokens:
            plain = t.removesuffix(END)
            self.starts.update(plain[:k] for k in range(1, len(plain)))
        self.chars = _byte_chars()
        self.kind = _classes()
        self.fits: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ("", (None,), (0,))
        self.states, self.number = [start], {start: 0}
        self.column = np.full(512, -1, np.int32)
        self.symbols: list[int] = []
        self.width, self.table = 128, np.full(1024 * 128, -1, np.int32)  # of each state and column: next state * 256 + tokens emitted + 128

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a few symbols."""
        while len(symbols) > 1:
            at = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[at], symbols[at + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                both = symbols[i : i + 2] == list(pair)
                out.append("".join(pair) if both else symbols[i])
                i += 1 + both
            symbols = out
        return symbols

    def neighbours(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (a, b) not in self.fits:
            plain = b.removesuffix(END)
            self.fits[a, b] = self.merge([*a, *plain[:-1], plain[-1] + b[len(plain) :]]) == [a, b]
        return self.fits[a, b]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens emitted) of one transition."""
        suffix, last, count = self.states[state]
        char, final = self.chars[symbol & 255], symbol > 255
        text = suffix + char
        for j in range(len(suffix) + 1):
            token = text[j:] + END * final
            if token in self.tokens and self.neighbours(last[j], token):
                break
        else:
            raise AssertionError(f"no token ends {text!r}")
        emitted = count[j] + 1
        if final:
            return 0, emitted
        keep = next(k for k in range(len(text) + 1) if text[k:] in self.starts)
        # what holds at a position that no token can start after is never asked for
        open_ = [k for k in range(keep, len(text)) if text[k:] in self.starts]
        lasts, counts = [""] * (len(text) - keep), [0] * (len(text) - keep)
        for k in open_:
            lasts[k - keep], counts[k - keep] = last[k], count[k] - emitted
        new = (text[keep:], (*lasts, token), (*counts, 0))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], emitted

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero((np.bincount(symbols, minlength=512) > 0) & (self.column < 0)).tolist():
            self.column[s] = len(self.symbols)
            self.symbols.append(s)
        while self.width < len(self.symbols):
            rows = self.table.reshape(-1, self.width)
            self.table, self.width = np.concatenate([rows, np.full_like(rows, -1)], axis=1).ravel(), 2 * self.width
        return self.column[symbols]

    def run(self, cols: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of stretches cols[at : at + length], all run in step."""
        order = np.argsort(-length, kind="stable")
        at, state, length = at[order].copy(), state[order] * self.width, length[order]
        count = -128 * length.astype(np.int64)
        alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for n in alive.tolist():
            key = cols[at[:n]]
            key += state[:n]
            got = self.table.take(key)
            if got.min() < 0:
                self.compile(key[got < 0])
                got = self.table.take(key)
            count[:n] += got & 255
            got >>= 8
            np.multiply(got, self.width, out=state[:n])
            at[:n] += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back] // self.width, count[back]

    def scan(self, cols: np.ndarray, at: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and exit states of chunks in order, each entered in the exit state of the one before, or in `entry` where that isn't -1."""
        n, first = len(at), entry >= 0
        guess, _ = self.run(cols, at, length, np.zeros(n, np.int32))
        enter = np.where(first, entry, np.r_[0, guess[:-1]])[:, None].astype(np.int64)
        leave, counts = (x[:, None].astype(np.int64) for x in self.run(cols, at, length, enter[:, 0].astype(np.int32)))
        while enter.shape[1] < MAP_STATES:
            came = np.r_[leave[:1], leave[:-1]]  # what the chunk before can leave
            new = (came >= 0) & ~first[:, None] & ~(came[:, :, None] == enter[:, None, :]).any(axis=2)
            rows = np.flatnonzero(new.any(axis=1))
            if not len(rows):
                break
            state = came[rows, new[rows].argmax(axis=1)]
            more = np.full((3, n), -1, np.int64)
            more[0, rows] = state
            more[1, rows], more[2, rows] = self.run(cols, at[rows], length[rows], state.astype(np.int32))
            enter, leave, counts = (np.c_[x, y] for x, y in zip((enter, leave, counts), more, strict=True))
        # each chunk's map from its place among the entries of the chunk before to its own; of a first chunk to its entry
        came = np.r_[leave[:1], leave[:-1]]
        hit = (came[:, :, None] == enter[:, None, :]) & (came >= 0)[:, :, None]
        place = np.where(hit.any(axis=2), hit.argmax(axis=2), -1)
        place[first] = 0
        step, fixed = 1, first.copy()
        while not fixed.all() and step < n:
            before = np.r_[np.zeros((step, place.shape[1]), np.int64), place[:-step]]
            joined = np.take_along_axis(place, np.maximum(before, 0), axis=1)
            joined[before < 0] = -1
            place = np.where(fixed[:, None], place, joined)
            fixed |= np.r_[np.ones(step, bool), fixed[:-step]]
            step *= 2
        own = place[:, 0]
        out, state = np.where(own >= 0, counts[np.arange(n), own], 0), leave[np.arange(n), np.maximum(own, 0)]
        for i in np.flatnonzero(own < 0).tolist():  # its map lacks the state: it runs from there
            left, more = self.run(cols, at[i : i + 1], length[i : i + 1], state[i - 1 : i].astype(np.int32))
            state[i], out[i] = left[0], more[0]
        return out, state

    def compile(self, keys: np.ndarray) -> None:
        for key in np.unique(keys).tolist():
            to, emitted = self.step(key // self.width, self.symbols[key % self.width])
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[key] = to * 256 + emitted + 128

    def symbols_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, and where each text starts among them, with the end."""
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode(), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        points = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        solid = kind != SPACE
        start = solid.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        for i in np.flatnonzero((points == 39) & start).tolist():  # an apostrophe after others of its class is no contraction
            pair = "".join(map(chr, points[i + 1 : i + 3].tolist()))
            size = 2 if pair[:1] in ("s", "t", "m", "d") else 3 if pair in ("re", "ve", "ll") else 0
            if size:
                start[i + 1 : i + size] = False
                start[i + size] = solid[i + size]
        end = solid.copy()
        end[:-1] &= start[1:] | ~solid[1:]
        if len(raw) == len(points):
            symbol, keep, edges = raw + 256 * end.astype(np.int32), solid, ends
        else:
            lead = (raw & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            final = np.r_[lead[1:], True] & end[char]
            symbol, keep = raw + 256 * final.astype(np.int32), solid[char]
            edges = np.flatnonzero(np.r_[lead, True])[ends]
        before = np.r_[0, np.cumsum(keep)]
        return symbol[keep], np.r_[0, before[edges]]

    def normalise(self, text: str) -> tuple[str, int]:
        """The text as the pre-tokenizer sees it, and how many special tokens were in it."""
        special = 0
        if self.special_pattern and "<|" in text:
            text, special = self.special_pattern.subn(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # characters are lower-cased one by one
        return text.lower(), special

    def counts(self, texts: list[str]) -> np.ndarray:
        plain, special = zip(*map(self.normalise, texts), strict=True) if texts else ((), ())
        symbols, edges = self.symbols_of(list(plain))
        out, state = np.array(special, np.int64), 0
        for at in range(0, len(symbols), SEGMENT):
            if len(self.states) > MAX_STATES:
                open_ = self.states[state]
                self.forget()
                if state:
                    state = self.number[open_] = len(self.states)
                    self.states.append(open_)
            stop = min(at + SEGMENT, len(symbols))
            a, b = int(np.searchsorted(edges, at, side="right")) - 1, int(np.searchsorted(edges, stop, side="left"))
            count, state = self.segment(symbols[at:stop], np.clip(edges[a : b + 1], at, stop) - at, state)
            out[a:b] += count
        return out

    def segment(self, symbols: np.ndarray, edges: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Counts of the texts between edges, of which the first is entered in a state; and the state after the last."""
        cols = self.columns(symbols)
        size = np.diff(edges)
        n = -(-size // CHUNK)  # chunks of each text
        first = np.r_[0, np.cumsum(n)]
        text = np.repeat(np.arange(len(size)), n)
        inside = np.arange(first[-1]) - first[text]
        at = edges[text] + inside * CHUNK
        length = np.minimum(CHUNK, edges[text + 1] - at)
        final = np.flatnonzero(symbols > 255)
        head = np.append(final, len(symbols))[np.searchsorted(final, at)] + 1 - at  # up to the first pre-token end
        closed = head <= length
        head = np.where(inside == 0, 0, np.minimum(head, length))
        start = np.zeros(len(at), np.int32)
        start[:1] = state
        exits, count = self.run(cols, at + head, length - head, start)
        exits = exits.copy()
        known = closed | (inside == 0)
        now = np.flatnonzero((inside > 0) & known[np.arange(len(inside)) - 1])
        left, more = self.run(cols, at[now], head[now], exits[now - 1])
        count[now] += more
        exits[now] = np.where(closed[now], exits[now], left)
        known[now] = True
        todo = np.setdiff1d(np.flatnonzero(inside > 0), now)  # inside one long pre-token
        if len(todo):
            more, left = self.scan(cols, at[todo], head[todo], np.where(known[todo - 1], exits[todo - 1], -1))
            count[todo] += more
            exits[todo] = np.where(closed[todo], exits[todo], left)
        return np.bincount(text, weights=count, minlength=len(size)).astype(np.int64), int(exits[-1]) if len(exits) else 0


def _transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one for each row of docs.

    Counts are those of the tokenizers library without begin, end or padding; special
    strings in a text count as one token each, as is its default. Null texts count as
    empty: no bytes, no tokens. Repeated rows give repeated rows; other columns of docs
    are ignored; an empty table gives an empty one.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(text).alias("_text"), F.col(key))
    schema = T.StructType([rows.schema[1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        fst = _transducer(path)
        for b in batches:
            sizes, tokens, held, chars = [], [], [], 0
            for t in b.column(0):
                held.append(t.as_py() or "")
                sizes.append(len(held[-1].encode()))
                chars += sizes[-1]
                if chars > 4_000_000:
                    tokens += fst.counts(held).tolist()
                    held, chars = [], 0
            tokens += fst.counts(held).tolist()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], schema.fieldNames())

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_fst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_fst_tokens": op7_fst_tokens}
ORACLES: dict[str, str] = {}
