"""Token counts of a piece BPE vocabulary by rank-synchronous array merging.

Texts fall into pre-tokens (a run of word-start marks and what follows it)
that no piece crosses. New pre-tokens of a batch are held as one ragged array
of symbols; each step merges the lowest-ranked pair of every sequence at once,
wherever it stands in it, until none is left, and the surviving symbols are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import need, utf8

_MARK = "▁"
#: Characters of text split at once and counts remembered between batches.
SLICE, REMEMBERED = 1_000_000, 1_000_000
_NEVER = np.iinfo(np.int64).max >> 1


class Merges:
    """Pairs, ranks and costs of a piece vocabulary read from a model file."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        pieces = {lib.id_to_piece(i): i for i in ids
                  if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        if lib.normalize("ﬁ  Ａ\t ") != f"{_MARK}ﬁ{_MARK}{_MARK}Ａ\t{_MARK}" or not any(lib.is_byte(i) for i in ids):
            raise ValueError("only vocabularies without text normalisation and with byte fallback are supported")
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("the vocabulary has pieces across word starts")
        self.known = n = len(ids)
        symbol = np.empty(0x110000, np.int32)     # characters without a piece: one symbol for each UTF-8 length
        for low, high, size in ((0, 0x80, 1), (0x80, 0x800, 2), (0x800, 0x10000, 3), (0x10000, 0x110000, 4)):
            symbol[low:high] = n + size
        scores = {p: lib.get_score(i) for p, i in pieces.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, i in pieces.items():
            if len(piece) == 1:
                symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                if piece[:k] in pieces and piece[k:] in pieces:
                    pairs[pieces[piece[:k]] * (n + 5) + pieces[piece[k:]]] = (order[scores[piece]], i)
        self.symbol = symbol
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.longest = max(map(len, pieces), default=1)
        # a line end that no longer piece contains separates pre-tokens by itself
        self.line_end = None if any("\n" in p for p in pieces if len(p) > 1) else (1 if "\n" in pieces else len(b"\n"))

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and its place in the table."""
        key = left.astype(np.int64) * (self.known + 5) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), at

    def count(self, sequences: list[str]) -> list[int]:
        """Symbols left of each sequence after all merges."""
        out = np.zeros(len(sequences), np.int64)
        lengths = np.array([len(s) for s in sequences], np.int64)
        sym = self.symbol[np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32)]
        if not len(sym):
            return out.tolist()
        of = np.repeat(np.arange(len(sequences)), lengths)
        rank, pair = self._find(sym[:-1], sym[1:])
        rank, pair = np.append(rank, _NEVER), np.append(pair, 0)
        rank[np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)] = _NEVER
        while True:
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(of)))
            done = least == _NEVER
            if done.any():      # nothing to merge: count and leave
                leaving = np.repeat(done, sizes)
                out += np.bincount(of[leaving], np.maximum(1, sym[leaving] - self.known), len(out)).astype(np.int64)
                stay = ~leaving
                sym, of, rank, pair = sym[stay], of[stay], rank[stay], pair[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(sym):
                    return out.tolist()
            lowest = np.flatnonzero(rank == np.repeat(least, sizes))
            at = lowest[np.concatenate(([True], of[lowest[1:]] != of[lowest[:-1]]))]      # the leftmost of each sequence
            long = np.repeat(sizes > self.longest, sizes)
            if long.any():
                place = np.flatnonzero(long)
                at = np.union1d(at, place[self._elsewhere(sym[place], of[place], rank[place], pair[place])])
            sym[at] = self.into[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))        # where the merged symbols stand among those kept
            sym, of, rank, pair = sym[keep], of[keep], rank[keep], pair[keep]
            again = np.unique(np.concatenate((moved, moved - 1)))
            again = again[again >= 0]
            after = np.minimum(again + 1, len(sym) - 1)
            rank[again], pair[again] = self._find(sym[again], sym[after])
            rank[again[(again + 1 >= len(sym)) | (of[after] != of[again])]] = _NEVER

    def _elsewhere(self, sym: np.ndarray, of: np.ndarray, rank: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Places of long sequences to merge at once with the lowest of the sequence.

        A merge only calls for others that hold its symbol, so it reaches no
        further than the longest piece. A pair that no lower one stands near
        within this reach can be merged whatever happens beyond. Of equal pairs
        near each other the left one comes first; they go together, overlapping
        ones by every second, up to the first after which a pair of no higher
        rank appears beside it.
        """
        reach, n = self.longest, len(rank)
        left, right = _window_least(rank, reach), _window_least(rank[::-1], reach)[::-1]
        at = np.flatnonzero((rank < _NEVER) & (rank <= left) & (rank <= right))
        if not len(at):
            return at
        first = np.concatenate(([True], np.diff(at) > reach))
        group = np.cumsum(first) - 1
        waits = left[at[first]] == rank[at[first]]       # for an equal pair on the left that is not lowest around
        run = np.concatenate(([True], np.diff(at) != 1))
        order = np.arange(len(at))
        chosen = ((order - np.maximum.accumulate(np.where(run, order, 0))) % 2 == 0) & ~waits[group]
        at, group = at[chosen], group[chosen]
        if not len(at):
            return at
        new = self.into[pair[at]]
        before = sym[np.maximum(at - 1, 0)]
        joined = np.flatnonzero(np.diff(at) == 2) + 1
        before[joined] = new[joined - 1]
        after = np.minimum(at + 2, n - 1)
        calls = (self._find(before, new)[0] <= rank[at]) & (at > 0) & (of[np.maximum(at - 1, 0)] == of[at])
        calls |= (self._find(new, sym[after])[0] <= rank[at]) & (at + 2 < n) & (of[after] == of[at])
        earlier = np.cumsum(calls) - calls
        lead = np.concatenate(([True], group[1:] != group[:-1]))
        return at[earlier == np.maximum.accumulate(np.where(lead, earlier, 0))]


def _window_least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` values before each place."""
    n = len(values)
    padded = np.full(-(-(n + reach) // reach) * reach, _NEVER, np.int64)
    padded[reach:reach + n] = values
    blocks = padded.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[reach - 1:reach - 1 + n])


class Counter:
    """Token counts of texts, remembering those of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges, self.memory = merges, {}
        end = "\n" if merges.line_end else ""
        self.parts = re.compile(f"{_MARK}+[^{_MARK}{end}]*|[^{_MARK}{end}]+")
        self.cut = re.compile(f"(?<=[^{_MARK}]){_MARK}")

    def _slices(self, text: str) -> Iterator[str]:
        """Parts of bounded size, cut only where a pre-token begins."""
        at = 0
        while at < len(text):
            found = self.cut.search(text, at + SLICE) if len(text) - at > SLICE else None
            to = found.start() if found else len(text)
            yield text[at:to]
            at = to

    def _split(self, text: str) -> tuple[list[str], int]:
        extra = text.count("\n") * self.merges.line_end if self.merges.line_end else 0
        if _MARK * 2 in text or "\0" in text:
            return self.parts.findall(text), extra
        cut = text.replace(_MARK, "\0" + _MARK)
        if self.merges.line_end:
            cut = cut.replace("\n", "\0")
        return cut.split("\0"), extra

    def count(self, texts: list[bytes | None]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0
        for k, raw in enumerate(texts):
            if raw:
                for part in self._slices(_MARK + raw.decode("utf-8").replace(" ", _MARK)):
                    words, extra = self._split(part)
                    out[k] += extra
                    held.append((k, words))
                    size += len(part)
                    if size >= SLICE:
                        self._settle(held, out)
                        held, size = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        here = set().union(*(w for _, w in held))
        new = [w for w in here if w not in self.memory]
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
            new = list(here)
        self.memory.update(zip(new, self.merges.count(new)))
        get = self.memory.__getitem__
        for k, words in held:
            out[k] += sum(map(get, words))


def count_tokens(docs: DataFrame, model_path: str, *, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``out``.

    ``model_path`` names a piece BPE model on the driver; its bytes are shipped
    (a vocabulary, about half a megabyte). Special strings in a text are plain
    text; nothing is added, cut or padded. Null and empty texts count 0; very
    long texts are split in slices where pre-tokens begin; repeated rows get
    equal counts; other columns pass through, an existing ``out`` is replaced.
    """
    need(docs, text)
    with open(model_path, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(Merges(shipped.value))
        for texts in batches:
            yield pa.array(counter.count(utf8(texts)), pa.int64())

    return docs.withColumn(out, count(F.col(f"`{text}`").cast("string")))
