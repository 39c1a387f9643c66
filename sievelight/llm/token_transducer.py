"""Token counts by a compiled finite-state tokenizer.

A piece vocabulary with merge scores becomes a deterministic transducer over characters.  Its state after
a prefix holds what later characters can still change: the longest suffix that begins some piece and, for
each start inside it, the last token and the relative token count of the text before.  By the theorem that a
split is the merges' result exactly if every neighbouring pair is, the new last token is the one piece that
ends here and stands well behind the token before it.  Transitions carry the change in the number of
tokens.  States are made when first reached and dropped together when there are too many, so memory is
bounded and the counts stay exact.

No piece has the word mark behind another character, so a word's first character brings the transducer to
one fixed state: a chunk of text is a map from entry state to (exit state, count) that is constant from its
first word on, and such maps compose associatively (``Chunk.then``); texts are cut into chunks, and the
chunks' maps are folded by a prefix scan.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import base

MARK = "▁"
#: In a state, a place that no later piece can start from.
NOWHERE = ("", 0)
#: Bounds of what a worker keeps: states, neighbouring pairs, words.
STATES, PAIRS, WORDS = 200_000, 400_000, 400_000
#: Characters of a chunk.
CHUNK = 1 << 16


class Pieces:
    """The scores of the normal pieces of a sentencepiece BPE model with byte fallback."""

    def __init__(self, file: str):
        import sentencepiece.sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not train.byte_fallback:
            raise ValueError("compiled only for identity normalisation with a leading mark and byte fallback")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has the word mark behind another character")
        self.starts = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self.runs: dict[int, int] = {}
        self.memo: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Exact merging: the pair with the best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def run_of_marks(self, n: int) -> int:
        """Tokens of ``n`` marks in a row, by exact merging with a heap (n log n)."""
        if n not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            lengths, after, prior = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            score = {len(p): s for p, s in self.score.items() if not p.strip(MARK)}
            heap = [(-score[2], i, 1, 1) for i in range(n - 1)] if 2 in score else []
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = after[i]
                if lengths[i] != a or j >= n or lengths[j] != b:
                    continue
                lengths[i], lengths[j], after[i] = a + b, 0, after[j]
                if after[i] < n:
                    prior[after[i]] = i
                for x in (prior[i], i):
                    if x >= 0 and (y := after[x]) < n and lengths[x] + lengths[y] in score:
                        heapq.heappush(heap, (-score[lengths[x] + lengths[y]], x, lengths[x], lengths[y]))
            self.runs[n] = sum(x > 0 for x in lengths)
        return self.runs[n]

    def stands(self, before: str, piece: str) -> bool:
        """Whether merging the bytes of the two ends in these two; alone at a start (``before`` empty), in the piece."""
        key = (before, piece)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[key] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return known


class Transducer:
    """Lazily compiled; ``word`` runs it from the state behind a word's mark."""

    def __init__(self, file: str):
        self.pieces = Pieces(file)
        self.reset()

    def reset(self) -> None:
        #: state -> character -> (next state, tokens added); a state is an index into ``keys``
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.keys: list[tuple[str, tuple[tuple[str, int], ...]]] = []
        self.index: dict[tuple, int] = {}
        self.start = self.state(("", (("", 0),)))
        self.marked = self.step(self.start, MARK)[0]

    def state(self, key: tuple) -> int:
        at = self.index.get(key)
        if at is None:
            at = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return at

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The transition on ``c``, compiled from the merges.

        A key is (suffix, history): history[k] is the last token of the text without its last k
        characters and that text's token count less the count of the text itself.
        """
        suffix, history = self.keys[state]
        score, stands = self.pieces.score, self.pieces.stands
        if c not in self.pieces.score:  # one token for each of its bytes, and nothing merges with it
            out = self.state(("", (("", 0),))), len(c.encode("utf-8", "surrogatepass"))
            self.moves[state][c] = out
            return out
        grown = suffix + c
        token, count = "", 0
        for k in range(len(grown)):  # the piece that starts k characters before c
            piece = grown[len(grown) - 1 - k :]
            if piece in score and (not k or stands("", piece)) and (not (before := history[k][0]) or stands(before, piece)):
                token, count = piece, history[k][1] + 1
                break
        kept = grown
        while kept and kept not in self.pieces.starts:
            kept = kept[1:]
        # only where some piece can still go on from does the past matter
        past = ((token, 0), *((history[k][0], history[k][1] - count) if kept[len(kept) - 1 - k :] in self.pieces.starts else NOWHERE for k in range(len(kept))))
        out = self.state((kept, past)), count
        self.moves[state][c] = out
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """From ``state`` over ``text``: exit state and count."""
        total, moves = 0, self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                move = self.step(state, c)
            state, n = move
            total += n
        return state, total


@dataclass(frozen=True)
class Chunk:
    """A chunk's state map.  ``head``: what stands before its first word, to be run from the entry state; with no word at all, the whole map is ``head``."""

    head: str
    count: int = 0
    exit: str | None = None  # the last word, from which the exit state follows

    def then(self, other: Chunk, count) -> Chunk:
        """The map of this chunk and then ``other``."""
        if self.exit is None:
            return Chunk(self.head + other.head, other.count, other.exit)
        if other.exit is None:
            return Chunk(self.head, self.count, self.exit + other.head)
        return Chunk(self.head, self.count + count(self.exit + other.head) + other.count, other.exit)


class Counter:
    """Token counts of texts, with a bounded memory of words."""

    def __init__(self, file: str):
        self.machine = Transducer(file)
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a run of marks and what follows up to the next mark."""
        n = self.memo.get(word)
        if n is not None:
            return n
        machine, marks = self.machine, len(word) - len(word.lstrip(MARK))
        if len(machine.keys) > STATES:
            machine.reset()
        if marks > 1:
            # the last mark belongs to the word if its first token has more than the mark; else it joins the run, which merges last
            body = word[marks:]
            joined = bool(body) and self.first_takes_mark(body)
            n = machine.pieces.run_of_marks(marks - joined) + (machine.run(machine.marked, body)[1] + 1 if joined else self.behind_lone_mark(body))
        else:
            n = machine.run(machine.start, word)[1]
        if len(word) <= 64:
            if len(self.memo) >= WORDS:
                self.memo.clear()
            self.memo[word] = n
        return n

    def first_takes_mark(self, body: str) -> bool:
        """Whether merging joins the mark to the start of ``body``; only as much of it counts as a piece can hold and its neighbour can reach."""
        return self.machine.pieces.merge(MARK + body[:48])[0] != MARK

    def behind_lone_mark(self, body: str) -> int:
        return self.machine.run(self.machine.marked, body)[1] if body else 0

    def chunk(self, text: str) -> Chunk:
        """The state map of a stretch in which blanks are already marks."""
        first = text.find(MARK)
        if first < 0:
            return Chunk(text)
        words = [MARK + w for w in text[first + 1 :].split(MARK)]
        if "" in map(str.strip, words) or MARK in words:
            words = re.findall(f"{MARK}+[^{MARK}]*", text[first:])
        memo = self.memo
        total = sum([memo[w] if w in memo else self.word(w) for w in words[:-1]])
        return Chunk(text[:first], total, words[-1])

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        cuts, at = [], 0
        while at < len(marked):
            end = min(len(marked), at + CHUNK)
            while end < len(marked) and marked[end] == MARK and marked[end - 1] == MARK:
                end += 1  # a run of marks isn't cut
            cuts.append(self.chunk(marked[at:end]))
            at = end
        while len(cuts) > 1:  # a scan in log n rounds, each joining neighbours
            cuts = [a.then(b, self.word) if b else a for a, b in zip(cuts[::2], [*cuts[1::2], None])]
        whole = cuts[0]
        return whole.count + self.word(whole.exit)


@functools.lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def count_tokens(df: DataFrame, file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null counts as empty: no bytes, no tokens.  Repeated rows and null keys pass through; strings that look
    like control pieces are ordinary text, as in the library.
    """
    rows = base(df, key, text)

    def work(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(file)
        for table in tables:
            texts = [t or "" for t in table.column(1).to_pylist()]
            n = [counting.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [table.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, n_bytes bigint, n_tokens bigint, over_limit boolean")
