"""Byte-level BPE vocabularies read from a tokenizer file, for vectorised work on many words at once."""

from __future__ import annotations

import functools
import json

import numpy as np


def byte_letters() -> dict[str, int]:
    """The published byte-to-letter table of byte-level BPE, inverted: printable Latin-1 letters stand for themselves, the other bytes for letters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Beyond every rank.
NEVER = 1 << 60


class Table:
    """A fixed map from int64 keys to values with vectorised look-up (open addressing, linear probing); absent keys give ``missing``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, missing, np.int64)
        self.missing, self.probes = missing, 1
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            first = np.unique(at[todo[free]], return_index=True)[1]
            placed = todo[free][first]
            self.keys[at[placed]], self.values[at[placed]] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.missing)
        todo = np.flatnonzero((there != keys) & (there >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


def merge_all(bpe, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact BPE of many words at once: in each round every word applies its merge of least rank, leftmost first.

    ``ids`` are the first symbols of all words in a row and ``owner`` their words; as a merge's halves have lower ranks, all
    merges of one rank can be applied together.
    """
    done: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    while len(ids):
        rank = np.full(len(ids), NEVER, np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = bpe.pair_ranks.get(ids[same] * bpe.size + ids[same + 1])
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.minimum.reduceat(rank, heads)
        counts = np.diff(np.r_[heads, len(ids)])
        spread = np.repeat(least, counts)
        over = spread == NEVER
        hit = (rank == spread) & ~over
        # in a run of overlapping pairs (a a a) every second one merges, from the left
        where = np.flatnonzero(hit)
        if len(where):
            new_run = np.r_[True, np.diff(where) > 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            ids[where] = bpe.whole_of_rank[rank[where]]
        stay = ~over
        stay[where + 1] = False
        done.append(ids[over])
        done_owner.append(owner[over])
        ids, owner = ids[stay], owner[stay]
    tokens, words = np.concatenate(done or [ids[:0]]), np.concatenate(done_owner or [owner[:0]])
    order = np.argsort(words, kind="stable")
    return tokens[order], words[order]


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file whose merges are listed by rank.

    ``spine_right[t]`` and ``spine_left[t]`` lead from a token down its last and first halves.  A merge
    applies at rank time; as each merge's halves have earlier ranks (checked), times only rise.
    """

    def __init__(self, file: str):
        data = json.load(open(file))
        letters = byte_letters()
        vocab = data["model"]["vocab"]
        self.tokens: dict[bytes, int] = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.tokens.items():
            self.bytes[i] = token
        for content, i in self.specials.items():
            self.bytes[i] = content.encode()
        self.size, self.longest = size, max(map(len, self.tokens))
        self.rank = np.full(size, -1, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            self.pairs[a, b] = (rank, whole)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
            if max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError("a merge comes before one of its halves")
        keys = np.array([a * size + b for a, b in self.pairs], np.int64)
        self.pair_ranks = Table(keys, np.array([r for r, _ in self.pairs.values()], np.int64), NEVER)
        self.whole_of_rank = np.zeros(len(self.pairs), np.int64)
        for rank, whole in self.pairs.values():
            self.whole_of_rank[rank] = whole
        self.byte_ids = np.array([self.tokens.get(bytes([b]), -1) for b in range(256)], np.int64)
        #: tokens that no greedy proposal may use, because exact merging of their bytes gives something else
        built = np.flatnonzero(self.left >= 0)
        self.unreachable = set(built[~self.compatible(self.left[built], self.right[built], self.rank[built])].tolist())
        self._compile_trie()

    def _compile_trie(self) -> None:
        """Edges (node, byte) -> node over the reachable tokens, and the token that ends at each node."""
        edges: dict[int, int] = {}
        ends = [-1]
        for token, i in self.tokens.items():
            if i in self.unreachable:
                continue
            node = 0
            for b in token:
                node = edges.setdefault(node * 256 + b, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.trie_ends = np.array(ends, np.int64)
        self.trie = Table(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64), -1)

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: again and again the pair of least rank, leftmost first."""
        ids = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, at = min(((self.pairs.get((ids[i], ids[i + 1]), (NEVER, 0))[0], i) for i in range(len(ids) - 1)))
            if rank == NEVER:
                break
            whole = self.pairs[ids[at], ids[at + 1]][1]
            out, i = [], 0
            first, second = ids[at], ids[at + 1]
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == first and ids[i + 1] == second:
                    out.append(whole)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and links, for words of many bytes: n log n."""
        import heapq

        ids = [self.tokens[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i] = self.pairs[pair][1]
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for a in (prior[i], i):
                if a >= 0 and (b := after[a]) < n and (p := (ids[a], ids[b])) in self.pairs:
                    heapq.heappush(heap, (self.pairs[p][0], a, p))
        return [t for t in ids if t >= 0]

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in all words at once: tokens in order, and the word of each.  ``data``: the words' bytes in a row."""
        limit = np.repeat(ends, ends - starts)
        token, length = np.full(len(data), -1, np.int64), np.ones(len(data), np.int64)
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        for depth in range(self.longest):
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            node = self.trie.get(node * 256 + data[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            found = self.trie_ends[node]
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], depth + 1
            if not len(at):
                break
        out: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        here, words = starts.copy(), np.arange(len(starts))
        while len(here):
            live = here < ends[words]
            here, words = here[live], words[live]
            out.append(token[here])
            owners.append(words)
            here = here + length[here]
        tokens, owner = np.concatenate(out or [starts[:0]]), np.concatenate(owners or [starts[:0]])
        order = np.argsort(owner, kind="stable")
        return tokens[order], owner[order]

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: tokens in order, and the word of each."""
        return merge_all(self, self.byte_ids[data], np.repeat(np.arange(len(starts)), ends - starts))

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbouring tokens: would exact merging of their bytes end in this very pair?

        It would not, if some piece ``x`` at the end of ``a`` and some piece ``y`` at the start of ``b``
        have a merge that comes while both stand: before ``x`` is built into more of ``a``, and not
        after ``y`` is built into more of ``b`` (of merges of one rank the leftmost comes first).
        With ``before``, only merges of a lower rank than that count.
        """
        good = np.ones(len(a), bool)
        never = np.int64(NEVER)
        x, x_until, at = a.astype(np.int64), np.full(len(a), never) if before is None else before, np.arange(len(a))
        while len(at):
            y, y_until, x_now, until, now = b[at].astype(np.int64), np.full(len(at), never), x, x_until, at
            while len(now):
                rank = self.pair_ranks.get(x_now * self.size + y)
                good[now[(rank < until) & (rank <= y_until) & (rank < never)]] = False
                deeper = (self.left[y] >= 0) & good[now]
                y_until, y, x_now, until, now = self.rank[y][deeper], self.left[y][deeper], x_now[deeper], until[deeper], now[deeper]
            deeper = (self.right[x] >= 0) & good[at]
            x_until, x, at = np.minimum(self.rank[x][deeper], x_until[deeper]), self.right[x][deeper], at[deeper]
        return good

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Propose for all, test all neighbouring pairs at once, merge exactly only the words that fail.

        The ids of each word are given as little-endian unsigned 32-bit integers.
        """
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        tokens, owner = self.propose(data, starts, ends)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed = np.zeros(len(words), bool)
        failed[owner[inner[~good[back]]]] = True
        short = np.flatnonzero(failed & (lengths <= 256))
        inside = (failed & (lengths <= 256))[np.repeat(np.arange(len(words)), lengths)]
        short_ends = np.cumsum(lengths[short])
        repaired, which = self.merge_all(data[inside], short_ends - lengths[short], short_ends)
        parts, owners = [tokens[~failed[owner]], repaired], [owner[~failed[owner]], short[which]]
        for i in np.flatnonzero(failed & (lengths > 256)).tolist():
            parts.append(np.array(self.merge_long(words[i]), np.int64))
            owners.append(np.full(len(parts[-1]), i))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        blob = np.concatenate(parts)[order].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(owner[order], np.arange(len(words) + 1))).tolist()
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def load(file: str) -> ByteBPE:
    return ByteBPE(file)


class WordEndBPE:
    """A byte-level BPE whose last symbol of a word carries an end mark; words come without white space."""

    def __init__(self, file: str):
        data = json.load(open(file))
        vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        keys, wholes, rank_of = [], [], {}
        for rank, pair in enumerate(data["model"]["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            if max(rank_of.get(one, -1), rank_of.get(two, -1)) >= rank:
                raise ValueError("a merge comes before one of its halves")
            rank_of.setdefault(one + two, rank)
            keys.append(vocab[one] * self.size + vocab[two])
            wholes.append(vocab[one + two])
        self.pair_ranks = Table(np.array(keys, np.int64), np.arange(len(keys)), NEVER)
        self.whole_of_rank = np.array(wholes, np.int64)
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each non-empty word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.last[data[ends - 1]]
        tokens, owner = merge_all(self, ids, np.repeat(np.arange(len(words)), lengths))
        blob = tokens.astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=4)
def load_word_end(file: str) -> WordEndBPE:
    return WordEndBPE(file)
