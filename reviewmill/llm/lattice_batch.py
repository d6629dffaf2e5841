"""Best paths through the lattices of many words at once.

The pieces form a trie held as a hash table, so one array operation takes a step
from every open position of every word.  The edges found that way are relaxed
forward by their end, one column of all words at a time, which gives every
position's best score (Viterbi).  The backward search is A* with these scores as
its exact remaining costs: in a round every unfinished word opens its best state,
and of the states then open keeps as many as it still wants paths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORDS_AT_ONCE = 1 << 12
_SHIFT = np.uint64(21)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Pieces by their letters; node 0 is the root."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        nodes, keys = {"": 0}, []
        ids, scores = [-1], [0.0]
        for name in pieces:
            at = 0
            for end in range(1, len(name) + 1):
                node = nodes.get(name[:end])
                if node is None:
                    node = nodes[name[:end]] = len(nodes)
                    keys.append((at << 21) | ord(name[end - 1]))
                    ids.append(-1)
                    scores.append(0.0)
                at = node
            ids[at], scores[at] = pieces[name]
        self.ids, self.scores = np.array(ids, np.int32), np.array(scores)
        bits = max(len(keys).bit_length() + 2, 4)
        self.down = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.nodes = np.zeros(1 << bits, np.int32)
        self.probes = 1
        for child, key in enumerate(keys, 1):
            slot, probes = ((key * int(_SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> int(self.down), 1
            while self.keys[slot] >= 0:
                slot, probes = (slot + 1) & ((1 << bits) - 1), probes + 1
            self.keys[slot], self.nodes[slot] = key, child
            self.probes = max(self.probes, probes)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of every node by a letter, 0 where there is none."""
        keys = (nodes.astype(np.int64) << 21) | letters
        slots = ((keys.astype(np.uint64) * _SPREAD) >> self.down).astype(np.int64)
        found = np.where(self.keys[slots] == keys, self.nodes[slots], 0)
        for _ in range(self.probes - 1):
            # Only where another key stands the search goes on.
            open_ = np.flatnonzero((found == 0) & (self.keys[slots] >= 0) & (self.keys[slots] != keys))
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            same = self.keys[slots[open_]] == keys[open_]
            found[open_[same]] = self.nodes[slots[open_[same]]]
        return found


@dataclass
class WordPaths:
    """Per word: ids of the best path (``ids[starts[i]:starts[i + 1]]``), its score, how many paths there are.

    Path ``r`` of word ``i`` (from 1 on) has the ids from ``other_starts[i * (n_best - 1) + r - 1]`` on and loses
    ``others[i, r - 1]`` against the best; without such a path there are no ids and the loss is infinite.
    """

    ids: np.ndarray
    starts: np.ndarray
    scores: np.ndarray
    counts: np.ndarray
    other_ids: np.ndarray
    other_starts: np.ndarray
    others: np.ndarray

    @property
    def losses(self) -> np.ndarray:
        """What the second path loses."""
        return self.others[:, 0] if self.others.shape[1] else np.full(len(self.scores), np.inf)

    @classmethod
    def joined(cls, parts: list[WordPaths]) -> WordPaths:
        def ends(name: str) -> np.ndarray:
            return np.cumsum(np.concatenate([np.zeros(1, np.int64), *(np.diff(getattr(part, name)) for part in parts)]))

        join = lambda name: np.concatenate([getattr(part, name) for part in parts])
        return cls(join("ids"), ends("starts"), join("scores"), join("counts"), join("other_ids"), ends("other_starts"), join("others"))

    @classmethod
    def alone(cls, paths: list[tuple[float, tuple[int, ...]]], n_best: int) -> WordPaths:
        """One word, of its paths, best first."""
        (score, ids), *others = paths
        sizes = [len(more) for _, more in others] + [0] * (n_best - 1 - len(others))
        return cls(
            np.array(ids, np.int32), np.array([0, len(ids)]), np.array([score]), np.array([len(paths)]),
            np.array([piece for _, more in others for piece in more], np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
            np.array([[score - less for less, _ in others] + [np.inf] * (n_best - 1 - len(others))]))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them for every ``i``."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class BatchSearch:
    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float, n_best: int):
        self.trie, self.n_best = Trie(pieces), n_best
        self.byte_ids, self.byte_score = np.array(byte_ids, np.int32), byte_score

    def search(self, words: list[str]) -> WordPaths:
        """The best paths of every word; no word is empty."""
        parts = [self._search(words[low:low + WORDS_AT_ONCE]) for low in range(0, len(words), WORDS_AT_ONCE)]
        none = np.zeros(0, np.int64)
        return WordPaths.joined(parts) if parts else WordPaths(
            none, np.zeros(1, np.int64), np.zeros(0), none, none, np.zeros(1, np.int64), np.zeros((0, self.n_best - 1)))

    def _edges(self, letters: np.ndarray, owner: np.ndarray, ends: np.ndarray):
        """Start and end state, node or letter, and score of every edge; a state is a place between letters."""
        at = np.arange(len(letters))
        nodes = np.zeros(len(letters), np.int32)
        starts, stops, kinds, scores = [], [], [], []
        depth, lone = 0, None
        while len(at):
            nodes = self.trie.step(nodes, letters[at + depth])
            at, nodes = at[nodes > 0], nodes[nodes > 0]
            whole = self.trie.ids[nodes] >= 0
            if depth == 0:
                lone = np.ones(len(letters), bool)
                lone[at[whole]] = False
            starts.append(at[whole])
            stops.append(at[whole] + depth + 1)
            kinds.append(nodes[whole])
            scores.append(self.trie.scores[nodes[whole]])
            depth += 1
            inside = at + depth < ends[owner[at]]
            at, nodes = at[inside], nodes[inside]
        # A letter without a piece becomes its bytes: such edges carry the letter's complement, which is below 0 for U+0000 too.
        bare = np.flatnonzero(lone)
        sizes = 1 + (letters[bare] > 0x7F) + (letters[bare] > 0x7FF) + (letters[bare] > 0xFFFF)
        starts.append(bare)
        stops.append(bare + 1)
        kinds.append(~letters[bare].astype(np.int32))
        scores.append(self.byte_score * sizes)
        starts, stops = np.concatenate(starts), np.concatenate(stops)
        word = owner[starts]
        return starts + word, stops + word, np.concatenate(kinds), np.concatenate(scores), stops - (ends[word] - np.diff(np.append(0, ends))[word])

    def _search(self, words: list[str]) -> WordPaths:
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = np.array([len(word) for word in words], np.int64)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(words)), lengths)
        start, stop, kind, score, column = self._edges(letters, owner, ends)
        first, last = ends - lengths + np.arange(len(words)), ends + np.arange(len(words))

        best = np.full(len(letters) + len(words), -np.inf)
        best[first] = 0.0
        # By column and end: one step relaxes all edges that end in the same column of their words.
        by = np.argsort(column * len(best) + stop)
        borders = np.searchsorted(column[by], np.arange(1, int(lengths.max()) + 2))
        ends_of, starts_of, scores_of = stop[by], start[by], score[by]
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            ends_here = ends_of[low:high]
            reached = best[starts_of[low:high]] + scores_of[low:high]
            heads = np.flatnonzero(np.concatenate(([True], ends_here[1:] != ends_here[:-1])))
            best[ends_here[heads]] = np.maximum.reduceat(reached, heads)

        # Edges by their end, then by the piece's id, in which order equal totals come; letters as bytes are last.
        names = np.where(kind >= 0, self.trie.ids[np.maximum(kind, 0)], len(self.trie.ids))
        into = np.argsort(stop * (len(self.trie.ids) + 1) + names)
        start, kind, score, names = start[into], kind[into], score[into], names[into]
        size = np.bincount(stop, minlength=len(best))
        head = np.cumsum(size) - size

        # Open states: word, place, score of the suffix, number in the chain of all states.
        word, place = np.arange(len(words)), last.copy()
        suffix, chain, piece = np.zeros(len(words)), np.arange(len(words)), np.zeros(len(words), names.dtype)
        parents, edges, made = [np.full(len(words), -1)], [np.full(len(words), -1)], len(words)
        found = np.zeros(len(words), np.int64)
        scores, tops = np.full((len(words), self.n_best), -np.inf), np.full((len(words), self.n_best), -1)
        while len(word):
            # States are ordered by word, then best first: the first of each word is opened.
            lead = np.concatenate(([True], word[1:] != word[:-1]))
            done = lead & (place == first[word])
            which = word[done]
            scores[which, found[which]], tops[which, found[which]] = suffix[done], chain[done]
            found[which] += 1
            grow = np.flatnonzero(lead & ~done)
            rest = np.flatnonzero(~lead)
            counts = size[place[grow]]
            edge, of = ragged(head[place[grow]], counts), np.repeat(grow, counts)
            numbers = made + np.arange(len(edge))
            parents.append(chain[of])
            edges.append(edge)
            made += len(edge)
            word = np.concatenate((word[rest], word[of]))
            place, suffix, chain, piece = (np.concatenate((old[rest], new)) for old, new in (
                (place, start[edge]), (suffix, suffix[of] + score[edge]), (chain, numbers), (piece, names[edge])))
            # Of equal totals the smaller piece comes first, then the older state.
            order = np.lexsort((piece, -(best[place] + suffix), word))
            word, place, suffix, chain, piece = word[order], place[order], suffix[order], chain[order], piece[order]
            at = np.arange(len(word))
            rank = at - np.maximum.accumulate(np.where(np.concatenate(([True], word[1:] != word[:-1])), at, 0))
            keep = rank < self.n_best - found[word]
            word, place, suffix, chain, piece = word[keep], place[keep], suffix[keep], chain[keep], piece[keep]
        parents, edges = np.concatenate(parents), np.concatenate(edges)
        best, others = (self._ids(paths.ravel(), parents, edges, kind) for paths in (tops[:, :1], tops[:, 1:]))
        return WordPaths(*best, scores[:, 0], found, *others, scores[:, :1] - scores[:, 1:])

    def _ids(self, tops: np.ndarray, parents: np.ndarray, edges: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the paths that end in the states ``tops``, from the front, and where every path starts; -1 is no path."""
        owners, kinds = [np.zeros(0, np.int64)], [np.zeros(0, kind.dtype)]
        word = np.flatnonzero(tops >= 0)
        state = tops[word]
        while len(word):
            live = edges[state] >= 0
            word, state = word[live], state[live]
            owners.append(word)
            kinds.append(kind[edges[state]])
            state = parents[state]
        owner, kinds = np.concatenate(owners), np.concatenate(kinds)
        # The steps come round by round; a stable sort puts every word's own behind each other.
        by = np.argsort(owner, kind="stable")
        owner, kinds = owner[by], kinds[by]
        if (kinds < 0).any():
            owner, ids = self._with_bytes(owner, kinds)
        else:
            ids = self.trie.ids[kinds]
        return ids, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(tops)))))

    def _with_bytes(self, owner: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters = np.maximum(~kinds.astype(np.int64), 0)
        sizes = np.where(kinds < 0, 1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF), 1)
        ids = np.repeat(self.trie.ids[np.maximum(kinds, 0)], sizes)
        places = np.cumsum(sizes) - sizes
        for at in np.flatnonzero(kinds < 0).tolist():
            raw = chr(int(letters[at])).encode("utf-8", "surrogatepass")
            ids[places[at]:places[at] + len(raw)] = self.byte_ids[list(raw)]
        return np.repeat(owner, sizes), ids
