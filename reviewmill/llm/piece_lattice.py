"""N-best segmentation into SentencePiece pieces, and back.

The lattice of a text has an edge for every piece that occurs in it; a path's
score is the sum of its pieces' scores.  A forward Viterbi pass gives the best
score up to every position, which is the exact remaining cost of a backward A*
search: the search expands only what the next best path needs.  No piece spans a
border from text to a space, so the lattice falls into words; the distinct words
of a few megabytes of text are searched together (``lattice_batch``), each once,
and the best paths of a text are merged from its words'.

Characters without a piece become their UTF-8 bytes; a byte scores below every
piece.  Equal scores come in a fixed order of piece ids.

Edge cases: a null or empty text has no pieces, score 0 and one empty path; a
text with ``▁`` decodes to a space there and reports ``round_trip`` false; a null
``doc_id`` stays null; repeated rows give repeated results; an empty table gives
no rows; other columns are ignored; texts are used whole.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice_batch import BatchSearch, WordPaths, ragged
from .word_ids import give_back, slices, strings, tidied

PIECES = public_tokenizers.path("piece_bpe_32k.model")
N_BEST = 2
#: Scores below are no scores but marks.
NEVER = -1e8
#: Longer words are searched one by one.
LONG_WORD = 2000
#: Text whose distinct words are searched together.
BYTES_AT_ONCE = 2 << 20
SPACE = "▁"
RESULT = """doc_id bigint, n_pieces bigint, ids_crc32 bigint, score double, second_score double, n_paths int,
    round_trip boolean"""

Path = tuple[float, tuple[int, ...]]


class Lattice:
    """The pieces of a model, searched word by word."""

    def __init__(self, model: str = PIECES, n_best: int = N_BEST):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n_best = n_best
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.surface: list[bytes] = []
        for piece in range(processor.get_piece_size()):
            name = processor.id_to_piece(piece)
            if processor.is_byte(piece):
                value = int(name[3:5], 16)
                self.bytes[value] = piece
                self.surface.append(bytes([value]))
            elif processor.is_control(piece) or processor.is_unknown(piece):
                self.surface.append(b"")
            else:
                self.surface.append(name.encode())
                self.ids[name] = (piece, processor.get_score(piece))
        ordinary = min(score for _, score in self.ids.values() if score > NEVER)
        self.byte_score = ordinary - 10.0
        # The model marks runs of spaces as never merged; here they are merely the least likely pieces.
        self.ids = {name: (piece, max(score, ordinary - 5.0)) for name, (piece, score) in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.batch = BatchSearch(self.ids, self.bytes, self.byte_score, n_best)
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.surface_sizes = np.array([len(raw) for raw in self.surface])
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes

    @cached_property
    def trie(self) -> dict[str, tuple[tuple[int, ...], float] | None]:
        """Every beginning of a piece, with the piece's ids and score where it is a whole one; only long words need it."""
        beginnings: dict[str, tuple[tuple[int, ...], float] | None] = {
            name[:end]: None for name in self.ids for end in range(1, len(name))}
        beginnings.update({name: ((piece,), score) for name, (piece, score) in self.ids.items()})
        return beginnings

    def edges(self, word: str) -> tuple[list[list[tuple[int, tuple[tuple[int, ...], float]]]], list[float]]:
        """For every end position the edges that lead to it (start, ids and score), and the best score up to it (Viterbi)."""
        find, longest, size = self.trie.get, self.longest, len(word)
        into: list[list] = [[] for _ in range(size + 1)]
        best = [0.0] + [-math.inf] * size
        for start in range(size):
            behind = best[start]
            if word[start] not in self.ids:
                raw = word[start].encode("utf-8", "surrogatepass")
                edge = (tuple([self.bytes[value] for value in raw]), self.byte_score * len(raw))
                into[start + 1].append((start, edge))
                if behind + edge[1] > best[start + 1]:
                    best[start + 1] = behind + edge[1]
            for end in range(start + 1, min(size, start + longest) + 1):
                edge = find(word[start:end], 0)
                if edge:
                    into[end].append((start, edge))
                    if behind + edge[1] > best[end]:
                        best[end] = behind + edge[1]
                elif edge == 0:
                    break
        return into, best

    def paths(self, word: str) -> list[Path]:
        """The best paths through a word's lattice: forward Viterbi, backward A*.

        Every open state stands for a complete path with exactly its total, so no more states are kept open than paths
        are still wanted.
        """
        into, best = self.edges(word)
        # A state is a suffix of the word: minus its exact best total, its pieces from the end, its start, its own score.
        states: list[tuple[float, tuple, int, float]] = [(-best[-1], (), len(word), 0.0)]
        found: list[Path] = []
        while states and len(found) < self.n_best:
            _, behind, at, score = states.pop(0)
            if at == 0:
                ids: list[int] = []
                while behind:
                    pieces, behind = behind
                    ids += pieces
                found.append((score, tuple(ids)))
                continue
            for start, (pieces, more) in into[at]:
                total = score + more
                states.append((-(best[start] + total), (pieces, behind), start, total))
            states.sort()
            del states[self.n_best - len(found):]
        return found

    def words(self, text: str) -> list[str]:
        """Cut a text, spaces as ``▁`` with one in front, where a space follows something else."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return [SPACE + part for part in parts]
        words, spaces = [], ""
        for part in parts:
            spaces += SPACE
            if part:
                words.append(spaces + part)
                spaces = ""
        return words + [spaces] if spaces else words

    def searched(self, words: list[str]) -> WordPaths:
        """The best paths of every word."""
        long = [at for at, word in enumerate(words) if len(word) > LONG_WORD]
        if not long:
            return self.batch.search(words)
        parts, after = [], 0
        for at in long:
            parts += [self.batch.search(words[after:at]), WordPaths.alone(self.paths(words[at]), self.n_best)]
            after = at + 1
        return WordPaths.joined([*parts, self.batch.search(words[after:])])

    def same_words(self, words: list[str], ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which words their ids decode to."""
        sizes = self.surface_sizes[ids]
        decoded = self.surface_bytes[ragged(self.surface_starts[ids], sizes)].tobytes()
        if decoded == "".join(words).encode("utf-8", "surrogatepass"):
            return np.ones(len(words), bool)
        ends = np.concatenate(([0], np.cumsum(sizes)))[starts].tolist()
        return np.array([decoded[low:high] == word.encode("utf-8", "surrogatepass")
                         for word, low, high in zip(words, ends[:-1], ends[1:])], bool)

    def split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts behind each other, without the first space of each, and every text's number of words."""
        plain = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE, " ")
        lists = pc.split_pattern(plain, " ")
        counts = np.asarray(pc.list_value_length(lists), np.int64)
        parts = lists.flatten()
        bare = np.flatnonzero(np.asarray(pc.equal(pc.binary_length(parts), 0), bool))
        if not len(bare):
            return parts, counts
        # Empty parts mean runs of spaces, which lead the next word, or an empty text.
        starts = np.cumsum(counts) - counts
        odd = np.unique(np.searchsorted(starts, bare, "right") - 1)
        pieces, at = [], 0
        for row in odd.tolist():
            words = [word[1:] for word in self.words(plain[row].as_py())]
            pieces += [parts.slice(at, int(starts[row]) - at), pa.array(words, pa.large_string())]
            at = int(starts[row] + counts[row])
            counts[row] = len(words)
        return pa.concat_arrays([*pieces, parts.slice(at)]), counts

    def best_of(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Per text of a column: its ids (all in a row, with ``starts``), the best score, what the second path loses,
        how many paths up to ``n_best``, and whether the ids decode to the text."""
        parts, counts = self.split(column)
        known = parts.dictionary_encode()
        words = [SPACE + part for part in strings(known.dictionary)]
        codes = np.asarray(known.indices, np.int64)
        paths = self.searched(words)
        same = self.same_words(words, paths.ids, paths.starts)
        sizes = np.diff(paths.starts)[codes]
        filled = np.flatnonzero(counts)
        heads = (np.cumsum(counts) - counts)[filled]

        def per_text(values: np.ndarray, fold: np.ufunc, empty) -> np.ndarray:
            result = np.full(len(counts), empty, values.dtype)
            if len(filled):
                result[filled] = fold.reduceat(values[codes], heads)
            return result

        marked = np.asarray(pc.fill_null(pc.match_substring(column, SPACE), False), bool)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        with np.errstate(over="ignore"):
            ways = per_text(paths.counts.astype(float), np.multiply, 1.0)
        return {
            "other_ids": paths.other_ids, "other_starts": paths.other_starts,
            "ids": paths.ids[ragged(paths.starts[:-1][codes], sizes)],
            "starts": ends[np.concatenate(([0], np.cumsum(counts)))],
            "score": per_text(paths.scores, np.add, 0.0), "loss": per_text(paths.losses, np.minimum, np.inf),
            "ways": np.minimum(ways, self.n_best).astype(np.int32),
            "same": per_text(same, np.logical_and, True) & ~marked,
            "others": self.other_paths(words, paths, codes, counts, same, marked),
        }

    def other_paths(self, words: list[str], paths: WordPaths, codes: np.ndarray, counts: np.ndarray, same: np.ndarray,
                    marked: np.ndarray) -> list[list[tuple[float, list[tuple[int, int, int]], bool]]]:
        """Per text its paths from the second on: what each loses, the places of the best path's ids (from, to) that a
        word's other path (its row in ``other_starts``) takes, and whether it decodes to the text."""
        rows = np.flatnonzero(paths.other_starts[1:] > paths.other_starts[:-1])
        other_same = np.zeros(len(paths.other_starts) - 1, bool)
        if len(rows):
            kept = np.concatenate(([0], np.cumsum(np.diff(paths.other_starts)[rows])))
            other_same[rows] = self.same_words([words[row // (self.n_best - 1)] for row in rows.tolist()], paths.other_ids, kept)
        sizes, losses, result, low = np.diff(paths.starts), paths.losses, [], 0
        for row, high in enumerate(np.cumsum(counts).tolist()):
            own = codes[low:high]
            low = high
            result.append([])
            places = self.open_places(losses[own]) if self.n_best > 1 and len(own) else []
            if not places:
                continue
            ends, wrong = np.cumsum(sizes[own]), np.flatnonzero(~same[own]).tolist()
            for loss, choice in self.ranked([[0.0, *paths.others[own[at], :paths.counts[own[at]] - 1].tolist()] for at in places])[1:]:
                taken = [(at, int(own[at]) * (self.n_best - 1) + rank - 1) for at, rank in zip(places, choice) if rank]
                held = not marked[row] and all(other_same[other] for _, other in taken) and set(wrong) <= {at for at, _ in taken}
                result[-1].append((loss, [(int(ends[at] - sizes[own[at]]), int(ends[at]), other) for at, other in taken], bool(held)))
        return result

    def open_places(self, losses: np.ndarray) -> list[int]:
        """Only the words with the smallest losses can take another path among the n best."""
        if self.n_best == 2:
            least = int(losses.argmin())
            return [least] if losses[least] < np.inf else []
        return sorted(at for at in np.argsort(losses, kind="stable")[:self.n_best - 1].tolist() if losses[at] < np.inf)

    def ranked(self, losses: list[list[float]]) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n_best`` choices of one path a place with the smallest sums of losses."""
        start = (0,) * len(losses)
        heap, seen, found = [(0.0, start)], {start}, []
        while heap and len(found) < self.n_best:
            loss, choice = heapq.heappop(heap)
            found.append((loss, choice))
            for slot, rank in enumerate(choice):
                other = (*choice[:slot], rank + 1, *choice[slot + 1:])
                if rank + 1 < len(losses[slot]) and other not in seen:
                    seen.add(other)
                    heapq.heappush(heap, (loss + losses[slot][rank + 1] - losses[slot][rank], other))
        return found

    def best(self, text: str) -> tuple[bytes, float, float, int, bool]:
        """Ids, score, what the second path loses, how many paths up to ``n_best``, and whether the ids decode to the text."""
        found = self.best_of(pa.array([text], pa.string()))
        return (found["ids"].astype("<u4").tobytes(), float(found["score"][0]), float(found["loss"][0]), int(found["ways"][0]),
                bool(found["same"][0]))

    def best_texts(self, text: str) -> list[Path]:
        """The ``n_best`` paths of a whole text, best first."""
        words = [self.paths(word) for word in self.words(text)]
        places = self.open_places(np.array([paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf for paths in words])) if words else []
        top = sum(paths[0][0] for paths in words)
        found = []
        for loss, choice in self.ranked([[words[at][0][0] - score for score, _ in words[at]] for at in places]):
            taken = dict(zip(places, choice))
            found.append((top - loss, sum((paths[taken.get(at, 0)][1] for at, paths in enumerate(words)), ())))
        return found

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        raw = b"".join([surface[piece] for piece in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "surrogatepass").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def lattice(model: str = PIECES, n_best: int = N_BEST) -> Lattice:
    """One lattice per worker process, so that its tables are built once."""
    built = Lattice(model, n_best)
    # What the building took and what earlier stages left.
    give_back()
    return built


def encode_pieces(docs: DataFrame, model: str = PIECES, n_best: int = N_BEST, with_ids: bool = False, with_path_ids: bool = False) -> DataFrame:
    """The ``n_best`` best segmentations of every text of ``docs(doc_id, text)`` and whether they decode to the text.

    The first is in columns of its own, ``paths`` has all, best first; ``with_path_ids`` adds their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = lattice(model, n_best)
        for batch in batches:
            for rows in slices(batch, most=BYTES_AT_ONCE):
                found = search.best_of(rows.column("text"))
                ids, starts = found["ids"].astype("<i4"), found["starts"]
                raw = memoryview(ids.tobytes())
                spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
                checks = [zlib.crc32(raw[4 * low:4 * high]) for low, high in spans]
                columns = {
                    "doc_id": rows.column("doc_id"), "n_pieces": np.diff(starts),
                    "ids_crc32": pa.array(checks, pa.int64()),
                    "score": found["score"],
                    "second_score": pa.array(found["score"] - found["loss"], mask=np.isinf(found["loss"])),
                    "n_paths": found["ways"], "round_trip": found["same"],
                    "paths": _paths(found, raw, spans, checks, with_path_ids),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    path = "score: double, n_pieces: bigint, ids_crc32: bigint, round_trip: boolean" + (", ids: array<int>" if with_path_ids else "")
    schema = f"{RESULT}, paths array<struct<{path}>>" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidied(run), schema)


def _paths(found: dict, raw: memoryview, spans: list[tuple[int, int]], checks: list[int], with_ids: bool) -> pa.Array:
    """Every path of every text: its ids are the best path's with some words' taken from other paths."""
    other_raw, other_starts = memoryview(found["other_ids"].astype("<i4").tobytes()), found["other_starts"]
    scores, sizes, sums, held, parts, ends = [], [], [], [], [], [0]
    for (low, high), check, score, same, others in zip(spans, checks, found["score"].tolist(), found["same"].tolist(), found["others"]):
        scores.append(score)
        sizes.append(high - low)
        sums.append(check)
        held.append(same)
        parts.append([raw[4 * low:4 * high]])
        for loss, taken, decodes in others:
            pieces, at = [], low
            for first, last, other in taken:
                pieces += [raw[4 * at:4 * (low + first)], other_raw[4 * int(other_starts[other]):4 * int(other_starts[other + 1])]]
                at = low + last
            pieces.append(raw[4 * at:4 * high])
            check = 0
            for piece in pieces:
                check = zlib.crc32(piece, check)
            scores.append(score - loss)
            sizes.append(sum(map(len, pieces)) // 4)
            sums.append(check)
            held.append(decodes)
            parts.append(pieces)
        ends.append(len(scores))
    columns = {"score": pa.array(scores, pa.float64()), "n_pieces": pa.array(sizes, pa.int64()),
               "ids_crc32": pa.array(sums, pa.int64()), "round_trip": pa.array(held, pa.bool_())}
    if with_ids:
        flat = np.frombuffer(b"".join(piece for pieces in parts for piece in pieces), "<i4")
        columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
