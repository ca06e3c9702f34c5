"""N-best segmentation into sentence pieces, and decoding (operator 4).

A text is a lattice: an edge for every vocabulary piece that matches, scored as in the model. A
forward Viterbi pass gives the best score from the start to every place; used as the heuristic of
a backward A-star search it is exact, so complete paths leave the queue best first.

The lattice factorises wherever no piece spans two neighbouring characters, so texts are cut there
and equal parts are solved once. The N best segmentations of a text differ from its best one only
in the N - 1 part occurrences whose second-best path loses least; those are searched and combined.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import bounded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Distinct words whose result a task keeps; beyond it the memory starts anew.
MAX_WORDS = 400_000
#: A character outside the vocabulary scores so much below the worst one-character piece.
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(r" +[^ ]*")


@dataclass
class Vocabulary:
    """scores: piece -> (id, score), a space for the word mark; texts: bytes of every id (empty
    for control pieces); byte_ids: id of each byte's fallback piece, or empty."""

    scores: dict[str, tuple[int, float]]
    texts: list[bytes]
    byte_ids: list[int]
    unknown: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, texts, byte_ids = {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                texts.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(b"")
            else:
                piece = piece.replace("▁", " ")
                scores[piece] = (i, model.get_score(i))
                texts.append(piece.encode())
        return Vocabulary(scores, texts, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], model.unk_id())


class Lattice:
    """Segmentation of parts of text with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.scores = vocabulary.scores
        self.prefixes = {p[:i] for p in self.scores for i in range(1, len(p))}
        self.joined = {p[i: i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.unknown_score = min((s for p, (_, s) in self.scores.items() if len(p) == 1), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown = vocabulary.byte_ids, vocabulary.unknown

    def parts(self, text: str) -> list[str]:
        """The text cut between neighbours that no piece joins."""
        cuts = [0, *(i for i in range(1, len(text)) if text[i - 1: i + 1] not in self.joined), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def edges(self, text: str) -> list[list[tuple[int, int, float]]]:
        """Per end: (start, piece id, score); id -1 for a character outside the vocabulary."""
        scores, prefixes, n = self.scores, self.prefixes, len(text)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                found = scores.get(piece)
                if found:
                    into[j].append((i, *found))
                elif j == i + 1:
                    into[j].append((i, -1, self.unknown_score))
                if piece not in prefixes:
                    break
        return into

    def forward(self, into) -> tuple[list[float], list[tuple[int, int, float] | None]]:
        """Best score to every place and the last edge there; of equals the longest edge."""
        best, back = [0.0] * len(into), [None] * len(into)
        for j in range(1, len(into)):
            top = -np.inf
            for edge in into[j]:
                score = best[edge[0]] + edge[2]
                if score > top:
                    top, back[j] = score, edge
            best[j] = top
        return best, back

    def second_loss(self, into, best, back) -> float:
        """What the second-best path loses: the best path through any edge off the best one."""
        n = len(into) - 1
        rest = [-np.inf] * (n + 1)
        rest[n] = 0.0
        for j in range(n, 0, -1):
            for i, _, s in into[j]:
                rest[i] = max(rest[i], rest[j] + s)
        on, j = set(), n
        while j:
            on.add((back[j][0], j))
            j = back[j][0]
        through = [best[i] + s + rest[j] for j in range(1, n + 1) for i, _, s in into[j] if (i, j) not in on]
        return best[n] - max(through, default=-np.inf)

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations (score, ids), best first: A-star from the end, with the
        forward scores as exact heuristic."""
        into = self.edges(text)
        best, _ = self.forward(into)
        queue = [(-best[-1], 0, len(text), 0.0, ())]
        found, order = [], 0
        while queue and len(found) < n:
            _, _, place, score, path = heapq.heappop(queue)
            if place == 0:
                found.append((score, self._ids(text, path)))
                continue
            for start, piece, s in into[place]:
                order += 1
                heapq.heappush(queue, (-(best[start] + s + score), order, start, score + s, ((start, place, piece), path)))
        return found

    def _ids(self, text: str, path) -> list[int]:
        ids: list[int] = []
        while path:
            (start, stop, piece), path = path
            ids += [piece] if piece >= 0 else self.fallback(text[start:stop])
        return ids

    def fallback(self, character: str) -> list[int]:
        return [self.byte_ids[b] for b in character.encode()] if self.byte_ids else [self.unknown]

    def solve(self, text: str) -> tuple[list[int], float, float]:
        """Best ids, their score, and what the second-best path loses."""
        into = self.edges(text)
        best, back = self.forward(into)
        ids, j = [], len(text)
        while j:
            i, piece, _ = back[j]
            ids = ([piece] if piece >= 0 else self.fallback(text[i:j])) + ids
            j = i
        return ids, best[-1], self.second_loss(into, best, back)


class BatchSolver:
    """Lattice.solve for many parts at once: parts of one length form a matrix, pieces are found
    by a rolling hash of every substring, and both Viterbi passes run over all rows together."""

    SLOT_BITS = 20
    LONGEST_PART = 40
    _BASE = np.uint64(0x9E3779B97F4A7C15)
    _MIX = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        self.longest = max(map(len, lattice.scores), default=0)
        keys = np.array([self._hash(p) for p in lattice.scores], np.uint64)
        self.slots = np.zeros(1 << self.SLOT_BITS, np.int32)  # 1 + row of the piece, chains by probing
        self.keys = np.append(np.uint64(0), keys)
        self.ids = np.array([-1, *(i for i, _ in lattice.scores.values())], np.int32)
        self.scores = np.array([-np.inf, *(x for _, x in lattice.scores.values())])
        self.probes = 1
        for row, slot in enumerate(self._slot(keys).tolist(), 1):
            step = 0
            while self.slots[(slot + step) % len(self.slots)]:
                step += 1
            self.slots[(slot + step) % len(self.slots)] = row
            self.probes = max(self.probes, step + 1)

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self._BASE) + ord(c) + 1) % 2**64
        return h

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys ^ (keys >> np.uint64(29))) * self._MIX
        return (mixed >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        row = self.slots[slot]
        row = np.where(self.keys[row] == keys, row, 0) if self.probes == 1 else row
        for step in range(1, self.probes):
            if step == 1:
                open_ = np.nonzero((row > 0) & (self.keys[row] != keys))
                first, wanted = slot[open_], keys[open_]
                row[open_] = 0
            if not len(first):
                break
            at = self.slots[(first + step) % len(self.slots)]
            hit = (at > 0) & (self.keys[at] == wanted)
            where = tuple(x[hit] for x in open_)
            row[where] = at[hit]
            go = ~hit & (at > 0)
            open_, first, wanted = tuple(x[go] for x in open_), first[go], wanted[go]
        return row

    def solve(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """Ids (int32 bytes), score and second-best loss of every part."""
        out: list = [None] * len(parts)
        sizes = np.array([len(p) for p in parts], np.int64)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            if n <= self.LONGEST_PART:
                for at in range(0, len(rows), 8192):
                    self._solve_equal([parts[i] for i in rows[at: at + 8192]], int(n), rows[at: at + 8192], out)
        for i, x in enumerate(out):
            if x is None:  # very long parts, and parts with characters outside the vocabulary
                ids, score, loss = self.lattice.solve(parts[i])
                out[i] = (np.array(ids, np.int32).tobytes(), score, loss)
        return out

    def _solve_equal(self, parts: list[str], n: int, rows: np.ndarray, out: list) -> None:
        m = len(parts)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, n).T.astype(np.uint64) + np.uint64(1)
        found, scores = [None], [None]
        keys = np.zeros_like(codes)
        for length in range(1, min(n, self.longest) + 1):
            with np.errstate(over="ignore"):
                keys = keys[: n - length + 1] * self._BASE + codes[length - 1:]
            found.append(self._find(keys))
            scores.append(self.scores[found[-1]])
        unknown = found[1] == 0
        scores[1][unknown] = self.lattice.unknown_score
        best, back = np.zeros((n + 1, m)), np.zeros((n + 1, m), np.int8)
        rest = np.zeros((n + 1, m))
        for j in range(1, n + 1):
            top = np.full(m, -np.inf)
            for length in range(min(j, len(scores) - 1), 0, -1):
                score = best[j - length] + scores[length][j - length]
                higher = score > top
                top[higher] = score[higher]
                back[j][higher] = length
            best[j] = top
        for i in range(n - 1, -1, -1):
            top = np.full(m, -np.inf)
            for length in range(1, min(n - i, len(scores) - 1) + 1):
                np.maximum(top, rest[i + length] + scores[length][i], out=top)
            rest[i] = top
        through = [None, *(best[: n - length + 1] + scores[length] + rest[length:] for length in range(1, len(scores)))]
        column = np.arange(m)
        place, steps = np.full(m, n), []
        odd = np.zeros(m, bool)
        for _ in range(n):
            ids = np.full(m, -1, np.int32)
            length = np.where(place > 0, back[place, column], 0)
            for size in np.unique(length[length > 0]):
                at = np.flatnonzero(length == size)
                start = place[at] - size
                row = found[size][start, at]
                ids[at] = self.ids[row]
                odd[at[row == 0]] = True
                through[size][start, at] = -np.inf
            place -= length
            steps.append(ids)
            if not place.any():
                break
        second = np.full(m, -np.inf)
        for x in through[1:]:
            np.maximum(second, x.max(0), out=second)
        chosen = np.array(steps[::-1]).T
        used = chosen >= 0
        flat = chosen[used].astype(np.int32).tobytes()
        ends = np.cumsum(used.sum(1)) * 4
        at = 0
        for row, end, score, loss, skip in zip(rows.tolist(), ends.tolist(), best[n].tolist(), (best[n] - second).tolist(), odd.tolist(), strict=True):
            if not skip:
                out[row] = (flat[at:end], score, loss)
            at = end


class Encoder:
    """Encodes whole texts; remembers words and parts it has solved."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.lattice, self.n = Lattice(vocabulary), n
        self.solver = BatchSolver(self.lattice)
        # characters as dense numbers, and which neighbours some piece joins
        pairs = sorted(self.lattice.joined)
        letters = sorted({c for x in pairs for c in x})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        if pairs:
            first, second = np.array([[ord(x[0]), ord(x[1])] for x in pairs]).T
            self.joins[self.number[first], self.number[second]] = True
        self.clear()

    def clear(self):
        self.words: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.scores = np.zeros(0)
        self.losses = np.zeros(0)  # smallest second-best loss in the word
        self.parts: dict[str, int] = {}
        self.part_ids: list[bytes] = []
        self.part_scores = np.zeros(0)
        self.part_losses = np.zeros(0)
        self.alternatives: dict[str, list[tuple[float, bytes]]] = {}

    def _split(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all words, and the place of each word's first part."""
        text = "".join(words)
        numbers = self.number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.ones(len(numbers) + 1, bool)
        cut[1:-1] = ~self.joins[numbers[:-1], numbers[1:]]
        begins = np.zeros(len(words), np.int64)
        np.cumsum([len(w) for w in words[:-1]], out=begins[1:])
        cut[begins] = True
        at = np.flatnonzero(cut)
        ends = at.tolist()
        return [text[a:b] for a, b in zip(ends, ends[1:], strict=False)], np.searchsorted(at, begins)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        split, first = self._split(words)
        new = [p for p in dict.fromkeys(split) if p not in self.parts]
        solved = self.solver.solve(new)
        self.parts.update(zip(new, range(len(self.part_ids), len(self.part_ids) + len(new)), strict=True))
        self.part_ids += [x[0] for x in solved]
        self.part_scores = np.append(self.part_scores, [x[1] for x in solved])
        self.part_losses = np.append(self.part_losses, [x[2] for x in solved])
        where = list(map(self.parts.__getitem__, split))
        self.words.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))
        bounds = [*first.tolist(), len(where)]
        self.ids += [self.part_ids[where[a]] if b - a == 1 else b"".join([self.part_ids[i] for i in where[a:b]]) for a, b in zip(bounds, bounds[1:], strict=False)]
        where = np.array(where, np.int64)
        self.scores = np.append(self.scores, np.add.reduceat(self.part_scores[where], first))
        self.losses = np.append(self.losses, np.minimum.reduceat(self.part_losses[where], first))

    def _weak(self, place: int, word: str) -> list[tuple[float, int, int, str]]:
        """The n - 1 parts of the word at a place that lose least by their second-best path: loss,
        place of the word, place of the part in it, part."""
        found = [(float(self.part_losses[self.parts[p]]), place, i, p) for i, p in enumerate(self.lattice.parts(word))]
        return heapq.nsmallest(self.n - 1, (x for x in found if x[0] < np.inf))

    def _alternatives(self, part: str) -> list[tuple[float, bytes]]:
        """What the n best paths of a part lose, and their ids; the remembered best path first."""
        held = self.alternatives.get(part)
        if held is None:
            paths = self.lattice.n_best(part, self.n)
            first = self.part_ids[self.parts[part]]
            others = [x for x in (np.array(ids, np.int32).tobytes() for _, ids in paths) if x != first]
            held = self.alternatives[part] = [(paths[0][0] - s, x) for (s, _), x in zip(paths, [first, *others], strict=False)]
        return held

    def prepare(self, texts: list[str]) -> None:
        """Solve all new words of a slice of texts together."""
        if len(self.words) > MAX_WORDS:
            self.clear()
        known = self.words
        new = {w for x in texts if x for w in _WORD.findall(" " + x) if w not in known}
        self._learn(list(new))

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        """The best segmentation's ids (int32) and the scores of the n best, best first."""
        paths = self.encode_n(text)
        return paths[0][1], [score for score, _ in paths]

    def encode_n(self, text: str) -> list[tuple[float, bytes]]:
        """The n best segmentations (score, ids as int32), best first."""
        raw, paths = self.encode_changes(text)
        return [(score, changed_ids(raw, changes)) for score, changes in paths]

    def encode_changes(self, text: str) -> tuple[bytes, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """The best segmentation's ids, and per segmentation, best first, its score and what it
        changes in them, in order: place, number of ids there, ids instead."""
        if not text:
            return b"", [(0.0, [])]
        words = _WORD.findall(" " + text)
        at = list(map(self.words.get, words))
        if None in at:
            self._learn(list({w for w in words if w not in self.words}))
            at = list(map(self.words.__getitem__, words))
        where = np.array(at, np.int64)
        score = float(self.scores[where].sum())
        best = list(map(self.ids.__getitem__, at))
        totals: list[tuple[float, tuple]] = [(0.0, ())]
        if self.n > 1:
            losses = self.losses[where]
            lose = np.argpartition(losses, self.n - 1)[: self.n - 1].tolist() if len(at) >= self.n else range(len(at))
            weak = heapq.nsmallest(self.n - 1, (x for i in lose for x in self._weak(i, words[i])))
            for _, word, part, name in weak:
                place = sum(map(len, best[:word])) + sum(len(self.part_ids[self.parts[p]]) for p in self.lattice.parts(words[word])[:part])
                size = len(self.part_ids[self.parts[name]])
                ways = [(loss, ((place // 4, size // 4, ids),) if k else ()) for k, (loss, ids) in enumerate(self._alternatives(name))]
                totals = heapq.nsmallest(self.n, ((a + b, x + y) for a, x in totals for b, y in ways), key=lambda t: t[0])
        return b"".join(best), [(score - loss, sorted(changes)) for loss, changes in totals]


def changed_ids(raw: bytes, changes: list[tuple[int, int, bytes]]) -> bytes:
    """Ids (int32) with the changes of one segmentation."""
    out, at = [], 0
    for place, size, ids in changes:
        out += [raw[at: 4 * place], ids]
        at = 4 * (place + size)
    return b"".join([*out, raw[at:]])


def decode_ids(ids: np.ndarray, texts: list[bytes]) -> str:
    """The text of piece ids: their bytes joined, without the space set before the text."""
    return b"".join(map(texts.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_CHANGES = pa.list_(pa.list_(pa.struct([("place", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def _encode(shared, n: int, with_ids: bool):
    def run(batches):
        import hashlib

        vocabulary = Vocabulary(*shared.value)
        encoder = Encoder(vocabulary, n)
        for b in bounded(batches, 1):
            ids, changes, counts, scores, shas, right = [], [], [], [], [], []
            texts = [x or "" for x in b.column(1).to_pylist()]
            encoder.prepare(texts)
            for text in texts:
                raw, found = encoder.encode_changes(text)
                numbers = np.frombuffer(raw, np.int32)
                counts.append(len(numbers))
                scores.append([score for score, _ in found])
                shas.append(hashlib.sha256(raw).hexdigest())
                right.append(decode_ids(numbers, vocabulary.texts) == text)
                if with_ids:
                    ids.append(numbers)
                    changes.append([[(p, n, np.frombuffer(x, np.int32)) for p, n, x in path] for _, path in found])
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array([x[0] for x in scores], pa.float64()), pa.array(scores, pa.list_(pa.float64())), pa.array(shas, pa.string()), pa.array(right, pa.bool_())]
            names = ["doc_id", "n_pieces", "score", "nbest_scores", "ids_sha256", "round_trip"]
            if with_ids:
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(changes, _CHANGES)]
                names += ["ids", "nbest_changes"]
            yield pa.record_batch(columns, names=names)

    return run


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """Segment every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns a row per input row: doc_id, n_pieces and score of the best segmentation,
    nbest_scores (the n best, best first; fewer if there are fewer paths), ids_sha256 (of the ids
    as little-endian int32), round_trip (the ids decode to the text) and, ``with_ids``, ids (of the
    best segmentation) and nbest_changes: for each of the n best, in the order of nbest_scores, the
    places where it differs from ids (place from 0, size: ids replaced, ids: those instead; none
    for the best). ``n_best_ids`` writes all paths out. A null text counts as empty, and an empty text has no pieces and score 0. Characters outside
    the vocabulary become their bytes' pieces. Rows are worked on alone, so null ids and repeated
    rows pass through; no rows give no rows. The vocabulary is read on the driver from ``model``
    and broadcast; its size is fixed by that file.
    """
    vocabulary = Vocabulary.load(model)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.scores, vocabulary.texts, vocabulary.byte_ids, vocabulary.unknown))
    schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, ids_sha256 string, round_trip boolean" + (", ids array<int>, nbest_changes array<array<struct<place:int,size:int,ids:array<int>>>>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_encode(shared, n, with_ids), schema)


def n_best_ids(encoded: DataFrame) -> DataFrame:
    """The n best segmentations of encoded rows (doc_id, ids, nbest_scores, nbest_changes) written
    out: doc_id, nbest_scores, nbest_ids (the ids of each). Null ids give null."""
    path = "array<int>"

    def change(done, c):
        # the ids so far run up to place `at` of the best path
        return F.struct(F.concat(done["ids"], F.slice("ids", done["at"] + 1, c["place"] - done["at"]), c["ids"]).alias("ids"), (c["place"] + c["size"]).alias("at"))

    start = F.struct(F.array().cast(path).alias("ids"), F.lit(0).alias("at"))
    end = lambda done: F.concat(done["ids"], F.slice("ids", done["at"] + 1, F.size("ids")))
    every = F.transform("nbest_changes", lambda changes: F.aggregate(changes, start, change, end))
    return encoded.select("doc_id", "nbest_scores", every.alias("nbest_ids"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Texts of encoded rows (doc_id, ids): doc_id, text. Null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model).texts)

    def run(batches):
        for b in batches:
            texts = [decode_ids(x.values.to_numpy(zero_copy_only=False), shared.value) if x.is_valid else None for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
