"""SentencePiece N-best encoding and decoding (operator 2).

A text is normalised by the model and cut into units no piece can cross (a
white-space mark after another character).  The pieces of a unit form a
lattice over its characters: forward Viterbi gives the best score up to every
place, which is the exact heuristic of a backward A-star search that returns
the unit's segmentations best first.  The N best of the whole text follow from
those of its units: only the N - 1 units with the smallest loss of their second
segmentation can change within the N best.

A character without a piece becomes its byte pieces, at the least score of
the model minus 10.  Ties go to the smaller id sequence read from the end.
``decode`` turns ids back; with a model that keeps white space the round trip
is exact but for the mark itself, which decodes as a space.

Defined results: null and empty texts have no pieces and score 0.0; repeated
rows return one row each; an empty table an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigil.llm.common import map_texts, slices

N_BEST = 3
CACHE = 600_000       # distinct units kept by a worker before it starts anew
SLICE = 1_000_000      # characters whose units are learned together
MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """Vocabulary, lattice search and decoding of one model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        for i, p in enumerate(self.piece):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[p] = (0.0 - abs(sp.get_score(i)) if sp.get_score(i) > -1e8 else -1e8, i)
        real = [s for s, _ in self.score.values() if s > -1e8]
        self.unknown = min(real) - 10.0
        # pieces without a merge score (single characters) cost as much as the rarest piece
        self.score = {p: (s if s > -1e8 else min(real), i) for p, (s, i) in self.score.items()}
        self.longest = max(map(len, self.score))
        # a tree over characters: (next characters, score or None, id) of every start of a piece
        self.tree: dict = {}
        for p in sorted(self.score):
            at = self.tree
            for c in p[:-1]:
                at = at.setdefault(c, ({}, None, -1))[0]
            at[p[-1]] = ({}, *self.score[p])
        self.splits = all(MARK not in p.lstrip(MARK) for p in self.score)
        self.value_of_byte = {i: b for b, i in enumerate(self.byte)}
        # the same tree as sorted numbers: node * characters + character -> next node
        self.steps, self.cost, self.at = self._numbered()
        # what every id decodes to, one after another
        self.raw = _Laid([bytes([self.value_of_byte[i]]) if i in self.value_of_byte else p.replace(MARK, " ").encode("utf-8")
                          for i, p in enumerate(self.piece)])
        self.cache = _Learned()
        self.alternatives: dict[tuple[str, int], list] = {}

    def _numbered(self) -> tuple[tuple, np.ndarray, np.ndarray]:
        """((sorted moves, their ends), score of every node or nan, its id)."""
        chars = sorted({c for p in self.score for c in p})
        self.letter = np.full(0x110000 + 1, len(chars), np.int32)      # no piece has the others
        self.letter[[ord(c) for c in chars]] = np.arange(len(chars))
        moves, ends, cost, at, todo = [], [], [np.nan], [-1], [(0, self.tree)]
        self.letters = len(chars) + 1
        # characters that stand together in a piece, as sorted numbers
        self.pairs = np.array(sorted({int(self.letter[ord(a)]) * self.letters + int(self.letter[ord(b)])
                                      for p in self.score for a, b in zip(p, p[1:], strict=False)}) or [-1], np.int64)
        while todo:
            node, kids = todo.pop()
            for c, (further, score, piece) in kids.items():
                moves.append(node * self.letters + int(self.letter[ord(c)]))
                ends.append(len(cost))
                todo.append((len(cost), further))
                cost.append(np.nan if score is None else score)
                at.append(piece)
        o = np.argsort(moves)
        return (np.array(moves, np.int64)[o], np.array(ends, np.int64)[o]), np.array(cost), np.array(at, np.int64)

    def prepare(self, units) -> None:
        """Learn new units (each once) together: the Viterbi steps of units of like
        length run as arrays, but for rare ones (very long, with unknown characters,
        with a tie).  A unit is learned from the parts between its cuts: places
        whose two characters stand together in no piece."""
        new = [u for u in units if u not in self.cache.number]
        if not new:
            return
        text = "".join(new)
        code = self.letter[_codes(text)].astype(np.int64)
        end = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        pair = code[:-1] * self.letters + code[1:]
        cut = np.ones(len(code), bool)
        cut[1:] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair
        cut[end[:-1][end[:-1] < len(code)]] = True
        first = np.flatnonzero(cut)
        of = np.searchsorted(end, first, "right")
        many = np.bincount(of, minlength=len(new))
        shared = many[of] > 1
        parts = [text[i:j] for i, j in zip(first[shared].tolist(), np.append(first[1:], len(code))[shared].tolist(), strict=True)]
        single = np.flatnonzero(many <= 1).tolist()
        rest = sorted((u for u in {*parts, *map(new.__getitem__, single)} if u not in self.cache), key=len)
        sizes, low = [len(u) for u in rest], 0
        for top in (4, 8, 16, 32, 64):
            high = bisect_right(sizes, top)
            for i in range(low, high, 8192):
                self._together(rest[i:min(high, i + 8192)])
            low = high
        for u in rest:
            if u not in self.cache:
                score, ids, loss = self.best_two(u)
                self.cache.add([u], [score], np.frombuffer(ids, np.int32), [len(ids) // 4], [loss])
        if parts:
            self._joined([new[k] for k in np.flatnonzero(many > 1).tolist()], parts, many[many > 1])

    def _joined(self, units: list, parts: list, many: np.ndarray) -> None:
        """Learn units from their parts, ``many`` of each."""
        at = self.cache.numbers(parts)
        # a unit may be a part of another one
        fresh = np.array([u not in self.cache for u in units], bool)
        at, many, units = at[np.repeat(fresh, many)], many[fresh], [u for u, f in zip(units, fresh.tolist(), strict=True) if f]
        if not units:
            return
        end = np.cumsum(many)
        score, ends = self.cache.score.all()[at].tolist(), end.tolist()
        ids, edge = self.cache.take(at)
        self.cache.add(units, [sum(score[a:b]) for a, b in zip([0, *ends], ends, strict=False)], ids,
                       np.diff(edge[np.append(0, end)]), np.minimum.reduceat(self.cache.loss.all()[at], end - many))

    def _together(self, units: list) -> None:
        moves, ends = self.steps
        size = np.array([len(u) for u in units])
        n, width = len(units), int(size.max())
        text = np.full((n, width), self.letters - 1, np.int32)
        text[np.arange(width) < size[:, None]] = self.letter[_codes("".join(units))]
        one, two = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        start, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        one[0] = 0.0
        for i in range(width):
            who = np.flatnonzero((size > i) & (one[i] > -np.inf))
            node = np.zeros(len(who), np.int64)
            for j in range(i, width):
                move = node * self.letters + text[who, j]
                k = np.minimum(np.searchsorted(moves, move), len(moves) - 1)
                ok = moves[k] == move
                who, node = who[ok], ends[k[ok]]
                if not len(who):
                    break
                cost = self.cost[node]
                hit = np.flatnonzero(cost == cost)
                w, cost = who[hit], cost[hit]
                v, second, best, next_best = one[i, w] + cost, two[i, w] + cost, one[j + 1, w], two[j + 1, w]
                more = v > best
                two[j + 1, w] = np.where(more, np.maximum(best, second), np.maximum(next_best, v))
                one[j + 1, w] = np.maximum(best, v)
                start[j + 1, w[more]] = i
                piece[j + 1, w[more]] = self.at[node[hit[more]]]
        every = np.arange(n)
        score, other = one[size, every], two[size, every]
        good = (score > -np.inf) & (score != other)         # no unknown character, no tie
        here, who = np.where(good, size, 0), every
        of, ids, where = [], [], []
        while True:
            who = who[here[who] > 0]
            if not len(who):
                break
            of.append(who)
            ids.append(piece[here[who], who])
            where.append(here[who])
            here[who] = start[here[who], who]
        if not of:
            return
        of, ids, where = np.concatenate(of), np.concatenate(ids), np.concatenate(where)
        o = np.lexsort((where, of))
        t = np.flatnonzero(good)
        self.cache.add([units[k] for k in t.tolist()], score[t], ids[o], np.bincount(of, minlength=n)[t], score[t] - other[t])

    def best_two(self, unit: str) -> tuple[float, bytes, float]:
        """(best score, its ids, loss of the second segmentation) of a unit:
        forward Viterbi with the two best scores of every place."""
        tree, size = self.tree, len(unit)
        low = float("-inf")
        one, two, back = [0.0] + [low] * size, [low] * (size + 1), [None] * (size + 1)
        for i in range(size):
            here, second, kids, j = one[i], two[i], tree, i
            for c in unit[i:]:
                node = kids.get(c)
                if node is None:
                    break
                j += 1
                kids, cost, piece = node
                if cost is None:                         # the start of longer pieces only
                    continue
                v = here + cost
                if v > one[j]:
                    w = second + cost
                    two[j] = one[j] if one[j] > w else w
                    one[j] = v
                    back[j] = (i, piece)
                elif v > two[j]:
                    two[j] = v
            if unit[i] not in self.score:
                v = here + self.unknown
                if v > one[i + 1]:
                    two[i + 1] = max(one[i + 1], second + self.unknown)
                    one[i + 1], back[i + 1] = v, (i, None)
                elif v > two[i + 1]:
                    two[i + 1] = v
        if two[size] == one[size]:                       # a tie: the search decides
            ids = self.n_best(unit, 1)[0][1]
            return one[size], array("i", ids).tobytes(), 0.0
        ids, j = [], size
        while j:
            i, piece = back[j]
            if piece is None:
                ids.extend(self.byte[b] for b in reversed(unit[i:j].encode("utf-8", "replace")))
            else:
                ids.append(piece)
            j = i
        ids.reverse()
        return one[size], array("i", ids).tobytes(), one[size] - two[size]

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple]]]:
        """Per end place: (start, score, ids) of every piece that ends there."""
        n, known, out = len(unit), self.score, [[] for _ in range(len(unit) + 1)]
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                hit = known.get(unit[i:j])
                if hit is not None:
                    out[j].append((i, hit[0], (hit[1],)))
            if unit[j - 1] not in known:
                out[j].append((j - 1, self.unknown, tuple(self.byte[b] for b in unit[j - 1].encode("utf-8", "replace"))))
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple]]:
        """The ``n`` best segmentations of a unit: (score, ids), best first."""
        ends = self.edges(unit)
        best = [0.0] + [float("-inf")] * len(unit)
        for j in range(1, len(unit) + 1):
            best[j] = max(best[i] + s for i, s, _ in ends[j])
        found: list[tuple[float, tuple]] = []
        heap = [(-best[-1], (), len(unit), 0.0)]
        while heap and len(found) < n:
            _, ids, at, tail = heapq.heappop(heap)
            if at == 0:
                found.append((tail, ids[::-1]))
                continue
            for i, s, piece in ends[at]:
                heapq.heappush(heap, (-(best[i] + s + tail), ids + piece[::-1], i, s + tail))
        return found

    def units(self, text: str) -> list[str]:
        norm = self.sp.normalize(text)
        return UNIT.findall(norm) if self.splits else [norm]

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a text: (score, ids), best first."""
        return [(score, array("i", ids).tolist()) for best, _ in self.encode_all([text], n) for score, ids in best]

    def encode_all(self, texts: list, n: int = N_BEST):
        """Per text its ``n`` best segmentations, best first, as (score, ids as
        32-bit integers), and what the first decodes to."""
        for part in slices(texts, SLICE):
            if len(self.cache) > CACHE:
                self.cache.clear()
            known, at, edge = self._distinct_units(texts[part])
            self.prepare(known)
            yield from self._assembled(known, at, edge, n)

    def _distinct_units(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, number of every unit of the texts in order, where the
        units of each text begin and those of the last end): ``units`` of all at once."""
        norm = [self.sp.normalize(t).encode("utf-8") if t else b"" for t in texts]
        raw = b"".join(norm)
        first = np.concatenate([[0], np.cumsum([len(t) for t in norm], dtype=np.int64)])
        begins = np.zeros(len(raw) + 1, bool)
        if self.splits:
            buf = np.frombuffer(raw, np.uint8)
            a, b, c = MARK.encode("utf-8")
            at = np.flatnonzero(buf[:-2] == a)
            at = at[(buf[at + 1] == b) & (buf[at + 2] == c)]
            after = np.zeros(len(raw) + 1, bool)             # behind a mark
            after[at + 3] = True
            begins[at[~after[at]]] = True
        begins[first] = True
        begins[-1] = False
        start = np.flatnonzero(begins)
        coded = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(np.append(start, len(raw)).astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.searchsorted(start, first)

    def _assembled(self, known: list[str], at: np.ndarray, edge: np.ndarray, n: int):
        if not known:
            yield from [([(0.0, b"")], "")] * (len(edge) - 1)
            return
        number = self.cache.numbers(known)[at]
        score, loss = self.cache.score.all()[number].tolist(), self.cache.loss.all()[number]
        ids, id_end = self.cache.take(number)
        # the ids of the slice are decoded together; bytes of a character never stand in two texts
        back, back_end = self.raw.take(ids)
        back, ids = back.tobytes(), ids.tobytes()
        back_end = back_end[id_end[edge]].tolist()
        id_end, edge = (4 * id_end).tolist(), edge.tolist()
        for t, (a, b) in enumerate(zip(edge, edge[1:], strict=False)):
            if a == b:
                yield [(0.0, b"")], ""
                continue
            zero = id_end[a]
            base, first = sum(score[a:b]), ids[zero:id_end[b]]
            spelled = back[back_end[t]:back_end[t + 1]].decode("utf-8", "replace").removeprefix(" ")
            out = [(base, first)]
            # only the units of least loss can change within the n best
            least = np.argsort(loss[a:b], kind="stable")[:n - 1]
            where = np.sort(least[loss[a:b][least] < np.inf]).tolist()
            choices = [self.choices(known[at[a + k]], n) for k in where]
            # best first over the choices of these units; each state is reached from one other only
            heap = [(0.0, (0,) * len(where), 0)]
            chosen = []
            while heap and len(chosen) < n:
                lost, pick, low = heapq.heappop(heap)
                chosen.append((lost, pick))
                for d in range(low, len(where)):
                    c, r = choices[d], pick[d] + 1
                    if r < len(c):
                        heapq.heappush(heap, (lost + c[r - 1][0] - c[r][0], pick[:d] + (r,) + pick[d + 1:], d))
            for lost, pick in chosen[1:]:
                changed, done = [], 0
                for d, k in enumerate(where):
                    changed += [first[done:id_end[a + k] - zero], array("i", choices[d][pick[d]][1]).tobytes()]
                    done = id_end[a + k + 1] - zero
                out.append((base - lost, b"".join([*changed, first[done:]])))
            yield out, spelled

    def choices(self, unit: str, n: int) -> list[tuple[float, tuple]]:
        key = (unit, n)
        if key not in self.alternatives:
            if len(self.alternatives) > CACHE // 20:
                self.alternatives.clear()
            self.alternatives[key] = self.n_best(unit, n)
        return self.alternatives[key]

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text

    def spelled(self, ids) -> str:
        """The characters of a sequence of ids, marks as spaces.  The bytes of a
        character never stand in two units, so units can be spelled one by one."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.value_of_byte.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.piece[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _taken(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and where each begins and the last ends."""
    end = np.cumsum(size)
    pos = np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    return values[pos], np.concatenate([[0], end])


class _Laid:
    """Strings of bytes one after another, taken by number."""

    def __init__(self, known):
        self.size = np.array([len(v) for v in known], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(known), np.uint8)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _taken(self.bytes, self.first[at], self.size[at])


class _Grown:
    """An array that values are added to."""

    def __init__(self, kind):
        self.values, self.n = np.empty(1024, kind), 0

    def add(self, new) -> None:
        n = self.n + len(new)
        if n > len(self.values):
            self.values = np.concatenate([self.values[:self.n], np.empty(max(n, 1024), self.values.dtype)])
        self.values[self.n:n] = new
        self.n = n

    def all(self) -> np.ndarray:
        return self.values[:self.n]


class _Learned:
    """What is known of units: (best score, its ids, loss of the second
    segmentation), by unit or, as arrays, by number."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.score, self.loss = _Grown(float), _Grown(float)
        self.first, self.size, self.ids = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32)

    def __len__(self) -> int:
        return len(self.number)

    def __contains__(self, unit: str) -> bool:
        return unit in self.number

    def __getitem__(self, unit: str) -> tuple[float, bytes, float]:
        k = self.number[unit]
        a, n = self.first.values[k], self.size.values[k]
        return float(self.score.values[k]), self.ids.values[a:a + n].tobytes(), float(self.loss.values[k])

    def add(self, units: list, score, ids: np.ndarray, size, loss) -> None:
        """Further units, ``size`` ids of each one after another."""
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units)), strict=True))
        self.first.add(self.ids.n + np.cumsum(size) - size)
        for to, new in ((self.score, score), (self.loss, loss), (self.size, size), (self.ids, ids)):
            to.add(new)

    def numbers(self, units: list) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these, joined, and where each begins and the last ends."""
        return _taken(self.ids.all(), self.first.values[at], self.size.values[at])


_MODELS: dict = {}


def pieces_for(path: str) -> Pieces:
    """One model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", n: int = N_BEST) -> DataFrame:
    """(id, ids array<int> of the best segmentation, n_pieces, score,
    nbest_scores, nbest_sha256 of the id lists as 32-bit integers, round_trip) of every row."""
    def run(texts):
        m = pieces_for(model)
        ids, count, score, scores, digests, back = [], [], [], [], [], []
        for t, (best, spelled) in zip(texts, m.encode_all(texts, n), strict=True):
            ids.append(np.frombuffer(best[0][1], np.int32))
            count.append(len(ids[-1]))
            score.append(best[0][0])
            scores.append([s for s, _ in best])
            digests.append([hashlib.sha256(i).hexdigest() for _, i in best])
            back.append(spelled == (t or ""))
        return [ids, count, score, scores, digests, back]

    return map_texts(docs, [id_col], text, run, {
        "ids": "array<int>", "n_pieces": "long", "score": "double", "nbest_scores": "array<double>",
        "nbest_sha256": "array<string>", "round_trip": "boolean"})


def decode(encoded: DataFrame, model: str, keep: list[str], ids: str = "ids", out: str = "text") -> DataFrame:
    """``keep`` columns of every row and the text of its ``ids`` (null: null)."""
    def run(lists):
        m = pieces_for(model)
        return [[None if v is None else m.decode(v) for v in lists]]

    return map_texts(encoded, keep, ids, run, {out: "string"})
