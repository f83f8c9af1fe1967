"""N-best SentencePiece segmentation by forward Viterbi and backward A* search, and decoding.

The lattice of a text holds every piece of a public vocabulary that matches, and bytes for characters
no piece covers. A piece of rank r costs round(1000 ln(r + 2)); costs are whole numbers, so sums are exact.
The cheapest cost from the beginning to each place (Viterbi) is an exact heuristic for a search that
runs backward from the end: it pops segmentations in order of cost.

No piece reaches across a blank, so the lattice is a single node there: words are analysed one by one, and
each once per worker process as far as memory goes. The n best of a text differ from the best in at most n - 1 words, and only in those
whose second best costs least more; the search runs over these words and takes all others as fixed.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from palimpsest.llm.blocks import mix

BLANK = "▁"
N_BEST = 4
BYTE_COST = 12_000
CACHE_WORDS = 160_000  # of each of the two generations a worker keeps
FAR = 1 << 60
LATTICES = 4_000  # of words whose second best is near, kept by a worker
MANY = 2_000  # words of one length that are settled together
LONG = 48  # characters of a word that may be settled with others
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


class Slots:
    """Where 64-bit keys stand in an array: a table of places by the keys' upper bits, with a few tries from there on."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, (16 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.places, self.tries = np.zeros(1 << bits, dtype=np.int32), 1
        self.keys = np.concatenate([[np.uint64(0)], keys])  # place 0 is no key; no piece has the hash 0
        used = np.zeros(1 << bits, dtype=bool)
        for place, slot in enumerate((mix(keys) >> self.shift).astype(np.int64).tolist(), 1):
            first = slot
            while used[slot]:
                slot = (slot + 1) & int(self.mask)
            used[slot], self.places[slot] = True, place
            self.tries = max(self.tries, ((slot - first) & int(self.mask)) + 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the array of keys, whether it is there) of each key."""
        slot = (mix(keys) >> self.shift).astype(np.int64)
        at = self.places[slot]
        there = self.keys[at] == keys
        for _ in range(1, self.tries):
            open_ = np.nonzero(~there & (at > 0))
            if not len(open_[0]):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            at[open_] = self.places[slot[open_]]
            there[open_] = self.keys[at[open_]] == keys[open_]
        return np.maximum(at - 1, 0), there


def model_pieces(path: str) -> list:
    """The pieces of a model file, by id: `piece` (the text) and `type` (1: normal, 6: a byte)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return model.pieces


class Decoder:
    """Bytes of each id; all that decoding needs, so workers that only decode hold no more."""

    def __init__(self, path: str) -> None:
        made = {1: lambda text: text.replace(BLANK, " ").encode(), 6: lambda text: bytes([int(text[3:5], 16)])}
        self.bytes = [made[p.type](p.piece) if p.type in made else b"" for p in model_pieces(path)]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded; the blank before its first word is dropped."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Pieces:
    """The pieces of a model file for encoding: ids and costs by text, and ids of bytes."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.cost: dict[str, tuple[int, int]] = {}
        self.byte_id, rank = {}, 0
        for number, piece in enumerate(model_pieces(path)):
            if piece.type == 6:
                self.byte_id[int(piece.piece[3:5], 16)] = number
            elif piece.type == 1 and BLANK not in piece.piece[1:]:
                self.cost[piece.piece] = (round(1000 * math.log(rank + 2)), number)
                rank += 1
        self.pairs = {a + b for p in self.cost for a, b in zip(p, p[1:])}
        #: Cost and id of each piece and, as None, every beginning of one: what is not here leads to no piece.
        self.ways: dict[str, tuple[int, int] | None] = {p[:i]: None for p in self.cost for i in range(1, len(p))} | self.cost
        #: Pieces by length: hashes in ascending order, with costs and ids. Hashes of 64 bits, each piece's checked to be its own.
        found: dict[int, list[tuple[int, int, int]]] = {}
        for piece, (cost, number) in self.cost.items():
            own = 0
            for char in piece:
                own = (own * int(HASH_BASE) + ord(char) + 1) & 0xFFFFFFFFFFFFFFFF
            found.setdefault(len(piece), []).append((own, cost, number))
        self.by_length = {n: tuple(np.array(c, dtype=k) for c, k in zip(zip(*sorted(rows)), (np.uint64, np.int32, np.int32))) for n, rows in sorted(found.items())}
        self.slots = {n: Slots(rows[0]) for n, rows in self.by_length.items()}
        self.powers = {n: np.uint64(pow(int(HASH_BASE), n, 1 << 64)) for n in self.by_length}

    def decode(self, ids: list[int]) -> str:
        return decoder(self.path).decode(ids)

    def of_bytes(self, char: str) -> tuple[int, tuple[int, ...]]:
        """Cost and ids of a character that no piece covers."""
        data = char.encode()
        return BYTE_COST * len(data), tuple(self.byte_id[b] for b in data)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


class Lattice:
    """Pieces of a word ending at each place: (begin, cost, ids), and Viterbi costs from the beginning.

    The word's first character is its blank; any other \u2581 is a character of the text, written as bytes.
    """

    def __init__(self, word: str, table: Pieces) -> None:
        n, ways = len(word), table.ways
        self.into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for begin in range(n):
            single = False
            for end in range(begin + 1, n + 1) if begin == 0 or word[begin] != BLANK else ():
                found = ways.get(word[begin:end], False)
                if found is False:
                    break
                if found:
                    self.into[end].append((begin, found[0], (found[1],)))
                    single |= end == begin + 1
            if not single:
                self.into[begin + 1].append((begin, *table.of_bytes(word[begin])))
        self.best = [0] + [FAR] * n
        for end in range(1, n + 1):
            self.best[end] = min(self.best[begin] + c for begin, c, _ in self.into[end])


def two_best(word: str, table: Pieces) -> tuple[bytes, int, int]:
    """The cheapest segmentation (ids as little-endian 32-bit bytes), its cost, and how much more the second best costs.

    Forward Viterbi that keeps the two least costs at each place; of equal ways the one whose last piece
    begins first is taken. From each place on, ever longer parts are looked up until no piece begins like that.
    """
    n, ways = len(word), table.ways
    least, second = [0] + [FAR] * n, [FAR] * (n + 1)
    back: list = [None] * (n + 1)
    for begin in range(n):
        here, other, single = least[begin], second[begin], False
        for end in range(begin + 1, n + 1) if begin == 0 or word[begin] != BLANK else ():
            found = ways.get(word[begin:end], False)
            if found is False:
                break
            if found:
                more, ids = found
                cost = here + more
                if end == begin + 1:
                    single = True
                if cost < least[end]:
                    last = other + more
                    second[end] = least[end] if least[end] < last else last
                    least[end], back[end] = cost, (begin, ids)
                elif cost < second[end]:
                    second[end] = cost
        if not single:
            more, ids = table.of_bytes(word[begin])
            cost, end = here + more, begin + 1
            if cost < least[end]:
                second[end] = min(least[end], other + more)
                least[end], back[end] = cost, (begin, ids)
            elif cost < second[end]:
                second[end] = cost
    out: list[int] = []
    end = n
    while end:
        end, ids = back[end]
        if type(ids) is int:
            out.append(ids)
        else:
            out.extend(reversed(ids))
    out.reverse()
    return array("I", out).tobytes(), least[n], second[n] - least[n]


def two_best_of_many(words: list[str], table: Pieces) -> list[tuple[bytes, int, int]]:
    """The same as `two_best` for many words at once: words of one length stand in rows, and every length of piece is looked up for all places together."""
    out: list = [None] * len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        for first in range(0, len(places), MANY):
            some = places[first : first + MANY]
            if not 0 < n <= LONG:
                for i in some.tolist():
                    out[i] = two_best(words[i], table)
                continue
            points = np.frombuffer("".join([words[i] for i in some.tolist()]).encode("utf-32-le"), dtype="<u4").reshape(len(some), n)
            least, second, back, ids = _forward(points, table)
            for i, found in zip(some.tolist(), zip(_backward(back, ids, table), least.tolist(), (second - least).tolist())):
                out[i] = found
    return out


def _forward(points: np.ndarray, table: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least and second costs of whole rows, and the length and id of the last piece of the best way to each place (-2 - code point: as bytes)."""
    m, n = points.shape
    hashes = np.zeros((m, n + 1), dtype=np.uint64)
    for i in range(n):
        hashes[:, i + 1] = hashes[:, i] * HASH_BASE + points[:, i] + np.uint64(1)
    far = 1 << 29  # costs of a word of at most LONG characters are far below, and two of these still fit into 32 bits
    costs, ids, rows = {}, {}, {}
    inner = np.zeros((m, n), dtype=bool)
    inner[:, 1:] = points[:, 1:] == ord(BLANK)
    for size, (_, own_costs, own_ids) in table.by_length.items():
        if size > n:
            continue
        key = hashes[:, size:] - hashes[:, : n + 1 - size] * table.powers[size]
        at, there = table.slots[size].find(key)
        there &= ~inner[:, : n + 1 - size]
        costs[size], ids[size] = np.where(there, own_costs[at], np.int32(far)), own_ids[at]
        if size > 1:
            for begin, count in enumerate(there.sum(axis=0).tolist()):
                rows[size, begin] = np.flatnonzero(there[:, begin]) if count < m // 6 else slice(None)
        if size == 1:  # what no piece covers goes as bytes
            in_bytes = (BYTE_COST * (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))).astype(np.int32)
            costs[1], ids[1] = np.where(there, costs[1], in_bytes), np.where(there, ids[1], -2 - points.astype(np.int32))
    least, second = np.full((n + 1, m), far, dtype=np.int32), np.full((n + 1, m), far, dtype=np.int32)
    back, last = np.zeros((n + 1, m), dtype=np.int32), np.zeros((n + 1, m), dtype=np.int32)
    least[0] = 0
    for end in range(1, n + 1):
        for size in sorted(costs, reverse=True):  # of equal ways the longer last piece stays
            own = rows.get((size, end - size), slice(None)) if size <= end else np.zeros(0)  # only words that have such a piece there, if they are few
            if not isinstance(own, slice) and not len(own):
                continue
            more, low = costs[size][own, end - size], least[end, own]
            cost = least[end - size, own] + more
            better = cost < low
            second[end, own] = np.where(better, np.minimum(low, second[end - size, own] + more), np.minimum(second[end, own], cost))
            least[end, own] = np.where(better, cost, low)
            back[end, own] = np.where(better, size, back[end, own])
            last[end, own] = np.where(better, ids[size][own, end - size], last[end, own])
    return least[n].astype(np.int64), np.where(second[n] >= far, FAR, second[n].astype(np.int64)), back, last


def _backward(back: np.ndarray, ids: np.ndarray, table: Pieces) -> list[bytes]:
    """Ids of each row's best way, as little-endian 32-bit bytes."""
    n, m = back.shape[0] - 1, back.shape[1]
    rows, place = np.arange(m), np.full(m, n)
    steps = np.full((m, n), -1, dtype=np.int64)
    for i in range(n):
        steps[:, n - 1 - i] = np.where(place > 0, ids[place, rows], -1)
        place = place - np.where(place > 0, np.maximum(back[place, rows], 1), 0)
        if not place.any():
            break
    used = steps != -1
    ends = np.cumsum(used.sum(axis=1)) * 4
    data = steps[used].astype("<i4").tobytes()
    out = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    for row in np.flatnonzero((steps < -1).any(axis=1)).tolist():
        own = steps[row][used[row]].tolist()
        out[row] = array("I", [i for x in own for i in ((x,) if x >= 0 else table.of_bytes(chr(-2 - x))[1])]).tobytes()
    return out


def search(lattices: list[Lattice], n: int, most: int = FAR) -> list[tuple[int, list[tuple[int, ...]]]]:
    """The n cheapest segmentations of a row of lattices: (cost, ids of each lattice), cheapest first.

    Backward A*: a state is a place in a lattice; its cost so far plus the Viterbi costs of what stands before
    is the cost of its best completion, so states are popped in the order of final costs. States beyond `most` are left
    out; the caller knows n segmentations that cost no more.
    """
    before = [0]
    for lattice in lattices:
        before.append(before[-1] + lattice.best[-1])
    start = (len(lattices) - 1, len(lattices[-1].into) - 1) if lattices else (-1, 0)
    agenda, tick, out = [(before[-1], 0, 0, *start, ())], 0, []
    while agenda and len(out) < n:
        total, _, spent, at, end, path = heapq.heappop(agenda)
        while at >= 0 and end == 0:
            at -= 1
            end = len(lattices[at].into) - 1 if at >= 0 else 0
        if at < 0:
            ids: list[list[tuple[int, ...]]] = [[] for _ in lattices]
            while path:
                (where, some), path = path
                ids[where].append(some)
            out.append((total, [tuple(i for some in part for i in some) for part in ids]))
            continue
        best, front = lattices[at].best, before[at] + spent
        for begin, cost, ids_ in lattices[at].into[end]:
            total = front + best[begin] + cost
            if total <= most:
                tick -= 1  # of equal states the latest goes on, so ties cost no more than one path each
                heapq.heappush(agenda, (total, tick, spent + cost, at, begin, ((at, ids_), path)))
    return out


class Segmenter:
    """Encodes whole texts; remembers what is known of each word, up to two generations of CACHE_WORDS: when the newer one
    is full it becomes the older, and words met again move on."""

    def __init__(self, path: str, n: int = N_BEST) -> None:
        self.table, self.n = pieces(path), n
        self.lattice = lru_cache(maxsize=LATTICES)(lambda word: Lattice(BLANK + word, self.table))
        self.last = lru_cache(maxsize=LATTICES)(self._last)
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.old: dict[str, tuple[bytes, int, int]] = {}

    def _last(self, char: str) -> tuple[int, bytes]:
        """Cost and ids of a character by itself."""
        cost, ids = self.table.cost[char] if char in self.table.cost else self.table.of_bytes(char)
        return cost, array("I", [ids] if type(ids) is int else ids).tobytes()

    def _with_last(self, word: str, front: tuple[bytes, int, int]) -> tuple[bytes, int, int]:
        cost, ids = self.last(word[-1])
        return front[0] + ids, front[1] + cost, front[2]

    def learn(self, words: Iterable[str]) -> None:
        """Settles all new words of a batch together."""
        if len(self.known) >= CACHE_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = []
        for word in words:
            if word not in known:
                if word in old:
                    known[word] = old[word]
                else:
                    new.append(word)
        pairs = self.table.pairs  # where no piece reaches across to the last character, that stands alone
        tailed = [w for w in new if len(w) > 1 and w[-2:] not in pairs and w[-1] != BLANK]
        apart = set(tailed)
        fronts = {w[:-1] for w in tailed}
        known.update((w, old[w]) for w in fronts if w in old and w not in known)
        whole = [w for w in fronts.union(w for w in new if w not in apart) if w not in known]
        known.update(zip(whole, two_best_of_many([BLANK + w for w in whole], self.table)))
        known.update((w, self._with_last(w, known[w[:-1]])) for w in tailed)

    def encode(self, text: str | None) -> list[tuple[int, bytes]]:
        """The n best segmentations of a whole text: (cost, ids as bytes), cheapest first; fewer if there are no more."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[tuple[int, bytes]]]:
        """The same of several texts: each different word is looked up once."""
        given = pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.fill_null(given, ""), " ")
        coded = split.values.dictionary_encode()
        numbers, ends, different = coded.indices.to_numpy(), split.offsets.to_numpy().tolist(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(different)
        whole, costs, more = zip(*map(self.known.__getitem__, different)) if different else ((), (), ())
        tables = np.array(costs, dtype=np.int64), np.array(more, dtype=np.int64)
        return [self._best(numbers[a:b], different, whole, *tables) if t else [(0, b"")] for t, a, b in zip(texts, ends, ends[1:])]

    def _best(self, places: np.ndarray, different: list[str], whole: tuple[bytes, ...], costs: np.ndarray, more: np.ndarray) -> list[tuple[int, bytes]]:
        """The n best of one text, given as numbers of its words."""
        cost, extra, parts, near, least = int(costs[places].sum()), more[places], list(map(whole.__getitem__, places.tolist())), [], FAR
        for _ in range(min(self.n - 1, len(places))):  # the words with the least extra costs; of equal ones the first
            at = int(extra.argmin())
            if extra[at] >= FAR // 2:
                break
            least = int(extra[at])
            near.append(at)
            extra[at] = FAR
        if not near:
            return [(cost, b"".join(parts))]
        near.sort()
        lattices = [self.lattice(different[places[i]]) for i in near]
        own = sum(x.best[-1] for x in lattices)
        base, out = cost - own, []
        # The best one, and each word's second best alone, are len(near) + 1 segmentations.
        for total, ids in search(lattices, self.n, own + least if len(near) == self.n - 1 else FAR):
            for i, x in zip(near, ids):
                parts[i] = array("I", x).tobytes()
            out.append((base + total, b"".join(parts)))
        return out


@lru_cache(maxsize=1)
def segmenter(path: str, n: int) -> Segmenter:
    """One per worker process, so that its tasks share what is known."""
    return Segmenter(path, n)


def encode(documents: DataFrame, model: str, n: int = N_BEST, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, `others`, and n_best, an array of (cost, ids), cheapest first.

    A null or empty text has one segmentation without ids. Costs of equal segmentations are equal;
    which of those comes first depends on the text alone, so repeated rows get equal results.
    """
    slim = documents.select(doc_id, *others, text)
    names = [doc_id, *others, "n_best"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop(text).schema.fields)
    kind = pa.struct([("cost", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model, n)
        for batch in batches:
            for first in range(0, len(batch), 500):
                some = batch.slice(first, 500)
                texts = some.column(some.num_columns - 1).to_pylist()
                found = own.encode_all(texts)
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = [x for f in found for x in f]
                sizes = np.concatenate([[0], np.cumsum([len(x[1]) // 4 for x in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(x[1] for x in flat), dtype="<i4")))
                structs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), ids], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), structs)], names)

    return slim.mapInArrow(run, f"{fields}, n_best array<struct<cost: bigint, ids: array<int>>>")


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """`encoded` with `name`: the text of the id list in column `ids` (null lists: null)."""
    others = [c for c in encoded.columns if c != name]
    at = others.index(ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*others).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(model)
        for batch in batches:
            lists = batch.column(at)
            ends, flat, valid = lists.offsets.to_numpy(), lists.values.to_numpy(), lists.is_valid().to_pylist()
            texts = [table.decode(flat[a:b].tolist()) if v else None for a, b, v in zip(ends[:-1], ends[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, name])

    return encoded.select(*others).mapInArrow(run, f"{fields}, `{name}` string")
