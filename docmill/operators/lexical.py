"""BM25 over blocks: numpy kernels that tasks run on a block of rows and a block of questions.

A block of rows holds the terms of its rows in order, as numbers of its own dictionary. A block of questions meets every block of rows in turn and
keeps the best rows of each question so far, so nothing but these leaves the task. All of it is exact: rows are passed over only where a bound on their score is below the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: BM25 constants, share of the other fields in the best one's score, places that the terms of a phrase may be apart.
K1, B, TIE, SLOP = 1.2, 0.75, 0.3, 2
#: Rows and terms at which a block is closed, questions of a block, and questions and pairs that are worked on at once.
ROWS, TERMS, ASKED, AT_ONCE, PAIRS = 8192, 1_000_000, 16384, 96, 250_000
#: A bound is an integer in steps of 1 / STEP, shifted by BITS bits for each field with phrases; these bits below count the terms that a row has in the field.
STEP, BITS = 64, 7


def task_number(n: int) -> int:
    """A number that no other block of the same table has."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | n


def shares(count: int, cores: int) -> int:
    """Partitions of so many questions."""
    return max(min(cores, -(-count // 64)), count // 16384, 1)


def _order(x: str | None) -> tuple[bool, bytes]:
    return x is not None, (x or "").encode("utf-8", "surrogatepass")  # as Spark sorts: nulls first, then by bytes


def _hand_back() -> None:
    """Freed memory back to the system, as idle workers stay beside the next tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)  # np.unique hashes, which takes ten times as long
    return x[np.diff(x, prepend=-1) != 0]


def _block(batches: list[pa.RecordBatch], fields: int, number: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    keys, groups = t["key"].to_pylist(), t["by"].to_pylist()
    order = sorted(range(t.num_rows), key=lambda i: (_order(groups[i]), _order(keys[i])))
    t, keys = t.take(order), [keys[i] for i in order]
    lists = [pa.concat_arrays(t[f"terms_{f}"].chunks) for f in range(fields)]
    lens = [pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int32) for x in lists]
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int32), coded.dictionary
    place = np.empty(t.num_rows, dtype=np.int32)
    place[sorted(range(t.num_rows), key=lambda i: _order(keys[i]))] = np.arange(t.num_rows)
    out, ends = {"block": [number], "n": [t.num_rows], "places": [place.tobytes()], "keys": [keys], "groups": [t["by"].to_pylist()]}, np.cumsum([n.sum() for n in lens])
    for f, n in enumerate(lens):
        own = codes[ends[f] - n.sum() : ends[f]]
        each = _distinct(own.astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n))
        out |= {f"df_{f}": [np.bincount(each // max(len(n), 1), minlength=len(words)).astype(np.int32)], f"sum_{f}": [int(n.sum())], f"filled_{f}": [int((n > 0).sum())], f"codes_{f}": [own.tobytes()], f"lens_{f}": [n.tobytes()]}
    names = block_schema(fields)
    arrays = {c: pa.array(out[c], type=kind) for c, kind in names.items() if c != "words"} | {"words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)}
    return pa.RecordBatch.from_arrays([arrays[c] for c in names], names=list(names))


def block_schema(fields: int) -> dict[str, pa.DataType]:
    each = [("df", pa.list_(pa.int32())), ("sum", pa.int64()), ("filled", pa.int64()), ("codes", pa.binary()), ("lens", pa.binary())]
    strings = pa.list_(pa.string())
    return {"block": pa.int64(), "n": pa.int64(), "places": pa.binary(), "keys": strings, "groups": strings, "words": strings} | {f"{c}_{f}": kind for f in range(fields) for c, kind in each}


def block_ddl(fields: int) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{c} {kinds[kind]}" for c, kind in block_schema(fields).items())


def pack_rows(fields: int):
    """Rows (key, by, terms_0...) to blocks, one a row; within a block they are sorted by ``by`` and key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, terms, number = [], 0, 0, 0
        for b in batches:
            for s in range(0, b.num_rows, 512):
                held.append(b.slice(s, 512))
                rows, terms = rows + held[-1].num_rows, terms + sum(len(held[-1].column(f"terms_{f}").flatten()) for f in range(fields))
                if rows >= ROWS or terms >= TERMS:
                    yield _block(held, fields, task_number(number))
                    held, rows, terms, number = [], 0, 0, number + 1
        if rows:
            yield _block(held, fields, task_number(number))
        held = b = None
        _hand_back()

    return pack


def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions to blocks: (asked, queries), the latter a stream of Arrow."""
    number = 0
    for b in batches:
        for s in range(0, b.num_rows, ASKED):
            part = b.slice(s, ASKED)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([task_number(number)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["asked", "queries"])
            number += 1


class Rows:
    """A block of rows, as a row of a batch has it."""

    def __init__(self, b: pa.RecordBatch, i: int, fields: int, grouped: bool = True):
        at = lambda c: b.column(c)[i]
        ints = lambda c: np.frombuffer(x, dtype=np.int32) if len(x := at(c).as_buffer()) else np.empty(0, dtype=np.int32)
        self.words, self.lens, self.codes = at("words").values, [ints(f"lens_{f}") for f in range(fields)], [ints(f"codes_{f}") for f in range(fields)]
        listed = lambda c: np.array([*at(c).values.to_pylist(), None], dtype=object)[:-1]
        self.keys, self.place = listed("keys"), ints("places")
        self.n = len(self.keys)
        self.groups = listed("groups") if grouped else np.full(self.n, None, dtype=object)
        self.hashes = np.array([hash(g) for g in self.groups], dtype=np.int64)
        self.starts = np.flatnonzero(np.diff(self.hashes, prepend=0) != 0) if self.n else np.empty(0, dtype=np.int64)
        self.starts = np.union1d(self.starts, [0])  # runs of one group
        self.nulls = np.array([x is None for x in self.keys], dtype=bool)


class Asked:
    """A block of questions with the best rows found so far."""

    def __init__(self, stream: bytes, fields: int, phrases: dict[int, float]):
        t = pa.ipc.open_stream(stream).read_all().combine_chunks()
        self.ids, self.phrases = np.array([*t["query_id"].to_pylist(), None], dtype=object)[:-1], phrases
        asked = pa.concat_arrays(t["asked"].chunks)
        self.ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(asked).to_numpy())]).astype(np.int64)
        each = asked.flatten()
        coded = each.field("term").dictionary_encode()
        self.terms, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.idf = np.zeros((fields, len(self.words)))
        for f in range(fields):
            self.idf[f, self.terms] = each.field(f"idf_{f}").to_numpy(zero_copy_only=False)
        self.sum_idf = {f: np.array([self.idf[f, self.terms[a:b]].sum() for a, b in zip(self.ptr, self.ptr[1:])]) for f in phrases}
        self.most_extra = {f: (K1 + 1) * w * self.sum_idf[f] for f, w in phrases.items()}
        self.n_terms = pc.fill_null(t["n_terms"], 0).to_numpy().astype(np.int64)
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        lists = [[[number[w] for w in one] for one in each or []] for each in t["lists"].to_pylist()]
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the first, second... list of each question: numbers, begins, sizes; an id that is there once has one
        for k in range(max(map(len, lists), default=0)):
            own = [each[k] if k < len(each) else [] for each in lists]
            size = np.array([len(x) for x in own], dtype=np.int64)
            self.lists.append((np.array([w for x in own for w in x], dtype=np.int64), np.cumsum(size) - size, size))
        self.single = self.lists[1][2] == 0 if len(self.lists) > 1 else np.ones(len(self.ids), dtype=bool)
        self.best: dict[int, list[np.ndarray]] = {}
        self.least = np.zeros(len(self.ids))  # the k-th best score so far


def _norm(tf: np.ndarray, lens: np.ndarray, avg: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens / avg))


class Meeting:
    """Scores of a block of questions over a block of rows."""

    def __init__(self, asked: Asked, rows: Rows, weights: list[float], avg: list[float], slop: int = SLOP):
        self.q, self.r, self.avg, self.slop, n = asked, rows, avg, slop, rows.n
        at = pc.fill_null(pc.index_in(rows.words, value_set=asked.words), -1).to_numpy().astype(np.int32)
        own: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for f, codes in enumerate(rows.codes):
            term = at[codes]
            has = np.flatnonzero(term >= 0)
            row = np.repeat(np.arange(n, dtype=np.int32), rows.lens[f])[has]
            key = term[has].astype(np.int64) * n + row
            if f in asked.phrases:
                by = np.argsort(key, kind="stable")
                begins = np.cumsum(rows.lens[f]) - rows.lens[f]
                key, places = key[by], (has - begins[row])[by]
            else:
                key = np.sort(key)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            tf = np.diff(first, append=len(key))
            own.append((key[first], tf))
            if f in asked.phrases:
                self.held[f] = (key[first], first, np.append(first[1:], len(places)), places)
        self.keys = _distinct(np.concatenate([k for k, _ in own]))
        self.score = np.zeros((len(own), len(self.keys)))
        self.tf = {f: np.zeros(len(self.keys), dtype=np.int32) for f in asked.phrases}
        for f, (key, tf) in enumerate(own):
            if len(key):
                at = np.searchsorted(self.keys, key)
                self.score[f, at] = weights[f] * asked.idf[f, key // n] * _norm(tf, rows.lens[f][key % n], avg[f])
                if f in self.tf:
                    self.tf[f][at] = tf
        self.row = self.keys % n if n else self.keys
        self.ptr = np.searchsorted(self.keys, np.arange(len(asked.words) + 1) * n)
        # what a question's terms add up to in single fields is at most the sum of what each term gives over all fields
        most = TIE * self.score.sum(0) + (1 - TIE) * self.score.max(0, initial=0)
        self.shift = BITS * len(asked.phrases)
        bound = np.ceil(most * STEP + 1e-6).astype(np.int64) << self.shift
        for i, f in enumerate(asked.phrases):
            bound += (self.score[f] > 0).astype(np.int64) << BITS * i
        term = np.append(bound, 0)
        largest = np.where(np.diff(self.ptr) > 0, np.maximum.reduceat(term, self.ptr[:-1]), 0)
        sums = np.concatenate([[0], np.cumsum(largest[asked.terms])])
        fits = np.diff(sums[asked.ptr]).max(initial=0) < 1 << 31
        self.bound = bound.astype(np.int32 if fits else np.int64)

    def bounds(self, s: int, e: int) -> np.ndarray:
        out = np.zeros((e - s, self.r.n), dtype=self.bound.dtype)
        q = self.q
        for i in range(s, e):
            line = out[i - s]
            for t in q.terms[q.ptr[i] : q.ptr[i + 1]]:
                a, b = self.ptr[t], self.ptr[t + 1]
                if b > a:
                    line[self.row[a:b]] += self.bound[a:b]
        return out

    def exact(self, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
        """Scores of pairs of question and row, sorted by question."""
        out = np.zeros(len(qi))
        lens = self.q.ptr[qi + 1] - self.q.ptr[qi]
        cuts = np.searchsorted(np.cumsum(lens), np.arange(0, lens.sum(), PAIRS), "left")
        for a, b in zip(cuts, [*cuts[1:], len(qi)]):
            if b > a:
                out[a:b] = self._exact(qi[a:b], di[a:b], lens[a:b])
        return out

    def _exact(self, qi: np.ndarray, di: np.ndarray, lens: np.ndarray) -> np.ndarray:
        q, n = self.q, len(qi)
        pair = np.repeat(np.arange(n), lens)
        term = q.terms[np.arange(len(pair)) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(q.ptr[qi], lens)]
        key = term * self.r.n + di[pair]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        pair, at = pair[hit], at[hit]
        each = np.stack([np.bincount(pair, s[at], minlength=n) for s in self.score])
        total, most = each.sum(0), each.max(0)
        score = most + TIE * (total - most)
        extra = np.zeros(n)
        for f, weight in q.phrases.items():
            whole = np.flatnonzero((np.bincount(pair[self.score[f, at] > 0], minlength=n) == q.n_terms[qi]) & (q.n_terms[qi] > 0) & ~self.r.nulls[di])
            if len(whole):
                # a place of the rarest term is in slop + 1 windows at most, one of each width
                ends = np.stack([np.searchsorted(pair, whole), np.searchsorted(pair, whole, "right")], axis=1)
                rarest = np.minimum.reduceat(np.append(self.tf[f][at], 0), ends.ravel())[::2]
                most = weight * q.sum_idf[f][qi[whole]] * _norm(rarest * sum(1 / (1 + i) for i in range(self.slop + 1)), self.r.lens[f][di[whole]], self.avg[f])
                whole = whole[~q.single[qi[whole]] | (score[whole] + most >= q.least[qi[whole]] - 2e-6)]
            if len(whole):
                freq = self.frequency(f, qi[whole], di[whole])
                some, freq = whole[freq > 0], freq[freq > 0]
                extra[some] = np.maximum(extra[some], weight * q.sum_idf[f][qi[some]] * _norm(freq, self.r.lens[f][di[some]], self.avg[f]))
        return score + extra

    def frequency(self, f: int, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
        """As :func:`docmill.functions.text.phrase_frequency`, of pairs whose row has all terms in field ``f``."""
        most = np.zeros(len(qi))
        for flat, begin, size in self.q.lists:
            if len(of := np.flatnonzero(size[qi] > 0)):
                most[of] = np.maximum(most[of], self._frequency(f, flat, begin[qi[of]], size[qi[of]], di[of]))
        return most

    def _frequency(self, f: int, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, di: np.ndarray) -> np.ndarray:
        keys, first, ends, places = self.held[f]
        at, shift = [], int(size.max())
        for i in range(shift):
            pair = np.flatnonzero(size > i)
            key = flat[begin[pair] + i] * self.r.n + di[pair]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            count = np.where(keys[slot] == key, ends[slot] - first[slot], 0)
            own = np.repeat(pair, count)
            place = places[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[slot], count)]
            at.append(own << 32 | (place - i + shift))
        starts = _distinct(np.concatenate(at))
        pair, width = starts >> 32, np.zeros(len(starts), dtype=np.int64)
        for i, p in enumerate(at):
            if not len(p):
                continue
            slot = np.searchsorted(p, starts)
            near = p[np.minimum(slot, len(p) - 1)]
            far = np.where((slot < len(p)) & (near >> 32 == pair), near - starts, self.slop + 1)
            width = np.where(size[pair] > i, np.maximum(width, far), width)
        return np.bincount(pair, np.where(width <= self.slop, 1.0 / (1 + width), 0.0), minlength=len(di))

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All pairs that share a term: questions, rows, scores."""
        for s in range(0, len(self.q.ids), AT_ONCE):
            e = min(s + AT_ONCE, len(self.q.ids))
            qi, di = np.nonzero(self.bounds(s, e))
            if len(qi):
                yield qi + s, di, self.exact(qi + s, di)

    def keep_best(self, k: int, grouped: bool) -> None:
        """Merge this block's rows into the best ``k`` of each question, or of each question's groups. Ties with the k-th stay."""
        q, n = self.q, self.r.n
        for s in range(0, len(q.ids), AT_ONCE):
            e = min(s + AT_ONCE, len(q.ids))
            bounds = self.bounds(s, e)
            floor = start = np.maximum(self.limit(s, e), 1)
            if (floor == 1).any():  # the k-th largest of some cells' largest bounds is reached by k rows, or groups, at least
                cells = np.maximum.reduceat(bounds, self.r.starts if grouped else np.arange(0, n, 16), axis=1)
                if cells.shape[1] > k:
                    start = np.maximum(floor, np.partition(cells, cells.shape[1] - k, axis=1)[:, cells.shape[1] - k])
            flat = bounds.ravel()
            chosen = np.flatnonzero((bounds >= start.astype(bounds.dtype)[:, None]).ravel())
            long = np.flatnonzero(np.diff(q.ptr)[s:e] >= 1 << BITS)  # where the bits can't count, all rows
            for i, f in enumerate(q.phrases):
                wanted = np.where(q.n_terms[s:e] > 0, np.minimum(q.n_terms[s:e], 1 << BITS), 1 << BITS).astype(bounds.dtype) << BITS * i
                whole = np.flatnonzero(((bounds & (((1 << BITS) - 1) << BITS * i)) >= wanted[:, None]).ravel())
                whole = np.concatenate([whole, *(j * n + np.flatnonzero(bounds[j]) for j in long)])
                extra = np.ceil(q.most_extra[f][s:e] * STEP + 1).astype(np.int64) << self.shift
                whole = whole[flat[whole] + extra[whole // n] >= floor[whole // n]]
                chosen = np.concatenate([chosen, whole])
            chosen = _distinct(chosen) if q.phrases else chosen
            self.merge(s, chosen // n, chosen % n, k, grouped)
            floor = np.maximum(self.limit(s, e), 1)
            if (some := np.flatnonzero(floor < start)).size:  # rows between the bounds
                rest = np.flatnonzero((bounds[some] >= floor[some].astype(bounds.dtype)[:, None]).ravel())
                rest = np.setdiff1d(some[rest // n] * n + rest % n, chosen, assume_unique=True)
                self.merge(s, rest // n, rest % n, k, grouped)

    def limit(self, s: int, e: int) -> np.ndarray:
        """Bounds below are those of rows that can't come among the best any more."""
        return np.minimum(np.floor((self.q.least[s:e] - 2e-6) * STEP).astype(np.int64) << self.shift, np.iinfo(self.bound.dtype).max)

    def merge(self, s: int, qi: np.ndarray, di: np.ndarray, k: int, grouped: bool) -> None:
        if not len(qi):
            return
        q, r = self.q, self.r
        qi = qi + s
        score = self.exact(qi, di)
        rounded = np.round(score, 6)
        good = rounded >= q.least[qi]
        qi, di, score, rounded = qi[good], di[good], score[good], rounded[good]
        if not grouped:  # of equal rows of one block those with the first keys are enough
            by = np.lexsort((r.place[di], -rounded, qi))
            by = by[_rank(qi[by]) < k]
            qi, di, score, rounded = qi[by], di[by], score[by], rounded[by]
        new = [qi, score, rounded, r.keys[di], r.groups[di], r.hashes[di]]
        old = q.best.get(s)
        qi, score, rounded, keys, groups, hashes = [np.concatenate(x) for x in zip(old, new)] if old else new
        if grouped:
            by = np.lexsort((-rounded, hashes, qi))
            one = by[np.flatnonzero((np.diff(qi[by], prepend=-1) != 0) | (np.diff(hashes[by], prepend=0) != 0))]
            one = one[np.lexsort((-rounded[one], qi[one]))]
        else:
            one = np.lexsort((-rounded, qi))
        last = one[_rank(qi[one]) == k - 1]
        q.least[qi[last]] = rounded[last]
        stay = rounded >= q.least[qi]
        q.best[s] = [x[stay] for x in (qi, score, rounded, keys, groups, hashes)]


def _rank(sorted_: np.ndarray) -> np.ndarray:
    """Places from 0 within runs of equal values."""
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return np.arange(len(sorted_)) - np.repeat(first, np.diff(first, append=len(sorted_)))


def meet(weights: list[float], phrases: dict[int, float], k: int | None, grouped: bool):
    """Pairs of blocks (of rows outside, of questions within, and avg: the fields' mean lengths) to (query_id, key, by, score)."""

    def batch(ids: np.ndarray, keys: np.ndarray, groups: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.string()), pa.array(groups, pa.string()), pa.array(score, pa.float64())], names=["query_id", "key", "by", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Asked] = {}
        rows, block, met = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                met = None  # the one before is let go first
                if b.column("block")[i].as_py() != block:
                    block, rows = b.column("block")[i].as_py(), Rows(b, i, len(weights), grouped)
                number = b.column("asked")[i].as_py()
                if number not in asked:
                    asked[number] = Asked(b.column("queries")[i].as_buffer(), len(weights), phrases)
                met = Meeting(asked[number], rows, weights, [x or 1.0 for x in b.column("avg")[i].as_py()])
                if not len(met.keys):
                    continue
                if k is None:
                    for qi, di, score in met.every():
                        yield batch(asked[number].ids[qi], rows.keys[di], rows.groups[di], score)
                else:
                    met.keep_best(k, grouped)
        rows = met = b = None
        _hand_back()
        for q in asked.values():
            for qi, score, _, keys, groups, _ in q.best.values():
                yield batch(q.ids[qi], keys, groups, score)

    return work


class Nearest:
    """A block of questions' vectors with the nearest rows found so far, ``k`` each: of equal cosines those with the first keys."""

    def __init__(self, ids: list[str | None], unit: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit, k
        self.least = np.full(len(ids), -np.inf)
        self.best = [np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)]  # questions, cosines, keys

    def meet(self, unit: np.ndarray, keys: np.ndarray, place: np.ndarray) -> None:
        sim, k = self.unit @ unit.T, self.k
        sim[np.isnan(sim)] = -np.inf
        edge = self.least
        if sim.shape[1] > k and np.isinf(edge).any():
            edge = np.maximum(edge, np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k])
        qi, di = np.nonzero((sim >= edge[:, None] - 2e-6) & (sim > -np.inf))  # a little more, as cosines are compared rounded
        cos = np.round(sim[qi, di], 6)
        by = np.lexsort((place[di], -cos, qi))
        by = by[_rank(qi[by]) < k]
        qi, cos, keys = [np.concatenate(x) for x in zip(self.best, (qi[by], cos[by], keys[di[by]]))]
        by = np.lexsort((-cos, qi))
        qi, cos, keys = qi[by], cos[by], keys[by]
        last = np.flatnonzero(_rank(qi) == k - 1)
        self.least[qi[last]] = cos[last]
        stay = cos >= self.least[qi]
        qi, cos, keys = qi[stay], cos[stay], keys[stay]
        first = np.flatnonzero(np.diff(qi, prepend=-1) != 0)
        size = np.diff(first, append=len(qi))
        if (size > k).any():  # rows equal to the k-th: those with the first keys
            gone = []
            for a, n in zip(first[size > k], size[size > k]):
                tied = [i for i in range(a, a + n) if cos[i] == cos[a + k - 1]]
                gone += sorted(tied, key=lambda i: _order(keys[i]))[len(tied) - (n - k) :]
            qi, cos, keys = np.delete(qi, gone), np.delete(cos, gone), np.delete(keys, gone)
        self.best = [qi, cos, keys]


def meet_vectors(dim: int, k: int, kinds: list[type], key: str):
    """Pairs of blocks of vectors (of rows outside, r_, of questions within, q_) to (query_id, key, cos): the nearest ``k`` rows of each question."""

    def unit(b: pa.RecordBatch, c: str, i: int, kind: type) -> np.ndarray:
        v = np.frombuffer(b.column(c)[i].as_buffer(), dtype=kind).astype(np.float64).reshape(-1, dim)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Nearest] = {}
        block = None
        for b in batches:
            for i in range(b.num_rows):
                if b.column("r_block")[i].as_py() != block:
                    block, rows = b.column("r_block")[i].as_py(), unit(b, "r_vectors", i, kinds[1])
                    keys = np.array([*b.column("r_keys")[i].as_py(), None], dtype=object)[:-1]
                    place = np.empty(len(keys), dtype=np.int64)
                    place[sorted(range(len(keys)), key=lambda i: _order(keys[i]))] = np.arange(len(keys))
                number = b.column("q_block")[i].as_py()
                if number not in asked:
                    asked[number] = Nearest(b.column("q_keys")[i].as_py(), unit(b, "q_vectors", i, kinds[0]), k)
                asked[number].meet(rows, keys, place)
        rows = b = None
        _hand_back()
        for q in asked.values():
            qi, cos, keys = q.best
            yield pa.RecordBatch.from_arrays([pa.array([q.ids[x] for x in qi], pa.string()), pa.array(keys, pa.string()), pa.array(cos, pa.float64())], names=["query_id", key, "cos"])

    return work
