"""External induced sorting of suffixes with common-prefix values.

Suffixes are L or S by whether the next suffix is smaller or larger; an S with an L before it is a star. Sorted stars
induce the order of all L suffixes in one ascending scan and those the order of all S suffixes in a descending one:
each scanned suffix sends its predecessor to the end of the queue of the predecessor's first symbol. The queues are a
monotone priority queue whose key is that symbol; tuples of position and common prefix wait in them, in memory up to a
limit and in scratch files beyond. Stars are sorted by inducing once on star substrings, naming those and sorting the
shorter string of names: recursively, by the same induction with names as symbols, until the names are few enough to
be sorted in memory.

Nothing of the size of the text stays in memory: the text, each array over it and all results are mapped files beyond
a limit, scans and comparisons go by chunks, and what a scan has put in order is appended to a file. All steps are
numpy operations on whole chunks.

Common prefixes are exact up to a cap. That of two neighbours in a queue is one more than the least of the scanned
ones between their sources.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: Bytes of waiting or finished tuples in memory before they go to scratch files, bytes from which an array is a mapped
#: file, elements of a chunk, and names that are sorted in memory.
QUEUE_BYTES, MAPPED_BYTES, CHUNK, NAMES = 64 << 20, 64 << 20, 1 << 22, 1 << 22
FAR = np.int16(32000)
#: Bytes that Python takes for a tuple of arrays, however short they are.
HEAD = 400


class Scratch:
    """Arrays of one task: in memory or, when large, mapped files in a folder that the caller removes."""

    def __init__(self, folder: str, mapped_bytes: int = MAPPED_BYTES, queue_bytes: int = QUEUE_BYTES, chunk: int = CHUNK, names: int = NAMES):
        self.folder, self.mapped_bytes, self.queue_bytes, self.chunk, self.names, self.n = folder, mapped_bytes, queue_bytes, chunk, names, 0

    def path(self) -> str:
        self.n += 1
        return os.path.join(self.folder, f"{self.n}.bin")

    def array(self, n: int, dtype) -> np.ndarray:
        """Zeros."""
        if n * np.dtype(dtype).itemsize <= self.mapped_bytes:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def chunks(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Bounds of the chunks of a range, in order."""
        for at in range(a, b, self.chunk):
            yield at, min(at + self.chunk, b)


class Spool:
    """Columns to which chunks are appended, in memory up to a limit and in one file each beyond."""

    def __init__(self, scratch: Scratch, *dtypes):
        self.scratch, self.dtypes, self.n, self.held = scratch, dtypes, 0, 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.paths: list[str] = []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        self.held += HEAD + sum(c.nbytes for c in columns)
        if self.held > self.scratch.queue_bytes:
            self.flush()

    def flush(self) -> None:
        self.paths = self.paths or [self.scratch.path() for _ in self.dtypes]
        for k, path in enumerate(self.paths):
            with open(path, "ab") as out:
                for part in self.parts:
                    np.ascontiguousarray(part[k]).tofile(out)
        self.parts, self.held = [], 0

    def columns(self) -> list[np.ndarray]:
        if not self.paths or not self.n:
            return [np.concatenate([np.zeros(0, t), *(p[k] for p in self.parts)]) for k, t in enumerate(self.dtypes)]
        self.flush()
        return [np.memmap(path, t, "r", shape=(self.n,)) for path, t in zip(self.paths, self.dtypes, strict=True)]


class Queues:
    """First-in-first-out queues of (position, common prefix), keyed by symbol: a monotone priority queue.

    Up to 256 symbols have a queue each. More are dealt out by their high bits first, into at most 256 ranges, and by
    symbol when the scan comes to that range. Beyond a limit all waiting tuples go to one file per spill.
    """

    def __init__(self, scratch: Scratch, symbols: int):
        self.scratch, self.held, self.shift, self.open = scratch, 0, 0 if symbols <= 256 else symbols.bit_length() - 8, -1
        self.parts: dict[int, list] = {}  # of a symbol: arrays (position, prefix), or (path, offset, number) of a spill
        self.later: dict[int, list] = {}  # of a range: the same with symbols in front
        self.log: list[tuple[np.ndarray, ...]] = []
        self.logged = 0

    def push(self, c: np.ndarray, at: np.ndarray, lcp: np.ndarray, first: np.ndarray) -> None:
        """Tuples in order of their symbols; `first` is where each symbol begins."""
        if self.shift:
            now = (c >> self.shift) == self.open
            if not now.all():
                rest = ~now
                self.log.append((c[rest], at[rest], lcp[rest]))
                self.logged += int(rest.sum())
                if self.logged + len(self.log) * HEAD // 8 > self.scratch.chunk:
                    self.deal()
                c, at, lcp = c[now], at[now], lcp[now]
                first = heads(c)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=False):
            self.parts.setdefault(int(c[a]), []).append((at[a:b], lcp[a:b]))
        self.hold(at.nbytes + lcp.nbytes + HEAD * len(first))

    def deal(self) -> None:
        """What was logged goes to the queues of its ranges."""
        if not self.log:
            return
        columns = [np.concatenate(x) for x in zip(*self.log, strict=True)]
        self.log, self.logged = [], 0
        order = np.argsort(columns[0] >> self.shift, kind="stable")
        columns = [x[order] for x in columns]
        high = columns[0] >> self.shift
        first = heads(high)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(high)], strict=False):
            self.later.setdefault(int(high[a]), []).append(tuple(x[a:b] for x in columns))
        self.hold(sum(x.nbytes for x in columns) + HEAD * len(first))

    def hold(self, size: int) -> None:
        """Counts bytes in memory; beyond the limit, what waits goes to a file."""
        self.held += size
        if self.held <= self.scratch.queue_bytes:
            return
        path = self.scratch.path()
        with open(path, "wb") as out:
            for queues in (self.parts, self.later):
                for part in queues.values():
                    for i, x in enumerate(part):
                        if isinstance(x[0], np.ndarray):
                            part[i] = (path, out.tell(), len(x[0]), len(x))
                            for column in x:
                                np.ascontiguousarray(column).tofile(out)
        self.held = 0

    def read(self, part: tuple) -> tuple[np.ndarray, ...]:
        if isinstance(part[0], np.ndarray):
            self.held = max(0, self.held - HEAD - sum(x.nbytes for x in part))
            return part
        path, offset, n, width = part
        out = []
        for t in ((np.int32,) if width == 3 else ()) + (np.int32, np.int16):
            out.append(np.fromfile(path, t, n, offset=offset))
            offset += n * np.dtype(t).itemsize
        return tuple(out)

    def reach(self, c: int) -> None:
        """The scan has come to a symbol."""
        if not self.shift or c >> self.shift == self.open:
            return
        self.deal()
        self.open = c >> self.shift
        for part in self.later.pop(self.open, []):
            columns = self.read(part)
            order = np.argsort(columns[0], kind="stable")
            c_, at, lcp = (x[order] for x in columns)
            self.push(c_, at, lcp, heads(c_))

    def pop(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits for a symbol, by chunks, what the scan sends there meanwhile included."""
        while part := self.parts.pop(c, None):
            held, n = [], 0
            for i, x in enumerate(part):
                held.append(self.read(x))
                n += len(held[-1][0])
                if n >= self.scratch.chunk or i + 1 == len(part):
                    yield held[0] if len(held) == 1 else tuple(np.concatenate(y) for y in zip(*held, strict=True))
                    held, n = [], 0


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Sender:
    """Sends predecessors of scanned chunks to their queues, with the common prefixes that the scan implies.

    `least` is the least common prefix scanned since a queue's last tuple; 0: none yet. It holds what was scanned with
    that tuple. What was scanned after it is a stack of (time, least since then), whose values rise.
    """

    def __init__(self, text: np.ndarray, symbols: int, queues: Queues, cap: int, scratch: Scratch):
        self.text, self.queues, self.cap, self.now = text, queues, cap, 0
        self.least, self.time = scratch.array(symbols, np.int16), scratch.array(symbols, np.int32)
        self.times: list[int] = []
        self.values: list[int] = []

    def scanned(self, low: int) -> None:
        """A chunk is done whose least common prefix is `low`."""
        while self.values and self.values[-1] >= low:
            self.values.pop()
            self.times.pop()
        self.values.append(low)
        self.times.append(self.now)
        self.now += 1

    def since(self, symbols: np.ndarray) -> np.ndarray:
        """The least common prefix since the last tuple of each symbol, before this chunk."""
        at = np.searchsorted(np.array(self.times, np.int64), self.time[symbols])
        return np.minimum(self.least[symbols], np.array([*self.values, FAR], np.int16)[at])

    def send(self, at: np.ndarray, lcp: np.ndarray, wanted: np.ndarray) -> None:
        """at: scanned positions, lcp: with the one scanned before. wanted: whose predecessor is to be sent."""
        if not len(at):
            return
        k = np.flatnonzero(wanted)
        if not len(k):
            self.scanned(int(lcp.min()))
            return
        pred = at[k] - np.int32(1)
        c = self.text[pred]
        order = np.argsort(c, kind="stable")
        k, pred, c = k[order], pred[order], c[order]
        first = heads(c)
        start = np.empty(len(k), np.int64)  # the least over (the source before in the same queue, this source]
        start[1:] = k[:-1] + 1
        start[first] = 0
        edges = np.empty(2 * len(k), np.int64)
        edges[0::2], edges[1::2] = start, k + 1
        padded = np.append(lcp, FAR)
        low = np.minimum.reduceat(padded, edges)[0::2]
        sent = c[first]
        low[first] = np.minimum(low[first], self.since(sent))
        low = np.minimum(low + np.int16(1), np.int16(self.cap))
        ends = np.append(first[1:], len(k))
        tail = np.minimum.accumulate(padded[::-1])[::-1]
        self.scanned(int(lcp.min()))
        self.least[sent], self.time[sent] = tail[k[ends - 1] + 1], self.now
        self.queues.push(c, pred, low, first)


def kinds(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(whether S, length of the run of equal symbols from here) for each position; the end is smaller than any symbol."""
    n = len(text)
    is_s, run = scratch.array(n, bool), scratch.array(n, np.int16)
    for a, b in reversed(list(scratch.chunks(0, n))):
        part = text[a:b]
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]), b - a - 1)  # last position of each run
        up = np.append(part[ends[:-1] + 1] > part[ends[:-1]], b < n and text[b] > part[-1])
        sizes = np.diff(np.concatenate([[-1], ends]))
        length = np.repeat(ends, sizes) - np.arange(b - a) + 1
        if b < n and text[b] == part[-1]:  # the last run goes on in the chunk after
            up[-1] = is_s[b]
            length[-sizes[-1] :] += int(run[b])
        is_s[a:b] = np.repeat(up, sizes)
        run[a:b] = np.minimum(length, FAR)
    return is_s, run


def induce(text: np.ndarray, symbols: int, is_s: np.ndarray, run: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray | None, star_edges: np.ndarray, cap: int, scratch: Scratch) -> tuple[list, list]:
    """Sorted L and S suffixes, each as [positions, common prefixes, where each first symbol begins].

    L suffixes ascend, each with its common prefix with the one before. S suffixes are in the order of the scan, their
    symbols and they themselves descending. stars: star positions in order, those of symbol c from star_edges[c] on,
    whose common prefixes hold between neighbours of the same first symbol; none are 0.
    """
    n = len(text)
    large, begins = Spool(scratch, np.int32, np.int16), scratch.array(symbols + 1, np.int64)
    queues = Queues(scratch, symbols)
    sender = Sender(text, symbols, queues, cap, scratch)
    queues.push(text[n - 1 :], np.array([n - 1], np.int32), np.zeros(1, np.int16), np.zeros(1, np.int64))
    for c in range(symbols):
        queues.reach(c)
        last = -1
        for at, lcp in queues.pop(c):
            if last < 0:
                lcp = np.concatenate([[np.int16(0)], lcp[1:]])
            large.add(at, lcp)
            last = int(at[-1])
            sender.send(at, lcp, (at > 0) & ~is_s[at - 1])
        begins[c + 1] = large.n
        for a, b in scratch.chunks(star_edges[c], star_edges[c + 1]):
            at = stars[a:b]
            lcp = np.zeros(b - a, np.int16) if star_lcp is None else star_lcp[a:b].copy()
            if a == star_edges[c]:
                lcp[0] = 0 if last < 0 else min(run[last], run[at[0]], cap)
            sender.send(at, lcp, at > 0)
    large = [*large.columns(), begins]
    small, ends = Spool(scratch, np.int32, np.int16), scratch.array(symbols + 1, np.int64)
    queues = Queues(scratch, symbols)
    sender = Sender(text, symbols, queues, cap, scratch)
    for c in range(symbols - 1, -1, -1):
        queues.reach(c)
        last = -1
        for at, lcp in queues.pop(c):
            if last < 0:
                lcp = np.concatenate([[np.int16(0)], lcp[1:]])
            small.add(at, lcp)
            last = int(at[-1])
            sender.send(at, lcp, (at > 0) & is_s[at - 1])
        ends[c] = small.n
        low, high = int(begins[c]), int(begins[c + 1])
        for a, b in reversed(list(scratch.chunks(low, high))):
            at, lcp = large[0][a:b][::-1], np.empty(b - a, np.int16)
            lcp[1:] = large[1][a + 1 : b][::-1]
            lcp[0] = large[1][b] if b < high else 0 if last < 0 else min(run[last], run[at[0]], cap)
            sender.send(at, lcp, (at > 0) & is_s[at - 1])
    return large, [*small.columns(), ends]


def ascending(large: list, small: list, run: np.ndarray, cap: int, scratch: Scratch, only_small: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes, or the S suffixes alone, in order by chunks, with the common prefix with the one before."""
    used = (c for a, b in scratch.chunks(0, len(large[2]) - 1) for c in (np.flatnonzero((large[2][a:b] < large[2][a + 1 : b + 1]) | (small[2][a:b] > small[2][a + 1 : b + 1])) + a).tolist())
    for c in used:
        low, high = int(large[2][c]), int(large[2][c + 1])
        if not only_small:
            for a, b in scratch.chunks(low, high):
                yield large[0][a:b], large[1][a:b]
        first, end = int(small[2][c + 1]), int(small[2][c])
        for a, b in reversed(list(scratch.chunks(first, end))):
            at, lcp = small[0][a:b][::-1], np.zeros(b - a, np.int16)
            lcp[1:] = small[1][a + 1 : b][::-1]  # each value moves to the later of its pair
            if b < end:
                lcp[0] = small[1][b]
            elif high > low:
                lcp[0] = min(run[at[0]], run[large[0][high - 1]], cap)
            yield at, lcp


def sort_names(names: np.ndarray, symbols: int, most: int, scratch: Scratch) -> np.ndarray:
    """Order of the suffixes of a string of names by their first `most` names, ties in any order.

    More names than memory should hold are a string of symbols that is sorted by induction in its turn.
    """
    if len(names) <= scratch.names:
        return doubled_ranks(names, most)
    order = Spool(scratch, np.int32)
    for at, _ in suffix_chunks(names, symbols, most, scratch):
        order.add(at)
    return order.columns()[0]


def doubled_ranks(names: np.ndarray, most: int) -> np.ndarray:
    """The same in memory: ranks of twice the length come from pairs of ranks, and only those still tied are sorted again."""
    n = len(names)
    rank = names.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    length = 1
    ranked = rank[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    where = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = where + 1
    while length < most:
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        at = order[tied]
        second = np.where(at + length < n, rank[np.minimum(at + length, n - 1)], 0)
        key = rank[at] * (n + 1) + second
        new = np.argsort(key, kind="stable")
        order[tied] = at[new]
        key = key[new]
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        head[tied] |= differs
        where = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order] = where + 1
        length *= 2
    return order


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each pair of suffixes, up to the cap; exact, eight symbols at a time."""
    n, eight = len(text), np.arange(8)
    out = np.full(len(a), cap, np.int16)
    live = np.arange(len(a))
    x, y = a.astype(np.int64), b.astype(np.int64)
    for at in range(0, cap, 8):
        later = np.maximum(x, y) + at
        inside = later < n
        if not inside.all():
            short = live[~inside]
            out[short] = np.minimum(n - np.maximum(x, y)[~inside], at)
            live, x, y, later = live[inside], x[inside], y[inside], later[inside]
        if not len(live):
            break
        i, j = (x + at)[:, None] + eight, (y + at)[:, None] + eight
        if later.max() + 8 > n:
            i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        same = text[i] == text[j]
        k = np.where(same.all(1), 8, same.argmin(1))
        k = np.minimum(k, n - later)
        stop = k < 8
        out[live[stop]] = np.minimum(at + k[stop], cap)
        live, x, y = live[~stop], x[~stop], y[~stop]
    return out


def star_order(text: np.ndarray, symbols: int, is_s: np.ndarray, run: np.ndarray, cap: int, scratch: Scratch) -> list[np.ndarray]:
    """Stars in order of their suffixes up to the cap: [positions, common prefix with the one before]."""
    n = len(text)
    found, is_star = Spool(scratch, np.int32), scratch.array(n, bool)
    queues = Queues(scratch, symbols)
    for a, b in scratch.chunks(1, n):
        at = (np.flatnonzero(is_s[a:b] & ~is_s[a - 1 : b - 1]) + a).astype(np.int32)
        is_star[at] = True
        found.add(at)
        c = text[at]
        by = np.argsort(c, kind="stable")
        queues.push(c[by], at[by], np.zeros(len(at), np.int16), heads(c[by]))
    stars = found.columns()[0]
    if not len(stars):
        return [stars, np.zeros(0, np.int16), scratch.array(symbols + 1, np.int64)]
    # Star substrings in order: stars by first symbol, induced once.
    first, edges = Spool(scratch, np.int32), scratch.array(symbols + 1, np.int64)
    for c in range(symbols):
        queues.reach(c)
        for at, _ in queues.pop(c):
            first.add(at)
        edges[c + 1] = first.n
    large, small = induce(text, symbols, is_s, run, first.columns()[0], None, edges, 1, scratch)
    size = scratch.array(n, np.int32)
    for a, b in scratch.chunks(0, len(stars)):
        size[stars[a:b]] = np.diff(np.append(stars[a:b], stars[b] if b < len(stars) else n - 1)) + 1
    # Equal neighbours get one name.
    name, last, named = scratch.array(n, np.int32), None, 0
    for at, _ in ascending(large, small, run, 1, scratch, only_small=True):
        order = at[is_star[at]]
        if not len(order):
            continue
        order = order if last is None else np.concatenate([[last], order])
        same = size[order[1:]] == size[order[:-1]]
        same[same] = common_prefixes_up_to(text, order[1:][same], order[:-1][same], size[order[1:]][same])
        same &= (order[1:] != stars[-1]) & (order[:-1] != stars[-1])
        name[order] = named + np.cumsum(np.concatenate([[0], ~same]))
        named, last = int(name[order[-1]]), order[-1]
    string = scratch.array(len(stars), np.int32)
    for a, b in scratch.chunks(0, len(stars)):
        string[a:b] = name[stars[a:b]]
    # Stars are two symbols apart at least.
    order = sort_names(string, named + 1, cap // 2 + 1, scratch)
    out, edges, last = Spool(scratch, np.int32, np.int16), scratch.array(symbols + 1, np.int64), None
    for a, b in scratch.chunks(0, len(order)):
        at = stars[order[a:b]]
        lcp = np.zeros(len(at), np.int16)
        lcp[1:] = common_prefixes(text, at[1:], at[:-1], cap)
        if last is not None:
            lcp[:1] = common_prefixes(text, at[:1], last, cap)
        out.add(at, lcp)
        last = at[-1:]
        c = text[at]
        first = heads(c)
        edges[c[first].astype(np.int64) + 1] += np.diff(np.append(first, len(c)))
    return [*out.columns(), np.cumsum(edges, out=edges)]


def suffix_chunks(text: np.ndarray, symbols: int, cap: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in order, common prefix with the one before up to the cap), by chunks. Beyond the cap, order is any."""
    if not len(text):
        return
    is_s, run = kinds(text, scratch)
    stars, star_lcp, edges = star_order(text, symbols, is_s, run, cap, scratch)
    large, small = induce(text, symbols, is_s, run, stars, star_lcp, edges, cap, scratch)
    yield from ascending(large, small, run, cap, scratch)


def sorted_suffixes(text: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The order of a string of bytes as two arrays over it, mapped where large: see `suffix_chunks`."""
    positions, lcp = scratch.array(len(text), np.int32), scratch.array(len(text), np.int16)
    done = 0
    for at, common in suffix_chunks(text, 256, cap, scratch):
        positions[done : done + len(at)], lcp[done : done + len(at)] = at, common
        done += len(at)
    return positions, lcp


def common_prefixes_up_to(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each pair agrees in its first `sizes` bytes."""
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    k = 0
    while len(live):
        live = live[sizes[live] > k]
        same = text[a[live].astype(np.int64) + k] == text[b[live].astype(np.int64) + k]
        out[live[~same]] = False
        live = live[same]
        k += 1
    return out
