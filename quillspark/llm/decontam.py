"""Operator 13: benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of any non-ASCII character, A-Z lower-cased. The items'
word sequences form one generalised suffix automaton. A document's words are streamed through it; at each
word the automaton gives the longest sequence ending there that stands in some item. Where that length
reaches a window (``window`` item words, or a whole shorter item), the words of the window are hit, and the
automaton's state names the items that have it. ``remove`` cuts hit spans that are too long and rejects
documents that are covered too far.

Streams restart wherever two neighbouring words follow each other in no item: there the longest match is
at most one word. So a batch is many short streams, stepped together as arrays; when few are left, they
are stepped one by one. Streams shorter than the shortest window cannot hit and are not stepped.

Size: items are dealt by hash over shards of at most SHARD_WORDS words; items of over PIECE_WORDS words
are cut into pieces that overlap by a window, so no window is lost. Executors build one automaton a shard
(at most 2 states a word, about 100 bytes a word). The driver passes on one shard at a time. With one shard
the scan is map-only; with more, each pass returns rows of documents with hits alone, which are merged by
(doc_id, SHA-256 of the text) and joined back.

Words are compared by 64-bit hashes, so among n different words a pair is confused with probability below
n**2 / 2**65.

Edge cases: null or empty texts have no words and no hit; items without words have no window. Repeated
document rows are answered one by one; items that repeat an id count once. An item without id hits words but
is not listed or counted. Empty tables give no rows, or rows without hits. Other columns stay as they are in ``remove``
and are not read by ``scan``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .store import arrow, new_path, table

WINDOW = 10
SHARD_WORDS, PIECE_WORDS = 1 << 19, 1 << 16
#: Under so many streams they are stepped one by one.
FEW = 24
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<word:int,words:int,start:int,length:int,longest:int>>"

#: Bytes as they are compared: letters and digits, A-Z as a-z, non-ASCII as they are, all others as a blank.
_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, hashes) of the words of all texts of a string column."""
    buf, offs = K.string_buffer(column)
    return _words(buf[offs[0] : offs[-1]], offs - offs[0])


def _words(buf, offs):
    buf = _FOLD[buf]
    s, e, first = K.words(buf, offs)
    return s, e, first, K.span_hashes(buf, s, e)


class Sorted:
    """From sorted 64-bit keys to their positions, behind a bitmap of their hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(6, int(len(keys) * 16).bit_length())
        h = self._hash(keys)
        self.map = np.zeros(1 << self.bits, bool)
        self.map[h] = True

    def _hash(self, q: np.ndarray) -> np.ndarray:
        return (q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """Position of each of q, or -1."""
        out = np.full(len(q), -1, np.int64)
        at = np.flatnonzero(self.map[self._hash(q)])
        if len(at):
            pos = np.minimum(np.searchsorted(self.keys, q[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[pos] == q[at], pos, -1)
        return out


def build(hashes: np.ndarray, first: np.ndarray, item: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """The automaton of the word sequences hashes[first[i]:first[i+1]] of item[i] (numbers, -1 for none), as arrays.

    vocab: sorted word hashes. keys, to: sorted (state << 32 | word) and the state it leads to. size, link: by state.
    sizes: the windows' lengths. holder[k]: by state the ancestor that stands for its last sizes[k] words, -1 for none.
    start, items: for window state w = k * states + state, its items are items[start[w]:start[w + 1]] (only keys wkeys are kept)."""
    vocab, ids = np.unique(hashes, return_inverse=True)
    ids, size, link, go, ends = ids.tolist(), [0], [-1], [{}], []
    for i in range(len(first) - 1):
        last = 0
        for c in ids[first[i] : first[i + 1]]:
            last = _extend(size, link, go, last, c)
        ends.append(last)
    n = len(size)
    key = np.fromiter((s << 32 | c for s in range(n) for c in go[s]), np.int64, sum(map(len, go)))
    to = np.fromiter((t for s in range(n) for t in go[s].values()), np.int64, len(key))
    order = np.argsort(key)
    length = np.diff(first)
    sizes = sorted({min(window, x) for x in length.tolist() if x})
    by_size = np.argsort(np.array(size), kind="stable").tolist()
    holder = np.full((len(sizes), n), -1, np.int32)
    for k, w in enumerate(sizes):
        row = [-1] * n
        for s in by_size[1:]:  # a state's link is shorter, so it is done before
            up = link[s]
            row[s] = (s if size[up] < w else row[up]) if size[s] >= w else -1
        holder[k] = row
    pairs = set()
    at = {w: k for k, w in enumerate(sizes)}
    for i in range(len(first) - 1):
        if 0 < length[i] < window:
            k = at[int(length[i])]
            pairs.add((k * n + int(holder[k][ends[i]]), int(item[i])))
        elif length[i]:
            k, row, s = at[window], holder[at[window]], 0
            for c in ids[first[i] : first[i + 1]]:
                s = go[s][c]  # an item's own prefix is always there
                if row[s] >= 0:
                    pairs.add((k * n + int(row[s]), int(item[i])))
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    wkeys, starts = np.unique(pairs[:, 0], return_index=True)
    return {
        "vocab": vocab, "keys": key[order], "to": to[order].astype(np.int32), "size": np.array(size, np.int32), "link": np.array(link, np.int32),
        "sizes": np.array(sizes, np.int32), "holder": holder, "wkeys": wkeys, "start": np.append(starts, len(pairs)), "items": pairs[:, 1].astype(np.int32),
    }


def _extend(size: list, link: list, go: list, last: int, c: int) -> int:
    """Append word c to the sequence of state ``last``; the state of the longer sequence."""

    def split(p: int, q: int) -> int:
        """q also stands for sequences that end elsewhere: part off those of size[p] + 1 words and less."""
        part = len(size)
        size.append(size[p] + 1), link.append(link[q]), go.append(dict(go[q]))
        link[q] = part
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = part
            p = link[p]
        return part

    q = go[last].get(c)
    if q is not None:  # another sequence has gone this way
        return q if size[q] == size[last] + 1 else split(last, q)
    new = len(size)
    size.append(size[last] + 1), link.append(0), go.append({})
    p = last
    while p >= 0 and c not in go[p]:
        go[p][c] = new
        p = link[p]
    if p >= 0:
        q = go[p][c]
        link[new] = q if size[q] == size[p] + 1 else split(p, q)
    return new


class Matcher:
    def __init__(self, arrays: dict[str, np.ndarray], names: list):
        self.__dict__.update(arrays)
        self.names, self.states = np.array(names, object), len(self.size)
        self.words, self.edges = Sorted(self.vocab), Sorted(self.keys)
        root = self.edges.find(np.arange(len(self.vocab), dtype=np.int64))  # from state 0
        self.single = np.where(root >= 0, self.to[root], 0)

    def longest(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, length) of the longest match that ends at each word, for words in streams that can hit; else length 0."""
        n = len(ids)
        state, length = np.zeros(n, np.int32), np.zeros(n, np.int32)
        goes = np.zeros(n, bool)
        if n > 1:
            both = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0))
            goes[both + 1] = self.edges.find(self.single[ids[both]].astype(np.int64) << 32 | ids[both + 1]) >= 0
            goes[first[:-1][first[:-1] < n]] = False
        begin = np.flatnonzero(~goes)
        run = np.diff(np.append(begin, n))
        able = (run >= self.sizes[0]) & (ids[begin] >= 0)
        begin, run = begin[able], run[able]
        order = np.argsort(-run, kind="stable")
        begin, run = begin[order], run[order]
        s, m = self.single[ids[begin]], np.ones(len(begin), np.int32)
        state[begin], length[begin] = s, m
        j, live = 1, int(np.searchsorted(-run, -1, "left"))
        while live > FEW:
            at = begin[:live] + j
            s, m = self._step(s[:live], m[:live], ids[at])
            state[at], length[at] = s, m
            j += 1
            live = int(np.searchsorted(-run, -j, "left"))
        if live:
            self._rest(begin[:live], run[:live], j, s[:live], m[:live], ids, state, length)
        return state, length

    def _step(self, s, m, c):
        s, m, todo = s.astype(np.int64), m.copy(), np.arange(len(s))
        out = np.zeros(len(s), np.int64)
        while len(todo):
            pos = self.edges.find(s[todo] << 32 | c[todo])
            done = pos >= 0
            out[todo[done]] = self.to[pos[done]]
            m[todo[done]] += 1
            todo = todo[~done]
            s[todo] = self.link[s[todo]]
            m[todo] = self.size[s[todo]]
        return out, m

    def _rest(self, begin, run, j, s, m, ids, state, length):
        from bisect import bisect_left

        keys, to, link, size = (memoryview(np.ascontiguousarray(x)) for x in (self.keys, self.to, self.link, self.size))
        n = len(keys)
        for a, r, x, y in zip(begin.tolist(), run.tolist(), s.tolist(), m.tolist()):
            states, lengths = [], []
            for c in ids[a + j : a + r].tolist():
                while (i := bisect_left(keys, q := x << 32 | c)) == n or keys[i] != q:
                    x = link[x]
                    y = size[x]
                x, y = to[i], y + 1
                states.append(x), lengths.append(y)
            state[a + j : a + r], length[a + j : a + r] = states, lengths

    def hits(self, hashes: np.ndarray, first: np.ndarray):
        """(hit words, longest match ending at each, documents and item numbers of the hits, distinct)."""
        ids = self.words.find(hashes)
        state, length = self.longest(ids, first)
        n, doc, found = len(ids), K.doc_of(first), []
        edge = np.zeros(n + 1, np.int64)
        for k, w in enumerate(self.sizes.tolist()):
            at = np.flatnonzero(length >= w)
            key = k * self.states + self.holder[k][state[at]].astype(np.int64)
            if not len(at):
                continue
            pos = np.minimum(np.searchsorted(self.wkeys, key), len(self.wkeys) - 1)
            ok = self.wkeys[pos] == key
            at, pos = at[ok], pos[ok]
            np.add.at(edge, at - w + 1, 1)
            np.add.at(edge, at + 1, -1)
            found.append(np.unique(doc[at] * len(self.wkeys) + pos))
        which = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        d, w = np.divmod(which, max(1, len(self.wkeys)))
        many = self.start[w + 1] - self.start[w]
        each = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[w], many)
        pairs = np.unique(np.repeat(d, many) * (len(self.names) + 1) + self.items[each] + 1)
        d, i = np.divmod(pairs, len(self.names) + 1)
        return np.cumsum(edge[:-1]) > 0, length, d[i > 0], i[i > 0] - 1


def _pack(a: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **a)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


class _Shard:
    """A shard as it is sent to executors; its tables for look-up are made once a worker."""

    def __init__(self, data: bytes, names: list):
        self.data, self.names, self._matcher = data, names, None

    def __getstate__(self):
        return self.data, self.names

    def __setstate__(self, state):
        self.data, self.names = state
        self._matcher = None

    @property
    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(_unpack(self.data), self.names)
        return self._matcher


def _dealt(items: DataFrame, window: int, most: int, piece: int) -> DataFrame:
    """Rows (shard, id, text) of items or, of long ones, overlapping pieces of words; shards of at most ``most`` words."""

    def cut(batches):
        for b in batches:
            ids, texts, sizes = [], [], []
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                low = _FOLD[buf]
                s, e, first = K.words(low, offs)
                for d in range(hi - lo):
                    n = int(first[d + 1] - first[d])
                    for a in range(0, max(1, n - window + 1), piece):
                        z = min(n, a + piece + window - 1)
                        if n:
                            ids.append(b.column(0)[lo + d].as_py())
                            texts.append(low[s[first[d] + a] : e[first[d] + z - 1]].tobytes().decode())
                            sizes.append(z - a)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["id", "text", "n"])

    cut_items = table(arrow(items.select(F.col("item_id").cast("string").alias("id"), "text").distinct(), cut, "id string, text string, n long"), "decontam-items")
    total = cut_items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // most))
    while True:
        dealt = cut_items.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))
        if shards == 1 or dealt.groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] <= max(most, piece + window):
            return dealt
        shards += -(-shards // 4)


def automata(items: DataFrame, window: int = WINDOW, most: int = SHARD_WORDS, piece: int = PIECE_WORDS) -> list[int]:
    """Table (shard, names, automaton) of the items (item_id, text), one row a shard, built by executors."""

    def make(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_pylist()
        names = sorted({*ids} - {None})
        number = {x: i for i, x in enumerate(names)}
        _, _, first, h = words(t.column("text"))
        a = build(h, first, np.array([number.get(x, -1) for x in ids]), window)
        return pa.table({"shard": t.column("shard").slice(0, 1), "names": pa.array([names], pa.list_(pa.string())), "automaton": pa.array([_pack(a)], pa.binary())})

    return table(_dealt(items, window, most, piece).groupBy("shard").applyInArrow(make, "shard int, names array<string>, automaton binary"), "decontam-automata")


def _spans(hit, length, s, e, first, buf, offs):
    """For each document its maximal runs of hit words: first word, words, first code point, code points, longest match in it."""
    n = len(hit)
    open_, close = hit.copy(), hit.copy()
    if n:
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        open_[1:] &= ~hit[:-1] | begins[1:n]
        close[:-1] &= ~hit[1:] | begins[1:n]
    a, b = np.flatnonzero(open_), np.flatnonzero(close)
    doc = np.searchsorted(first, a, "right") - 1
    if not len(a):
        return doc, [a] * 5
    points = np.zeros(len(buf) + 1, np.int32)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    start = points[s[a]] - points[offs[doc]]
    size = points[e[b]] - points[s[a]]
    best = np.maximum.reduceat(np.append(length, 0), np.stack([a, b + 1], 1).ravel())[::2]
    return doc, [a - first[doc], b - a + 1, start, size, best]


def _scanner(shard):
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("word", "words", "start", "length", "longest")]))

    def run(batches):
        m = shard.value.matcher
        for batch in batches:
            out = []
            for lo, hi, buf, offs in K.chunks(batch.column(1)):
                s, e, first, h = _words(buf, offs)
                if len(m.sizes):
                    hit, length, d, i = m.hits(h, first)
                else:
                    hit, length, d, i = np.zeros(len(h), bool), np.zeros(len(h), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
                sd, cols = _spans(hit, length, s, e, first, buf, offs)
                upto = np.arange(hi - lo + 1)
                names = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, upto), pa.int32()), pa.array(m.names[i].tolist(), pa.string()))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(sd, upto), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], fields=list(kind.value_type)))
                out.append(pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(K.sums(hit, first)), names, spans], names=["doc_id", "n_words", "n_hit", "items", "spans"]))
            yield from out

    return run


def _shards(built: DataFrame):
    """Broadcasts of the shards, one after the other; the driver and executors hold one of several at a time."""
    sc, numbers = built.sparkSession.sparkContext, sorted(r.shard for r in built.select("shard").collect())
    for k in numbers:
        row = built.where(F.col("shard") == k).first()
        sent = sc.broadcast(_Shard(bytes(row.automaton), row.names))
        yield sent, len(numbers)
        if len(numbers) > 1:
            sent.destroy()


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = SHARD_WORDS, piece: int = PIECE_WORDS) -> DataFrame:
    """One row per document (doc_id, text): n_words, n_hit, ids of the items with windows in it, hit spans (places in words and in code points)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    built = automata(items, window, most, piece)
    if built.count() > 1:
        return _merged(slim, built)
    none = _Shard(_pack(build(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), window)), [])
    part = next(_shards(built), None) or (docs.sparkSession.sparkContext.broadcast(none), 1)
    return slim.transform(arrow, _scanner(part[0]), SCHEMA)


def _merged(slim: DataFrame, built: DataFrame) -> DataFrame:
    """One pass a shard; spans of all passes are united."""
    keyed = slim.withColumn("digest", F.sha2("text", 256))
    names = keyed.columns
    found = None
    for part, _ in _shards(built):
        scanner = _scanner(part)

        def run(batches, scanner=scanner):
            for b in batches:
                n, rows = 0, b
                for r in scanner(iter([b])):
                    yield pa.record_batch([rows.column(names.index("digest")).slice(n, r.num_rows), *r.columns], names=["digest", *r.schema.names])
                    n += r.num_rows

        hits = keyed.transform(arrow, run, f"digest string, {SCHEMA}").where("n_hit > 0")
        path = new_path(slim.sparkSession, "decontam-hits")
        hits.write.parquet(path)  # rows of documents with hits only
        one = slim.sparkSession.read.schema(hits.schema).parquet(path)
        found = one if found is None else found.unionByName(one)
    # spans of one document overlap or touch across passes: order them and join them where they do
    united = (
        found.dropDuplicates(["doc_id", "digest", "items", "spans"]).groupBy("doc_id", "digest")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    step = """aggregate(spans, cast(array() as array<struct<word:int,words:int,start:int,length:int,longest:int>>), (acc, x) ->
        if(size(acc) > 0 and x.word <= element_at(acc, -1).word + element_at(acc, -1).words,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('word', element_at(acc, -1).word, 'words', greatest(element_at(acc, -1).words, x.word + x.words - element_at(acc, -1).word),
             'start', element_at(acc, -1).start, 'length', greatest(element_at(acc, -1).length, x.start + x.length - element_at(acc, -1).start), 'longest', greatest(element_at(acc, -1).longest, x.longest)))),
           concat(acc, array(x))))"""
    united = united.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g"), "items", F.expr(step).alias("spans"))
    counted = keyed.transform(arrow, _counter(names), "doc_id long, digest string, n_words long")
    joined = counted.join(united, counted.doc_id.eqNullSafe(united._d) & counted.digest.eqNullSafe(united._g), "left")
    n_hit = F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.words), 0L)")
    empty = lambda c: F.coalesce(c, F.expr(f"cast(array() as {dict(united.dtypes)[c]})")).alias(c)
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), empty("items"), empty("spans"))


def _counter(names):
    def run(batches):
        for b in batches:
            _, _, first, _ = words(b.column(names.index("text")))
            yield pa.record_batch([b.column(0), b.column(names.index("digest")), pa.array(np.diff(first))], names=["doc_id", "digest", "n_words"])

    return run


def remove(docs: DataFrame, items: DataFrame, max_span: int = 12, max_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Documents as they may be trained on, all columns kept.

    A document of whose words more than ``max_coverage`` are hit goes. Of the others, spans of more than ``max_span``
    words are cut out of ``text`` (from the first character of the first word to the last of the last); shorter ones stay.
    Works beside the row, without a join, if the items fill one shard; more shards are passes one after the other,
    whose cuts add up (coverage is then judged shard by shard, on the text as it came to that pass)."""
    names, at, schema = docs.columns, docs.columns.index("text"), docs.schema
    for part, parts in _shards(automata(items, window)):
        scanner = _scanner(part)

        def run(batches, scanner=scanner):
            for b in batches:
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                pair, n = pa.record_batch([pa.array(np.arange(b.num_rows)), b.column(at)], names=["doc_id", "text"]), 0
                for r in scanner(iter([pair])):
                    total, hit = r.column(1).to_numpy(), r.column(2).to_numpy()
                    keep[n : n + r.num_rows] = hit <= max_coverage * total
                    for i in np.flatnonzero(hit).tolist():
                        t, end, out = texts[n + i], 0, []
                        for x in r.column(4)[i].as_py():
                            if x["words"] > max_span:
                                out.append(t[end : x["start"]])
                                end = x["start"] + x["length"]
                        texts[n + i] = "".join(out) + t[end:]
                    n += r.num_rows
                yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).filter(pa.array(keep))

        docs = docs.select(*names).transform(arrow, run, schema)
        if parts > 1:  # written before the next shard takes the place of this one
            docs = table(docs, "decontam-pass")
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from those of ``scan``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') s FROM (SELECT item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') s FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS MATERIALIZED (SELECT rid, dw.k, i, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + k)) p FROM (SELECT DISTINCT rid, k, i FROM h)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
