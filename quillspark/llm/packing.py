"""Operator 10: bulk-synchronous best-fit packing.

Documents are encoded (byte-level BPE) and end with id 0. A document longer than a sequence is cut into
pieces of SIZE tokens of which the first may be shorter; full pieces are sequences of their own, so one
piece of a document at most (shorter than SIZE) has to be packed.

Pieces are range-sorted by decreasing length once: the ranges are the lengths, a hot length is dealt over
further ranges by hash, and the counts of the ranges give every piece its dense rank within its length.
Then rounds run from the longest band of lengths to the shortest (each band reaches down to STEP of its
longest length, or half of it where lengths are below FEW * SIZE; their number depends on SIZE only). A round:
 1. the gaps of the open sequences are range-sorted in the same way; a gap that holds k pieces of the
    band's longest length offers k equal slots, one that holds a shorter piece of the band offers one;
 2. where the band has more pieces than slots for them, new sequences are opened, no more than needed;
 3. one sweep in decreasing size over slots and pieces together matches each piece with its successor, the
    smallest slot that is large enough and not taken by a longer piece or one of lower rank: a slot opens a
    level of a stack, a piece takes the top one. The levels follow from ranks and counts, so the sweep is a
    window over each level by itself, and a level has at most one slot of each gap;
 4. the gaps are updated by what was placed, in one aggregation.
Every piece of a band is placed in its round. The driver sees the numbers of pieces of each length and of
sequences of each gap and range, at most 2 * (SIZE + RANGES) numbers a round; pieces, gaps and matches stay distributed, and each
round is written to the shared folder, so a lost executor costs no more than its own tasks.

Edge cases: null text is empty and packs as the single id 0. Repeated rows are packed one by one; null
ids are packed too. An empty table gives no row. Special-token strings in a text become their ids, as the
vocabulary file's tokenizer has it. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import kernels as K
from .store import arrow, table

SIZE, END = 2048, 0
#: A band of lengths reaches down to STEP of its longest, below a share of FEW of a sequence to half of it.
STEP, FEW, WHOLE = 0.8, 1 / 32, 4
#: Pieces or gaps of one size in a range at least, and ranges beside one for each size at most.
RANGE, RANGES = 1_000, 1_000
VOCABULARY = "byte_bpe_50k.json"
#: Larger chunks share more words, smaller ones need less memory.
CHUNK = 3 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def _encoder(path: str):
    """(encoding, bytes of each id, special strings with their ids). All comes from the vocabulary file itself."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    vocab, added = known["model"]["vocab"], {t["content"].encode(): t["id"] for t in known["added_tokens"]}
    # the printable stand-ins of bytes in byte-level vocabularies
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if all(c in back for c in token) and token.encode() not in added}
    enc = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return enc, size, added


def _odd_space(buf, offs) -> np.ndarray:
    """Documents with white space outside ASCII, which can join a run across our cuts."""
    n = len(buf)
    out = np.zeros(len(offs) - 1, bool)
    if n < 2:
        return out
    a, b = buf[:-1], buf[1:]
    c = np.append(buf[2:], 0) if n > 2 else np.zeros(1, np.uint8)
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    hit |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    at = np.flatnonzero(hit)
    out[np.searchsorted(offs, at, "right") - 1] = True
    return out


def encode(buf, offs, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): ids of document d are ids[first[d]:first[d+1]]. What stands between special strings is encoded by itself."""
    _, _, added = _encoder(path)
    found = re.compile(b"|".join(sorted(map(re.escape, added), key=len, reverse=True))) if added else None
    hits = [m for m in found.finditer(buf.tobytes())] if found else []
    doc = np.searchsorted(offs, [m.start() for m in hits], "right") - 1
    hits = [(m.start(), m.end(), added[m.group()]) for m, d in zip(hits, doc) if m.end() <= offs[d + 1]]
    if not hits:
        return _ordinary(buf, offs, path)
    begin, end = (np.array(x, np.int64) for x in zip(*[h[:2] for h in hits]))
    # pieces between all bounds; those that are special strings are emptied and get their id
    bound = np.unique(np.concatenate([offs, begin, end]))
    special = np.zeros(len(bound) - 1, bool)
    special[np.searchsorted(bound, begin)] = True
    keep = np.repeat(~special, np.diff(bound))
    ids, first = _ordinary(buf[keep], np.concatenate([[0], np.cumsum(np.where(special, 0, np.diff(bound)))]), path)
    at = np.searchsorted(bound, begin)
    out = np.insert(ids, first[at], np.array([h[2] for h in hits], ids.dtype))
    first = first + np.concatenate([[0], np.cumsum(special)])
    return out, first[np.searchsorted(bound, offs)]


def _ordinary(buf, offs, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The same without special strings.

    A cut before white space that follows other text never changes the encoding, so each different
    stretch of white space and text is encoded once per chunk."""
    enc, size, _ = _encoder(path)
    _, ends, wf = K.words(buf, offs)
    odd = _odd_space(buf, offs)
    if odd.any():
        keep = ~odd[K.doc_of(wf)]
        wf = np.concatenate([[0], np.cumsum(K.sums(keep, wf))])
        ends = ends[keep]
    # cuts: document starts and word ends, without empty stretches
    cut = np.unique(np.concatenate([offs, ends]))
    lo, hi = cut[:-1], cut[1:]
    if not len(lo):
        return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
    _, at, of = np.unique(K.span_hashes(buf, lo, hi), return_index=True, return_inverse=True)
    a, b = lo[at], hi[at]
    safe = K._WS[buf[a]] & ~K._WS[buf[b - 1]] & ~odd[np.searchsorted(offs, a, "right") - 1]
    ids, count = [], np.zeros(len(at), np.int64)
    first_id = np.zeros(len(at), np.int64)
    own = np.flatnonzero(safe)
    total = 0
    if len(own):
        n = b[own] - a[own]
        idx = np.arange(n.sum()) + np.repeat(a[own] - (np.cumsum(n) - n), n)
        got = np.array(enc.encode_to_numpy(buf[idx].tobytes().decode("utf-8", "replace"), disallowed_special=()), np.uint32)
        stop = np.searchsorted(np.cumsum(size[got]), np.cumsum(n), "left") + 1
        first_id[own] = np.concatenate([[0], stop[:-1]])
        count[own] = stop - first_id[own]
        ids.append(got)
        total = len(got)
    for i in np.flatnonzero(~safe):
        got = np.array(enc.encode_ordinary(buf[a[i] : b[i]].tobytes().decode("utf-8", "replace")), np.uint32)
        first_id[i], count[i] = total, len(got)
        ids.append(got)
        total += len(got)
    pool = np.concatenate(ids)
    n = count[of]
    stream = pool[np.arange(n.sum()) + np.repeat(first_id[of] - (np.cumsum(n) - n), n)]
    per = np.concatenate([[0], np.cumsum(n)])
    return stream, per[np.searchsorted(lo, offs)]


def _pieces(path: str, size: int):
    def run(batches):
        tail = np.array([END], "<u4").tobytes()
        for b in batches:
            rows = [[], [], [], [], []]
            ids = b.column(0).to_pylist()
            for lo, hi, buf, offs in K.chunks(b.column(1), CHUNK):
                stream, first = encode(buf, offs, path)
                stream = stream.astype("<u4", copy=False)
                for d in range(hi - lo):
                    x = stream[first[d] : first[d + 1]].tobytes() + tail
                    n = len(x) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k in range(len(cuts) - 1):
                        rows[0].append(ids[lo + d]), rows[1].append(k), rows[2].append(cuts[k]), rows[3].append(cuts[k + 1] - cuts[k])
                        rows[4].append(zlib.crc32(x[4 * cuts[k] : 4 * cuts[k + 1]]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def bands(size: int = SIZE) -> list[tuple[int, int]]:
    """(shortest, longest) length of each round, from the longest pieces to the shortest.

    Down to size / 8 no band reaches over size / k, so all its pieces go k to a new sequence; down to size / WHOLE such a class of
    pieces is one band, as no gap that one of them leaves behind holds another beyond the k."""
    out, hi = [], size - 1
    while hi:
        lo = int(hi * STEP) + 1 if hi > FEW * size else hi // 2 + 1
        if hi * 8 > size:
            least = size // (size // hi + 1) + 1
            lo = least if hi * WHOLE > size else max(lo, least)
        out.append((min(lo, hi), hi))
        hi = out[-1][0] - 1
    return out


def _counts(df: DataFrame, key: str) -> dict[int, int]:
    """Rows of each value of key, of which there are at most SIZE + RANGES."""
    return {int(k): int(n) for k, n in df.groupBy(key).count().collect()}


def _at(numbers: dict[int, int], key: Column) -> Column:
    """The number of a key, from a literal array of at most SIZE + RANGES numbers."""
    dense = ",".join(str(numbers.get(i, 0)) for i in range(max(numbers) + 1))
    return F.get(F.split(F.lit(dense), ",").cast("array<long>"), key.cast("int"))


def _ranked(df: DataFrame, key: str, order: str, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, dense from 0 among the rows of each value of key; hot values are dealt over several ranges.

    A range holds RANGE rows, or a RANGES-th of all rows if that is more, so there are at most SIZE + RANGES of them."""
    most = max(RANGE, -(-sum(counts.values()) // RANGES))
    ranges = {k: -(-n // most) for k, n in sorted(counts.items())}
    if max(ranges.values()) == 1:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)
    first = dict(zip(ranges, np.cumsum([0, *ranges.values()]).tolist()))
    df = df.withColumn("range", (_at(first, F.col(key)) + F.pmod(F.xxhash64(order), _at(ranges, F.col(key)))).cast("int"))
    n, skip = _counts(df, "range"), {}
    for k, own in ranges.items():
        sizes = [n.get(first[k] + i, 0) for i in range(own)]
        skip |= dict(zip(range(first[k], first[k] + own), np.cumsum([0, *sizes]).tolist()))
    inside = F.row_number().over(W.partitionBy("range").orderBy(order)) - 1
    return df.withColumn("rank", inside + _at(skip, F.col("range"))).drop("range")


def levels(pieces: dict[int, int], gaps: dict[int, int], longest: int, size: int) -> tuple[int, dict[int, int], dict[int, int]]:
    """(new sequences, gap -> level below its first slot, length -> level of its first piece) of a round.

    A gap offers max(1, gap // longest) slots of equal size, rounded down.
    Counts of pieces by length and of sequences by gap decide; gaps too small for any piece are left out."""
    offered = lambda g: max(1, g // longest)
    gaps = {g: n for g, n in gaps.items() if g >= min(pieces)}

    def sweep():
        events = sorted([(-(g // offered(g)), 0, g, n * offered(g)) for g, n in gaps.items()] + [(-x, 1, x, n) for x, n in pieces.items()])
        depth, least, below, top = 0, 0, {}, {}
        for _, kind, x, n in events:
            if kind:
                top[x] = depth
                depth -= n
                least = min(least, depth)
            else:
                below[x] = depth
                depth += n
        return least, below, top

    least, below, top = sweep()
    new = -(least // (size // longest)) if least else 0
    if new:
        gaps[size] = gaps.get(size, 0) + new
        _, below, top = sweep()
    return new, below, top


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to size - 1, unique q)."""
    spark = pieces.sparkSession
    own, rounds = pieces.columns, bands(size)
    counts = _counts(pieces, "length")
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    band = F.coalesce(*[F.when(F.col("length") >= lo, i) for i, (lo, _) in enumerate(rounds)])
    ranked = table(_ranked(pieces.withColumn("length", F.col("length").cast("int")), "length", "q", counts).withColumn("band", band), "pack-ranked", by="band")
    used, gaps, done = 0, None, []
    for nth, (lo, hi) in enumerate(rounds):
        todo = {x: counts[x] for x in range(lo, hi + 1) if x in counts}
        if not todo:
            continue
        held = _counts(gaps, "gap") if gaps is not None else {}
        longest = max(todo)
        new, below, top = levels(todo, held, longest, size)
        if new:
            fresh = spark.range(used, used + new).select(F.col("id").alias("seq"), F.lit(size).alias("gap"))
            gaps, used = fresh if gaps is None else gaps.unionAll(fresh), used + new
            held[size] = held.get(size, 0) + new
        # slots open a level each, pieces take the slot opened last on theirs
        slots = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
        open_ = _ranked(gaps.where(F.col("gap") >= lo), "gap", "seq", held).withColumn("k", slots).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        level = _at(below, F.col("gap")) + F.col("rank").cast("long") * F.col("k") + F.col("nth") + 1
        open_ = open_.select(level.alias("level"), (-F.floor(F.col("gap") / F.col("k"))).cast("int").alias("at"), F.lit(0).alias("kind"), "seq", F.lit(None).cast(ranked.select(*own).schema).alias("p"))
        first = _at({x - lo: n for x, n in top.items()}, F.col("length") - lo)
        take = ranked.where(F.col("band") == nth).select((first - F.col("rank")).alias("level"), (-F.col("length")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), F.struct(*own).alias("p"))
        sweep = W.partitionBy("level").orderBy("at", "kind")
        put = open_.unionAll(take).withColumn("seq", F.coalesce("seq", F.lag("seq").over(sweep))).where("kind = 1").select("seq", (-F.col("p.length")).alias("gap"), "p")
        # one row for each open sequence: its gap, and what this round has put there, SIZE pieces at most
        both = gaps.select("seq", "gap", F.lit(None).cast(put.schema["p"].dataType).alias("p")).unionAll(put)
        both = both.groupBy("seq").agg(F.sum("gap").cast("int").alias("gap"), F.sort_array(F.collect_list("p")).alias("p"))
        done.append(table(both.where("gap > 0 or size(p) > 0").withColumn("nth", F.lit(nth)), "pack-round"))
        gaps = done[-1].where("gap > 0").select("seq", "gap")
    placed = reduce(DataFrame.unionAll, done).where("size(p) > 0").select(F.col("seq").alias("sequence_id"), "nth", F.posexplode("p").alias("at", "p"))
    before = W.partitionBy("sequence_id").orderBy("nth", "at").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.select("p.*", "sequence_id", "nth", "at")
    return placed.select(*own, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Full pieces have negative sequence numbers."""
    path = path or vocabulary_path()
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow, _pieces(path, size), PIECES)
    pieces = table(pieces.withColumn("q", F.monotonically_increasing_id()), "pack-pieces")
    full = pieces.where(F.col("length") == size).select("*", (-1 - F.col("q")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    both = place(pieces.where(F.col("length") < size), size).withColumn("length", F.col("length").cast("long")).unionByName(full)
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces. Only doc_id and text are read, so other columns may have any names; equal rows are packed each; an empty table gives no row."""
    return pack(docs)
