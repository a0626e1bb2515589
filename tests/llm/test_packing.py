import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import kernels as K, packing

RAND = random.Random(9)


def texts():
    some = ["the", "it's", "ñandú", "don't've", "日本語", "123", "  ", "\n\n", "\t", " ", "　", "a ", "!?", "<|endoftext|>", "😀", "x\x1cy", " ", "'s", "'"]
    out = [None, "a <|endoftext|> b <|x", "<|endoftext|>", "<|endoftext|><|endoftext|> <|endoftext|", "", " ", "\n \n", "hello", " hello ", "a   b", "a   b  c", "The  end.\n"]
    for _ in range(120):
        out.append("".join(RAND.choice(some) + RAND.choice([" ", "", "  ", "\n"]) for _ in range(RAND.randrange(60))))
    out.append("word " * 9000)
    out.append("q" * 5000 + " z" * 2047)
    return out


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer():
    own, t = texts(), reference()
    buf, offs = K.string_buffer(pa.array(own))
    ids, first = packing.encode(buf, offs, packing.vocabulary_path())
    for d, x in enumerate(own):
        assert ids[first[d] : first[d + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)


def sequential(lengths, size):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def check_places(rows, size):
    """Gapless, within the size; returns the number of sequences."""
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq)


def test_bands_cover_every_length():
    for size in (2, 3, 10, 64, 2048):
        rounds = packing.bands(size)
        assert [x for lo, hi in rounds for x in range(hi, lo - 1, -1)] == list(range(size - 1, 0, -1))
    assert len(packing.bands()) < 30


@pytest.mark.parametrize("size,shape", [(64, "even"), (64, "small"), (2048, "even"), (2048, "skew"), (2048, "one")])
def test_about_as_few_sequences_as_sequential_best_fit(spark, monkeypatch, size, shape):
    monkeypatch.setattr(packing, "RANGE", 50)  # hot lengths and gaps are dealt over several ranges
    draw = {"even": lambda: RAND.randrange(1, size), "small": lambda: RAND.randrange(1, 6), "skew": lambda: min(size - 1, int(RAND.lognormvariate(5.7, 1)) + 1), "one": lambda: RAND.choice([500, 500, 500, 30, 1])}[shape]
    lengths = [draw() for _ in range(1_500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "q long, length int").repartition(3)
    rows = packing.place(df, size).collect()
    assert sorted((r.q, r.length) for r in rows) == list(enumerate(lengths))
    used, best = check_places(rows, size), sequential(lengths, size)
    assert used <= best * 1.02, (used, best)


def test_sweep_takes_the_successor():
    """The levels match each piece, longest first, with the smallest free slot that is large enough."""
    for _ in range(200):
        longest = RAND.randrange(5, 40)
        pieces = {x: RAND.randrange(1, 5) for x in range(max(1, longest - 6), longest + 1) if RAND.random() < 0.7} or {longest: 1}
        gaps = {g: RAND.randrange(1, 4) for g in RAND.sample(range(1, 64), 12)}
        new, slots, top = packing.levels(pieces, dict(gaps), longest, 64)
        held = dict(gaps)
        held[64] = held.get(64, 0) + new
        own = {g: (max(1, g // longest), below) for g, below in slots.items()}
        events = [(-(g // k), 0, below + r * k + j + 1, g) for g, (k, below) in own.items() for r in range(held[g]) for j in range(k)]
        events += [(-x, 1, top[x] - r, x) for x, n in pieces.items() for r in range(n)]
        free, taken, by_level = sorted(-e[0] for e in events if not e[1]), [], {}
        for at, kind, level, x in sorted(events, key=lambda e: (e[0], e[1])):
            if kind:
                taken.append((x, by_level.pop(level)))  # KeyError: no slot on that level
            else:
                assert level not in by_level
                by_level[level] = -at
        for x, s in sorted(taken, key=lambda t: (-t[0], t[1])):
            want = min(v for v in free if v >= x)
            assert s == want
            free.remove(s)


def test_pieces_are_gapless_and_whole(spark):
    own, t = texts(), reference()
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(own)] + [(6, own[6], 1), (None, "n", 1)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    used = check_places(rows, 2048)
    for i, x in enumerate(own):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        rs = sorted(by_doc[i], key=lambda r: r.piece)
        if i == 6:
            assert len(rs) == 2
            continue
        assert [r.piece for r in rs] == list(range(len(rs))) and sum(r.length for r in rs) == len(ids)
        assert all(r.length == 2048 for r in rs[1:])
        for r in rs:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    lengths = [r.length for r in rows if r.length < 2048]
    assert used <= sequential(lengths, 2048) + 1 + sum(r.length == 2048 for r in rows)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
