import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from faultline.llm import packing

PATH = packing.tokenizer_path()
SCHEMA = "doc_id long, text string, length int, rank string"


def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encode_equals_the_tokenizer(monkeypatch):
    t = model()
    odd = ["It's we'll 'Sam I'M", "Áb  é", "x y z\x85q\x1cw", "H̱ İI ΣΣ Σ", "<|endoftext|> a", "a <|endoftext|>b", "", "  ", "日本語 テスト 123½", "e ́x", "don't\nstop\x0b\x0cx\r\n", "a" * 3000, "ｆｕｌｌ ﬁ", "a\x01b \x01 \x01\x01 c\x01"]
    rnd = random.Random(3)
    alphabet = "aAbB'sStT1 \n\té́.,#$ĳΣςİ "
    odd += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    for ids, text in zip(packing.encode(odd, PATH), odd, strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_all(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 50, 2048])
    histogram = Counter(rnd.choice([rnd.randint(1, size), min(size, 3), size]) for _ in range(3000))
    fill, where = defaultdict(list), Counter()
    for length, rank, count, first, offset, per in packing.plan(histogram, size).tolist():
        assert rank == where[length]
        where[length] += count
        for j in range(count):
            fill[first + j // per].append((offset + j % per * length, length))
    assert where == histogram
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    assert len(fill) <= item_by_item(histogram, size)


def item_by_item(histogram, size):
    """Sequences that best-fit decreasing opens, item by item."""
    rooms = []
    for length in sorted(histogram.elements(), reverse=True):
        k = bisect.bisect_left(rooms, length)
        room = rooms.pop(k) if k < len(rooms) else size
        bisect.insort(rooms, room - length)
    return len(rooms)


def test_pack_round_trip(spark):
    rnd = random.Random(1)
    rows = [(d, " ".join(rnd.choice(["the", "Cat", "é1!", "x"]) for _ in range(rnd.choice([3, 3, 3, 40, 900, 3000])))) for d in range(120)]
    rows += [(500, None), (501, ""), (None, "the cat"), (7, "the cat"), (7, "the cat")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = packing.pack(df, PATH, ids=True).collect()
    t = model()
    want = Counter()
    for d, text in rows:
        ids = np.append(np.array(t.encode(text or "", add_special_tokens=False).ids, np.uint32), np.uint32(0)).astype("<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            body = ids[start : start + 2048]
            want[d, piece, start, len(body), zlib.crc32(body.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for spans in seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0), PATH).count() == 0
