import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from disclosight.llm import target_resampling as tr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, low, high):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, low, high, buckets, seed, least_words):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            for f in plain_features(text, low, high)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, features = plain_features(text, low, high)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(words), len(features), weight, score, zlib.crc32((text or "").encode())))
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    drawn = fit[:percent * len(fit) // 100]
    out = [(*r[:5], n + 1) for n, r in enumerate(drawn)]
    for r in drawn:
        rows.remove(r)
    return sorted(out + [(*r[:5], None) for r in rows], key=repr)


def test_position_table_equals_the_library():
    r = random.Random(1)
    data = np.frombuffer(bytes(r.randrange(256) for _ in range(20000)), np.uint8)
    for span in (4, 5, 16, 256):
        sizes = [0, 1, 2, 3, span - 1, span, span + 1, 2 * span, 2 * span + 1, 777, 9000]
        spans = [(a, min(20000, a + size)) for size in sizes for a in (0, 7, r.randrange(20000))]
        starts, ends = (np.array(x) for x in zip(*spans))
        assert tr.PositionCrc(span)(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in spans]
    assert tr.PositionCrc()(data[:0], np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_features_of_odd_texts():
    texts = ["Hello wÖrld, HeLLo  x", None, "", "a", "b c", " é z 1", "\x7f-- ", "ÄABC" * 400 + " q", "end", "日本 語x\U0001f600y"]
    for batch in (pa.array(texts), pa.array(["zz"] + texts)[1:], pa.array(texts)[2:5], pa.array([], pa.string())):
        words, owner, bucket = tr.Features(1, 3, 10000)(batch)
        plain = [plain_features(t, 1, 3) for t in batch.to_pylist()]
        assert words.tolist() == [len(w) for w, _ in plain]
        for i, (_, features) in enumerate(plain):
            assert bucket[owner == i].tolist() == [zlib.crc32(f.encode()) % 10000 for f in features]


def check(spark, make_docs, docs, target, **how):
    full = {"percent": 10, "low": 1, "high": 1, "buckets": 10_000, "seed": 2024, "least_words": 20} | how
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in tr.resample(make_docs(docs), frame, **how).collect()]
    assert sorted(got, key=repr) == brute(docs, target, **full)
    return got


def test_against_brute_force(spark, make_docs, prose):
    docs = [(i, prose(i, 5 + i % 60)) for i in range(260)]
    docs += [(900, None), (901, ""), (902, "...!"), (903, prose(3, 4000)), (None, prose(7, 30)), (None, prose(8, 30)), (None, prose(8, 30)),
             (5, docs[5][1]), (6, prose(99, 30)), (904, "ü" * 3000 + " " + prose(4, 40))]
    got = check(spark, make_docs, docs, [prose(1, 80), None, prose(500, 20)])
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 1 + sum(r[1] >= 20 for r in got) // 10))
    check(spark, make_docs, docs, [prose(1, 80)], percent=35, low=1, high=2, buckets=500, seed=3, least_words=1)


def test_many_equal_rows_spread_over_parts(spark, make_docs, prose, monkeypatch):
    monkeypatch.setattr(tr, "ROWS_PER_PART", 10)
    docs = [(None, prose(1, 30))] * 120 + [(7, prose(1, 30))] * 60 + [(i, prose(i, 25)) for i in range(100, 160)]
    check(spark, make_docs, docs, [prose(1, 30)], percent=60)


def test_empty_and_undrawn(spark, make_docs, prose):
    assert check(spark, make_docs, [], [prose(1, 9)]) == []
    check(spark, make_docs, [(1, prose(1, 30)), (2, "short")], [])


def test_drawn_documents_come_closer_to_the_target(spark, make_docs, prose):
    near = "zeta ypsi omeg kapp lamb".split()
    docs = [(i, prose(i, 40, near if i % 4 == 0 else tuple("abcdefghij"))) for i in range(400)]
    got = tr.resample(make_docs(docs), spark.createDataFrame([(0, prose(9999, 500, near))], "item_id long, text string")).collect()
    drawn = [r for r in got if r["rank"]]
    assert len(drawn) == 40 and sum(r["doc_id"] % 4 == 0 for r in drawn) >= 36
