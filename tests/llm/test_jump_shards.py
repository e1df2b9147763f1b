import zlib

from disclosight.llm import jump_shards


def jump(key, shards):
    key, at, ahead = key % 2**64, -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((at + 1) * (float(2**31) / float((key >> 33) + 1)))
    return at


def test_against_the_published_loop(make_docs):
    ids = [0, 1, -1, 2**63 - 1, -2**63, 123456789012345, *range(1000, 3000), None, 5, 5]
    rows = [(i, None if k % 7 == 0 else "é" * (k % 5)) for k, i in enumerate(ids)]
    got = jump_shards.shard(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        key = -1 if x.doc_id is None else x.doc_id
        assert (x.shard, x.grown_shard) == (jump(key, 24), jump(key, 25))
        assert x.grown_shard in (x.shard, 24) and x.law == "key"
    for shard in range(24):
        mine = [x.slot for x in got if x.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    by_id = dict(rows[:100])
    for x in got:
        if x.doc_id in by_id and x.doc_id not in (5, None):
            data = (by_id[x.doc_id] or "").encode()
            assert (x.size, x.text_crc32) == (len(data) + 8, zlib.crc32(data))


def test_no_python_in_the_plan(make_docs):
    plan = jump_shards.shard(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_few_shards_and_empty_table(make_docs):
    got = jump_shards.shard(make_docs([(i, "x") for i in range(50)]), shards=1, parts=2).collect()
    assert {x.shard for x in got} == {0} and sorted(x.slot for x in got) == list(range(50)) and {x.grown_shard for x in got} == {0, 1}
    assert jump_shards.shard(make_docs([])).count() == 0
