from disclosight.llm.common import Recent, owned, working_for


def test_recent_values_stay():
    cache = Recent(10)
    for n in range(100):
        cache.keep(n, -n)
        assert len(cache) + len(cache.older) <= 10
        if 7 not in cache and n > 7:
            assert cache.again(7) == -7  # asked for again and again, so never dropped
    assert cache.get(99) == -99 and cache.again(1) is None
    cache.clear()
    assert not cache and not cache.older


def test_falsy_values_are_values():
    cache = Recent(2)
    cache.keep("a", False)
    cache.keep("b", b"")
    assert cache.again("a") is False and cache.get("a") is False


def test_other_owners_give_their_caches_back():
    mine, other = owned("mine", Recent(10)), owned("other", Recent(10))
    working_for("mine")
    mine.keep(1, 1)
    other.keep(2, 2)
    working_for("mine")
    assert mine and other
    working_for("other")
    assert not mine and other
    working_for("")
    assert not other
