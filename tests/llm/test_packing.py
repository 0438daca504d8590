import random
from collections import defaultdict

from signloom.llm import packing as P


def packed(spark, items, **k):
    df = spark.createDataFrame([(i, n, "b", 3) for i, n in items], "doc_id long, tokens int, bin string, start int")
    return P.pack(df, "doc_id", "tokens", 100, **k).collect()


def check(rows, items):
    fills, spans = defaultdict(int), defaultdict(list)
    for r in rows:
        fills[r["bin"]] += r["size"]
        spans[r["doc_id"]].append((r["start"], r["size"]))
    assert max(fills.values(), default=0) <= 100
    want = defaultdict(list)
    for i, n in items:
        if n and n > 0:
            want[i] += [(s, min(100, n - s)) for s in range(0, n, 100)]
    assert {i: sorted(v) for i, v in spans.items()} == {i: sorted(v) for i, v in want.items()}
    return fills


def test_every_token_once_and_little_room_left(spark):
    rng = random.Random(6)
    items = [(i, min(400, int(rng.paretovariate(1.1) * 8))) for i in range(3000)] + [(3000, None), (3001, 0), (3002, 100), (3003, 100000), (3004, -1), (7, 5), (7, 5), (None, 9)]
    for group in (100, 10_000):
        fills = check(packed(spark, items, group_items=group), items)
        total = sum(fills.values())
        assert len(fills) <= total / 100 * 1.01 + 1


def test_small_inputs(spark):
    assert packed(spark, []) == []
    assert check(packed(spark, [(1, 60), (2, 60)]), [(1, 60), (2, 60)])
    assert len(check(packed(spark, [(n, 100) for n in range(5)]), [(n, 100) for n in range(5)])) == 5


def test_exchanges_empty_a_bin():
    # best fit leaves 60+60 apart; swaps find 60+40, 60+40, 50+50
    sizes = [60, 60, 50, 50, 40, 40]
    bins = P.swap_search([[0], [1], [2, 4], [3, 5]], sizes, 100)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(6))


def improvable(bins, sizes, capacity):
    """Whether giving one item or two for one or none makes the fuller bin of any two fuller still, tried out pair by pair."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    given = [{0, *(sizes[i] for i in b), *(sizes[i] + sizes[j] for i in b for j in b if i < j)} for b in bins]
    back = [{0, *(sizes[i] for i in b)} for b in bins]
    return any(
        max(fills[x], fills[y]) < max(fills[x] - s + c, fills[y] + s - c) <= capacity
        for x in range(len(bins)) for y in range(len(bins)) if x != y for s in given[x] for c in back[y]
    )


def test_search_ends_where_no_exchange_of_any_two_bins_helps():
    rng = random.Random(3)
    for sizes in ([rng.randint(300, 900) for _ in range(600)], [rng.randint(500, 1000) for _ in range(400)], [rng.randint(1, 60) for _ in range(900)] + [1500] * 30):
        first = P.best_fit(sizes, 2048)
        bins = P.swap_search([list(b) for b in first], sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in bins) <= 2048 and len(bins) <= len(first)
        assert not improvable(bins, sizes, 2048)
    sizes = [10] * 58 + [13, 14, 1973]  # only the last two items of the first bin fill the other
    assert [1973, 13, 14] in [[sizes[i] for i in b] for b in P.swap_search([[*range(60)], [60]], sizes, 2000)]


def test_room_in_many_bins_saves_containers():
    rng = random.Random(1)
    sizes = [rng.randint(300, 900) for _ in range(2000)]
    first = P.best_fit(sizes, 2048)
    assert len(first) == 609 and len(P.swap_search(first, sizes, 2048)) <= 600  # 592 is a lower bound


def test_the_search_empties_the_bins_that_the_first_placement_leaves():
    rng = random.Random(2)
    for sizes, most in (([1 + int(rng.expovariate(1 / 400)) % 2000 for _ in range(3000)], 1), ([rng.randint(300, 900) for _ in range(3000)], 8)):
        first, least = P.next_fit(sizes, 2048), -(-sum(sizes) // 2048)
        assert sorted(i for b in first for i in b) == list(range(len(sizes)))
        bins = P.swap_search([list(b) for b in first], sizes, 2048)
        assert len(first) > 1.1 * least and len(bins) <= least + most
