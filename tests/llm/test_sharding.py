import random
import zlib
from collections import defaultdict

from pagewright.llm import sharding


def check(docs, result, shards=8):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = result.collect()
    assert len(rows) == docs.count()
    of_text, loads, slots = defaultdict(set), [0] * shards, defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        of_text[texts[r["doc_id"]]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in of_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_balance_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    loads = check(docs, sharding.by_bytes(docs))
    assert max(loads) - min(loads) <= 0.01 * sum(loads)


def test_cells_and_a_hot_group(spark):
    draw = random.Random(1)
    rows = [(i, "hot text " * 30) for i in range(200)] + [(i, "t" * draw.randint(1, 90) + str(i)) for i in range(200, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    loads = sorted(check(docs, sharding.by_bytes(docs, cell_groups=100)))
    assert loads[-1] == 200 * 271 and loads[-2] - loads[0] <= 0.02 * sum(loads[:-1])
    even = docs.where("doc_id >= 200")
    loads = check(even, sharding.by_bytes(even, cell_groups=100))
    assert max(loads) - min(loads) <= 0.01 * sum(loads)


def test_groups_beyond_a_cells_share_beside_a_hot_group(spark):
    draw = random.Random(2)
    rows = [(i, "hot " * 250) for i in range(100)] + [(i, f"{i} " + "m" * draw.randint(300, 370)) for i in range(100, 180)]
    rows += [(i, f"{i} " + "t" * draw.randint(1, 60)) for i in range(180, 2200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    loads = sorted(check(docs, sharding.by_bytes(docs, cell_groups=20)))
    assert loads[-1] == 100 * 1001 and loads[-2] - loads[0] <= 0.005 * sum(loads[:-1])
    few = docs.where("doc_id >= 95")
    loads = check(few, sharding.by_bytes(few, cell_groups=20))
    assert max(loads) - min(loads) <= 0.005 * sum(loads)


def plain_difference(sizes, shards):
    """Loads by the definition: lists are sorted anew at every step, the two of largest spread combined."""
    parts = [[0] * (shards - 1) + [x] for x in sizes]
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda i: (parts[i][0] - parts[i][-1], i))
        a, b = parts[order[0]], parts[order[1]]
        parts = [p for i, p in enumerate(parts) if i not in order[:2]] + [sorted(x + y for x, y in zip(a, reversed(b), strict=True))]
    return parts[0]


def test_differencing_matches_its_definition():
    draw = random.Random(4)
    for sizes, shards in [([8, 7, 6, 5, 4], 3), *(([draw.randint(1, 1000) for _ in range(draw.randint(1, 60))], draw.randint(2, 9)) for _ in range(40))]:
        bins = sharding.difference([sharding.single(w, i, shards) for i, w in enumerate(sizes)], shards)
        assert sorted(load for load, _ in bins) == plain_difference(sizes, shards)
        held = [list(sharding.contents(linked)) for _, linked in bins]
        assert sorted(i for items in held for i in items) == list(range(len(sizes)))
        assert [sum(sizes[i] for i in items) for items in held] == [load for load, _ in bins]


def test_odd_rows(spark, odd, odd_rows, nothing):
    rows = sharding.by_bytes(odd).collect()
    assert len(rows) == len(odd_rows) and sorted({r["doc_id"] for r in rows if r["doc_id"] is not None}) == sorted({r[0] for r in odd_rows if r[0] is not None})
    assert sharding.by_bytes(nothing).count() == 0
