"""Near pairs of hashes that lie close together, in several tiles."""

from pyspark.sql import functions as F

from siteloom.operators import similarity


def test_many_near_hashes(spark):
    values = sorted({(k * 2654435761 % 4096) << 3 | 0xABC << 40 for k in range(300)} | {(1 << 63) | k for k in range(5)})
    rows = [(f"d{k}", f"{v:016x}") for k, v in enumerate(values)] + [("e", f"{values[0]:016x}")]
    hashes = spark.createDataFrame(rows, "doc_id string, simhash string")
    low = {d: v for d, v in reversed([(d, int(h, 16)) for d, h in rows if d != "e"])}
    expected = sorted((min(a, b), max(a, b), (low[a] ^ low[b]).bit_count()) for a in low for b in low if low[a] < low[b] and (low[a] ^ low[b]).bit_count() <= 6)
    assert len(expected) > len(rows) * 20
    for parts in (1, 5):
        pairs = similarity.simhash_pairs(hashes, parts=parts)
        assert sorted(tuple(r) for r in pairs.select("a", "b", "distance").collect()) == expected
        # Pairs are not shuffled: only hashes are.
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.index("MapInArrow") < plan.index("Exchange")
    best = similarity.closest(hashes, pairs).where(F.col("doc_id") == "d1").first()
    mine = [(d, b if a == "d1" else a) for a, b, d in expected if "d1" in (a, b)]
    assert (best.closest, best.partners >= len(mine)) == (min(mine)[1], True)
