import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import blocks


def test_counts_over_four_bytes_travel_whole():
    counts = np.array([0, 1, 254, 255, 256, 2**32 - 1, 2**32, 7 * 10**13])
    assert blocks.unpacked(blocks.packed(counts), len(counts)).tolist() == counts.tolist()


@pytest.mark.parametrize("top", [300, 2**20, 2**40, 2**64 - 1])
def test_keys_travel_whole(top):
    keys = np.sort(np.random.default_rng(1).integers(0, top, 500, "u8", endpoint=True))
    assert blocks.decoded(blocks.coded(keys), 500).tolist() == keys.tolist()


def test_rows_grow_with_the_input():
    """At most 2 FAN rows a block at all sizes, where one level would take a row for each block and range."""
    plans = [blocks.Plan.fit(size, 4 << 20, 16 << 20) for size in (10**9, 10**11, 10**12, 10**13, 10**14)]
    assert all(p.rows <= 2.1 * p.n_blocks * p.fan for p in plans)
    assert plans[-1].rows < plans[-1].n_blocks * plans[-1].n_buckets / 1000


def test_equal_rows_spread(spark, make):
    """A third of the rows is one id and text: no block holds more than twice its share, and places stay when rows are read again."""
    docs = make([(i, f"text {i}") for i in range(2000)] + [(7, "hot")] * 1000)
    plan = blocks.Plan(30, 4)
    deal = blocks.dealt(docs.select("doc_id", "text"), plan)
    n = {r["block"]: r["count"] for r in deal.groupBy("block").count().collect()}
    assert set(n) == set(range(30)) and max(n.values()) <= 200

    def opened(t: pa.Table) -> pa.Table:
        rows = blocks.sorted_block(t)
        return rows.append_column("block", pa.array([t.column("block")[0].as_py()] * rows.num_rows))

    packed = blocks.in_blocks(docs.select("doc_id", "text"), plan).groupBy("block").applyInArrow(opened, "doc_id long, text string, block long")
    assert packed.select("doc_id", "text", "block").exceptAll(deal).count() == 0 and packed.count() == 3000


def test_words_are_those_of_a_split_and_ranks_those_of_unique():
    import random

    rng = random.Random(3)
    for _ in range(300):
        texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x00\x85é 😀") for _ in range(rng.randrange(12))).encode() for _ in range(rng.randrange(5))] + [b"\xed\xa0\x80 \xff x"] * rng.randrange(2)
        words = blocks.Words.of(texts)
        each = iter([words.vocabulary[i] for i in words.ids])
        assert [[next(each) for _ in range(n)] for n in words.lengths] == [t.split() for t in texts]
        keys = np.array([rng.choice([0, 5, 2**64 - 1, rng.getrandbits(64)]) for _ in range(rng.randrange(20))], "u8")
        assert (blocks.ranks(keys) == np.unique(keys, return_inverse=True)[1]).all()
