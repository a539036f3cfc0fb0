"""Operators on many rows together, against brute force on small fixtures."""

import collections
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import (
    chat,
    components,
    decontaminate,
    embeddings,
    lines,
    queries,
    resharding,
    simhash,
)
from ledgerlens.session import scratch_path
from tests.check import connect, differences
from tests.conftest import SF_DIR
from tests.llm import brute
from tests.llm.conftest import DOCUMENTS


def as_documents(spark, texts, sites=None):
    rows = [(i, t, "en", (sites or ["s"] * len(texts))[i], 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


# --- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    links += [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(1500, 1700)]
    links += [(5, 5), (None, 3), links[0]]
    rows = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in links if a is not None and a != b]
    groups = brute.Groups({n for pair in real for n in pair})
    for a, b in real:
        groups.join(a, b)
    assert collections.Counter(map(tuple, rows)) == collections.Counter(groups.smallest().items())


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- embeddings ----------------------------------------------------------------------------------


def clustered(seed, clusters=12, each=25, size=16):
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(size=(clusters, size)), each, axis=0)
    noise = rng.normal(size=centres.shape) * rng.uniform(0.05, 0.4, (len(centres), 1))
    return {i: v.tolist() for i, v in enumerate((centres + noise).astype(np.float32))}


def check_vectors(rows, links, ids, recall):
    degree = collections.Counter(itertools.chain(*links))
    found = {r["vec_id"]: r for r in rows}
    assert sum(r["n_links"] for r in rows) >= recall * sum(degree.values())
    assert all(r["n_links"] <= degree[i] for i, r in found.items())
    if recall == 1:
        groups = brute.Groups(ids)
        for a, b in links:
            groups.join(a, b)
        assert {i: r["component_id"] for i, r in found.items()} == groups.smallest()
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


@pytest.mark.parametrize("cell", [40, 8192])
def test_vectors_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings.near_links, "__defaults__", (0.9, 10, 0.05, cell))
    vectors = clustered(3)
    vectors |= {1000 + i: vectors[7] for i in range(30)}  # copies
    data = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>")
    rows = embeddings.near_duplicates(data).collect()
    assert len(rows) == len(vectors)
    check_vectors(rows, brute.cosine_links(vectors), vectors, 0.97 if cell == 40 else 1)


@pytest.mark.parametrize("cosine", [0.7, 0.9, 0.99])
def test_chance_of_parting(cosine):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2, 400_000))
    y = cosine * x + np.sqrt(1 - cosine**2) * y
    low, high = np.quantile(x, [0.45, 0.55])
    parted = ((x < low) & (y > high) | (y < low) & (x > high)).mean()
    assert abs(parted - embeddings.parting_chance(cosine, 0.05)) < 2e-3


def test_trees_grow_with_the_vectors():
    grown = [embeddings.trees_for(10**n) for n in range(0, 13)]
    assert grown == sorted(grown) and grown[:5] == [embeddings.TREES] * 5
    assert grown[12] > grown[9] > embeddings.TREES


def test_registered_vectors(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in data}
    rows = queries.op5_embeddings(spark, sf).collect()
    check_vectors(rows, brute.cosine_links(vectors), vectors, 0.99)


@pytest.mark.parametrize("cell", [300, 8192])
def test_a_crowd_of_near_copies_loses_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings.near_links, "__defaults__", (0.9, 2, 0.05, cell))
    rng = np.random.default_rng(4)
    crowd = rng.normal(size=64) + rng.normal(size=(1500, 64)) * 0.2
    data = enumerate(np.concatenate([crowd, rng.normal(size=(1000, 64))]).tolist())
    vectors = dict(data)
    frame = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    rows = embeddings.near_duplicates(frame.repartition(4)).collect()
    links = brute.cosine_links(vectors)
    assert len(links) > 1_000_000
    check_vectors(rows, links, vectors, 0.99)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0, 3.0], [-1.0, -2.0]]
    good = [[1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [1e-30, 2e-30]]
    data = list(enumerate(odd + good)) + [(None, [0.0, 5.0]), (8, [1.0, 2.0])]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumn(
        "node", F.lit("x")
    )
    rows = embeddings.near_duplicates(frame).collect()
    assert len(rows) == len(data)
    alone = [r for r in rows if r["vec_id"] is not None and r["vec_id"] < 8]
    assert all((r["n_links"], r["component_id"]) == (0, r["vec_id"]) for r in alone)
    together = [r for r in rows if r["vec_id"] is not None and r["vec_id"] >= 8]
    assert {(r["n_links"], r["component_id"]) for r in together} == {(4, 8)}
    assert [r["n_links"] for r in rows if r["vec_id"] is None] == [0]
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


# --- chat ----------------------------------------------------------------------------------------

MESSAGES = "conv bigint, msg bigint, parent bigint, role string, text string, score double"


def test_branches_are_ranked_and_whole(spark):
    rows = [
        (1, 10, None, "user", "q", 0.0),
        (1, 11, 10, "assistant", "good <|im_end|>", 5.0),
        (1, 12, 10, "assistant", "bad", 1.0),
        (1, 13, 12, "user", "why", 0.0),
        (1, 14, 13, "assistant", None, None),
        (2, 10, 99, "a b\nc", "<|im_start|>", 0.0),
        (3, 1, 2, "user", "circle", 0.0),
        (3, 2, 1, "user", "circle", 0.0),
        (3, 3, 2, "user", "hangs off the circle", 0.0),
        (3, 9, None, "user", "apart", 0.0),
        (None, 1, None, "user", "no conversation", 0.0),
    ]
    made = chat.conversations(spark.createDataFrame(rows, MESSAGES))
    made = made.withColumn("turns", chat.turns(F.col("formatted"))).withColumn(
        "learnt", chat.loss_text(F.col("formatted"), F.col("loss"))
    )
    got = {(r["conv"], r["branch"]): r for r in made.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1), (None, 1)}
    assert [tuple(t) for t in got[1, 1]["turns"]] == [
        ("user", "q"),
        ("assistant", "good <|im_end|>"),
    ]
    assert [t["text"] for t in got[1, 2]["turns"]] == ["q", "bad", "why", ""]
    assert got[1, 2]["learnt"] == "bad"
    assert [tuple(t) for t in got[2, 1]["turns"]] == [("a b\nc", "<|im_start|>")]
    assert got[3, 1]["leaf"] == 9
    best = chat.conversations(spark.createDataFrame(rows, MESSAGES), branches=1)
    assert {(r["conv"], r["leaf"]) for r in best.collect()} == {(1, 11), (2, 10), (3, 9), (None, 1)}


def test_deep_thread(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(500)]
    (row,) = chat.conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    assert row["formatted"] == "".join(f"<|im_start|>user\n{i}<|im_end|>\n" for i in range(500))


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|x<|", "a<", "<|im_end|>\n", "\\", "$1 <|$2"])
def test_escapes_can_be_undone(spark, text):
    one = spark.createDataFrame([(text,)], "t string")
    escaped = one.select(chat.escaped(F.col("t")).alias("t"))
    assert "<|" not in escaped.first()[0]
    assert escaped.select(chat.unescaped(F.col("t"))).first()[0] == text


def test_chat_matches_sql(spark):
    from ledgerlens.llm.oracle import oracle_sql

    made = queries.op6_chat(spark, SF_DIR)
    assert differences(made, connect(SF_DIR), oracle_sql()["op6_chat"]) is None
    assert "Python" not in made._jdf.queryExecution().toString()


def test_no_messages(spark):
    assert chat.conversations(spark.createDataFrame([], MESSAGES)).collect() == []


def test_circles_cost_no_more_than_their_messages(spark):
    """Many plain messages and some circles with a reply: no path goes round, whatever the table."""
    plain = [(c, m, m - 1 if m % 40 else None) for c in range(100) for m in range(200)]
    circles = [(c, m, p) for c in range(1000, 1050) for m, p in ((1, 2), (2, 1), (3, 2))]
    frame = spark.createDataFrame(plain + circles, "conv bigint, msg bigint, parent bigint")
    paths = chat.root_to_leaf_paths(frame)
    assert paths.inputFiles()  # a written table and nothing on top of it
    rows = paths.collect()
    assert len(rows) == len(plain) and all(r["conv"] < 1000 for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_rooted_messages_against_walking_up(spark, seed):
    rng = random.Random(seed)
    parents = {m: rng.choice([None, 77, *range(60)]) for m in range(60)}
    rows = [(None if seed == 2 else 5, m, p) for m, p in parents.items()]
    frame = spark.createDataFrame(rows, "conv bigint, msg bigint, parent bigint")
    want = set()
    for m in parents:
        at, seen = m, set()
        while at is not None and at in parents and at not in seen:
            seen.add(at)
            at = parents[at]
        if at is None or at not in parents:
            want.add(m)
    paths = chat.root_to_leaf_paths(frame).collect()
    leaves = want - {p for m, p in parents.items() if m in want}
    assert {r["leaf"] for r in paths} == leaves
    assert {r["msg"] for r in paths} <= want


# --- decontamination -----------------------------------------------------------------------------


def test_decontamination_against_all_alignments(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [prose(rng.randint(4, 40)) for _ in range(12)] + [["only"], []]
    texts = []
    for i in range(60):
        part = list(items[i % len(items)])
        for at in rng.sample(range(len(part)), len(part) // 5 if i % 2 else len(part) // 3):
            part[at] = "other"
        cut = part[: rng.choice([8, 13, 20, 40])]
        texts.append(" ".join([*prose(rng.randint(0, 30)), *cut, *prose(rng.randint(0, 30))]))
    texts += ["", None, "ONLY, she said"]
    docs = as_documents(spark, texts)
    tests = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(items)] + [(None, "w1 w2"), (99, None)],
        "item_id bigint, text string",
    )
    want = {
        (d, i)
        for d, t in enumerate(texts)
        for i, item in enumerate(items)
        if brute.contained(t, " ".join(item))
    }
    for block_bytes in (1 << 20, 400):
        found = decontaminate.contained_items(docs, tests, block_bytes=block_bytes)
        pairs = {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["items"]}
        assert pairs <= want
        sure = {(d, i) for d, i in want if brute.contained(texts[d], " ".join(items[i]), 13, 0.8)}
        assert sure <= pairs
        assert (62, 12) in pairs
    kept = {r["doc_id"] for r in decontaminate.without_contaminated(docs, tests).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in pairs}


@pytest.mark.parametrize("size", range(1, 25))
def test_masks_stand_a_fifth_of_the_words_substituted(size):
    windows = [
        {start + p for p in positions}
        for positions in decontaminate._masks_for(size)
        for start in range(size - positions[-1])
    ]
    for places in itertools.combinations(range(size), size // 5):
        assert any(window.isdisjoint(places) for window in windows)


def test_registered_decontamination(spark, documents):
    tests = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()
    rows = queries.op7_decontaminate(spark, SF_DIR).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    plain = {
        (d["doc_id"], t["item_id"])
        for d in documents.collect()
        for t in tests
        if " ".join(decontaminate.words_of(t["text"])) in " ".join(decontaminate.words_of(d["text"]))
    }
    assert plain and plain == found


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_rows_that_repeat_an_id_are_judged_each_for_itself(spark, block_bytes):
    tests = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(6)]
    both = f"{tests[0][1]} and {tests[1][1]}"
    rows = [(1, both), (1, both), (1, tests[2][1]), (1, None), (None, tests[3][1]), (None, "x")]
    found = decontaminate.contained_items(
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(tests, "item_id bigint, text string"),
        block_bytes=block_bytes,
    )
    got = collections.Counter(
        (r["doc_id"], tuple(i["item_id"] for i in r["items"])) for r in found.collect()
    )
    assert got == {(1, (0, 1)): 2, (1, (2,)): 1, (1, ()): 1, (None, (3,)): 1, (None, ()): 1}


def test_decontamination_odd_rows(spark, odd_documents, no_documents):
    tests = spark.createDataFrame([(1, "lorem ipsum dolor sit")], "item_id bigint, text string")
    rows = decontaminate.contained_items(odd_documents, tests).collect()
    assert len(rows) == 13
    assert {r["doc_id"] for r in rows if r["items"]} == {5, 6}
    left = decontaminate.without_contaminated(odd_documents, tests)
    assert left.columns == odd_documents.columns and left.count() == 11
    assert decontaminate.contained_items(odd_documents, tests.limit(0)).count() == 13
    assert decontaminate.without_contaminated(odd_documents, tests.limit(0)).count() == 13
    assert decontaminate.contained_items(no_documents, tests).collect() == []


def test_decontamination_by_joined_hashes_equals_one_block(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    items = [(f"k{i}", " ".join(rng.choices(words, k=rng.choice([2, 6, 20, 60])))) for i in range(80)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    for i, (_, item) in enumerate(items[:60]):
        own = item.split()
        for at in rng.sample(range(len(own)), len(own) // 6):
            own[at] = "changed"
        texts[i] += " " + " ".join(own) + " " + texts[-i]
    # A third of all rows is one text; ids are null or repeated.
    rows = [(i % 50 or None, t, i) for i, t in enumerate(texts + [texts[3]] * 40 + [None, "", " "])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items int").repartition(4)
    tests = spark.createDataFrame(items + [(None, texts[0]), ("x", None)], "name string, body string")
    names = {"item_col": "name", "item_text_col": "body"}
    for options in ({}, {"least_words": 6}, {"min_words": 9, "min_share": 0.9}):
        options |= names
        found, left = [], []
        for block_bytes in (1 << 20, 1500):
            sized = options | {"block_bytes": block_bytes}
            rows = decontaminate.contained_items(docs, tests, **sized).collect()
            found.append(sorted((r["doc_id"] or 0, str(r["items"])) for r in rows))
            kept = decontaminate.without_contaminated(docs, tests, **sized)
            assert kept.columns == docs.columns
            left.append(sorted(r["items"] for r in kept.collect()))
        assert found[0] == found[1] and left[0] == left[1]
        assert len(left[0]) == sum(items == "[]" for _, items in found[0]) < len(found[0]) == 103


def test_no_block_is_broadcast_when_hashes_are_joined(spark, monkeypatch):
    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(
        type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or broadcast(self, x)
    )
    tests = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i}") for i in range(60)], "item_id int, text string")
    docs = as_documents(spark, ["and a7 b7 c7 d7", "b7 a7 d7 c7", None])
    left = decontaminate.without_contaminated(docs, tests, block_bytes=100)
    assert {r["doc_id"] for r in left.collect()} == {1, 2}
    assert [(type(x), x.nbytes) for x in sent] == [(np.ndarray, 4096)]


def test_items_of_one_stem_are_verified_together():
    stem = "which of the following is the best answer here".split()
    items = [(i, " ".join([*stem, *(f"u{i}x{j}" for j in range(10))])) for i in range(50_000)]
    block = decontaminate.TestBlock(items, 13, 0.8)
    hot = " ".join(["before", *stem, "something", "else", "follows", "after", "it"])
    planted = f"{hot} {items[777][1]} and more"
    begun = time.perf_counter()
    found = block.find([hot] * 10 + [planted])
    assert time.perf_counter() - begun < 30
    assert found[:10] == [[]] * 10 and [x[0] for x in found[10]] == [777]
    # Twelve words are one too few, thirteen are enough.
    assert block.find([" ".join([*stem, "u5x0", "u5x1", "u5x2"])]) == [[]]
    assert block.find([" ".join([*stem, "u5x0", "u5x1", "u5x2", "u5x3"])]) == [[(5, 13, 13, 0)]]
    begun = time.perf_counter()
    assert block.find([planted] * 10, True)[9][0][0] == 777
    assert time.perf_counter() - begun < 30


def test_items_of_few_words_are_left_out_if_asked(spark):
    tests = spark.createDataFrame([(1, "the"), (2, "a b c d")], "item_id bigint, text string")
    docs = as_documents(spark, ["the end", "x a b c d", "none"])
    for least, kept in ((1, {2}), (4, {0, 2}), (5, {0, 1, 2})):
        left = decontaminate.without_contaminated(docs, tests, least_words=least)
        assert {r["doc_id"] for r in left.collect()} == kept


# --- resharding ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(20))
def test_flow_moves_no_byte_too_many(seed):
    rng = random.Random(seed)
    sizes = {i: rng.randrange(1000) for i in range(rng.randint(1, 9))}
    room = resharding.capacities(
        sum(sizes.values()), {j: rng.random() + 0.01 for j in range(rng.randint(1, 9))}
    )
    moves = resharding.cheapest_transfers(sizes, room)
    for side, want in ((0, sizes), (1, room)):
        got = collections.Counter()
        for m in moves:
            got[m[side]] += m.size
        assert all(got[k] == n for k, n in want.items())
    stays = sum(min(n, room.get(i, 0)) for i, n in sizes.items())
    assert sum(m.size for m in moves if m.old != m.new) == sum(sizes.values()) - stays


def test_flow_with_other_costs_is_cheapest():
    sizes, room = {0: 3, 1: 2}, {0: 1, 1: 1, 2: 3}
    costs = {(0, 0): 2, (0, 1): 3, (0, 2): 1, (1, 0): 1, (1, 1): 4, (1, 2): 5}
    moves = resharding.cheapest_transfers(sizes, room, lambda a, b: costs[a, b])
    units = [0, 0, 0, 1, 1]
    least = min(
        sum(costs[a, b] for a, b in zip(units, order))
        for order in itertools.permutations([0, 1, 2, 2, 2])
    )
    assert sum(costs[m.old, m.new] * m.size for m in moves) == least


@pytest.mark.parametrize("seed", range(30))
def test_flow_with_any_costs_is_cheapest(seed):
    rng = random.Random(seed)
    sizes = {i: rng.randint(0, 3) for i in range(3)}
    room = dict.fromkeys(range(3), 0)
    for _ in range(sum(sizes.values())):
        room[rng.randrange(3)] += 1
    costs = {(a, b): rng.randint(0, 4) for a in sizes for b in room}
    moves = resharding.cheapest_transfers(sizes, room, lambda a, b: costs[a, b])
    units = [a for a, n in sizes.items() for _ in range(n)]
    places = [b for b, n in room.items() for _ in range(n)]
    least = min(
        sum(costs[a, b] for a, b in zip(units, order))
        for order in set(itertools.permutations(places))
    )
    assert sum(costs[m.old, m.new] * m.size for m in moves) == least
    for side, want in ((0, sizes), (1, room)):
        got = collections.Counter()
        for m in moves:
            got[m[side]] += m.size
        assert all(got[k] == n for k, n in want.items())


def test_flow_between_thousands_of_shards():
    rng = random.Random(1)
    sizes = {i: rng.randint(0, 10**9) for i in range(5000)}
    room = resharding.capacities(sum(sizes.values()), {j: rng.random() for j in range(6000)})
    started = time.process_time()
    moves = resharding.cheapest_transfers(sizes, room)
    assert time.process_time() - started < 10
    stays = sum(min(n, room[i]) for i, n in sizes.items())
    assert sum(m.size for m in moves if m.old != m.new) == sum(sizes.values()) - stays
    assert len(moves) < 3 * 11_000


def check_shards(rows, shards):
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert set(by_shard) <= set(shards)
    return {s: sum(r["size"] for r in by_shard.get(s, [])) for s in shards}


def test_registered_resharding(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_reshard(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows[:300]:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 16
    sizes = check_shards(rows, range(40))
    mean = sum(sizes.values()) / 40
    assert max(sizes.values()) <= 1.03 * mean and min(sizes.values()) >= 0.97 * mean


def test_only_affected_shards_are_rewritten(spark):
    docs = as_documents(spark, ["x" * (100 + i % 7) for i in range(600)])
    old = F.col("doc_id").cast("int") % 3
    weights = {0: 200 * 119.0, 1: 100 * 119.0, 2: 200 * 119.0, 3: 100 * 119.0}
    exact = docs.groupBy(old.alias("s")).agg(F.sum(resharding.document_size(F.col("text")))).collect()
    for s, n in exact:
        weights[s] = n if s != 1 else n / 2
    weights[3] = weights[1]
    path = scratch_path(spark, "test-shards")
    back, layout = resharding.reshard(docs, old, weights, path)
    assert layout.untouched() == {0, 2}
    files = spark.read.parquet(path).select("shard").distinct().collect()
    assert {r[0] for r in files} == {1, 3}
    rows = back.collect()
    check_shards(rows, range(4))
    assert {r["doc_id"] for r in rows} == set(range(600))
    assert all(r["shard"] == r["doc_id"] % 3 or r["doc_id"] % 3 == 1 for r in rows)


def test_resharding_odd_rows(spark, odd_documents, no_documents):
    old = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    back, _ = resharding.reshard(odd_documents, old, range(4), scratch_path(spark, "odd"))
    assert back.columns == [*odd_documents.columns, "shard_", "slot_", "size_"]
    rows = [{"shard": r["shard_"], "slot": r["slot_"], "size": r["size_"]} for r in back.collect()]
    assert len(rows) == 13
    check_shards(rows, range(4))
    empty, _ = resharding.reshard(no_documents, F.lit(0), range(4), scratch_path(spark, "none"))
    assert empty.collect() == []


# --- SimHash -------------------------------------------------------------------------------------


def test_fingerprints(odd_documents, documents):
    for docs in (odd_documents, documents.limit(60)):
        texts = sorted((str(r["doc_id"]), r["text"]) for r in docs.collect() if r["doc_id"])
        got = sorted((str(r["doc_id"]), r["fp"]) for r in simhash.fingerprints(docs).collect() if r["doc_id"])
        for (_, text), (_, fp) in zip(texts, got):
            if len(text or "") < 50_000:
                assert fp % (1 << 64) == brute.fingerprint(text)


def test_hash_is_that_of_spark(spark):
    got = spark.sql("select xxhash64('the quick fox')").first()[0] % (1 << 64)
    assert got == simhash.xxhash.xxh64_intdigest(b"the quick fox", 42)


@pytest.mark.parametrize("block, bits", [(512, 3), (4, 3), (512, 1), (512, 5)])
def test_near_links_lose_no_component(spark, block, bits):
    rng = random.Random(block + bits)
    prints = set()
    for centre in [rng.getrandbits(64) for _ in range(25)] + [0, (1 << 64) - 1]:
        prints.add(centre)
        for _ in range(20):
            near = centre
            for _ in range(rng.randint(1, bits + 3)):
                near ^= 1 << rng.randrange(64)
            prints.add(near)
    signed = [(p - (1 << 64) if p >> 63 else p) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = [tuple(r) for r in simhash.near_links(frame, bits, block).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= bits for a, b in links)
    got = brute.Groups(signed)
    for a, b in links:
        got.join(a, b)
    assert got.smallest() == brute.near_prints({p: p % (1 << 64) for p in signed}, bits)


def test_registered_simhash(spark, documents):
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in documents.collect()}
    want = brute.near_prints(prints)
    rows = queries.op9_simhash(spark, SF_DIR).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}


def test_simhash_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    ids = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 13
    assert ids[1] == ids[7] == 1 and ids[5] == ids[6] == 5 and ids[2] == ids[3] == ids[4] == 2
    left = simhash.one_of_each(odd_documents)
    assert left.columns == odd_documents.columns
    kept = [r["doc_id"] for r in left.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, 2, None, 5, 8, 9, 10]))
    assert simhash.near_duplicates(no_documents).collect() == []
    assert simhash.one_of_each(no_documents).collect() == []


def test_one_of_each_judges_rows(spark):
    words = random.Random(2)
    texts = [" ".join(f"{words.getrandbits(40):x}" for _ in range(60)) for _ in range(41)]
    rows = [(i % 20, texts[i], "en", "s", 0) for i in range(40)]
    rows += [(None, texts[40], "en", "s", 0)] * 10 + [(3, texts[3], "de", "t", 1)]
    left = simhash.one_of_each(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == sorted(
        (str(d), t) for d, t in {(r[0], r[1]) for r in rows}
    )


# --- lines ---------------------------------------------------------------------------------------


def test_lines_match_sql(spark):
    from ledgerlens.llm.oracle import oracle_sql

    for sf in (SF_DIR, "/root/testdata/sf0.01"):
        made = queries.op10_lines(spark, sf)
        assert differences(made, connect(sf), oracle_sql()["op10_lines"]) is None
        assert "Python" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("share, least", [(0.05, 2), (0.6, 3), (0.0, 7)])
def test_lines_against_brute_force(spark, share, least):
    rng = random.Random(least)
    common = [f"  common line number {i} of the site" for i in range(30)]
    rows = []
    for i in range(400):
        own = [f"own text {i} part {j} and some words more" for j in range(rng.randint(0, 8))]
        own += rng.sample(common[: 1 + i % 30], min(1 + i % 30, rng.randint(0, 4)))
        rng.shuffle(own)
        rows.append(("\n".join(own), None if i % 50 == 0 else f"site{rng.randrange(60)}"))
    rows += [("a page that stands on very many sites\n" + common[0], f"site{i}") for i in range(60)]
    docs = as_documents(spark, [t for t, _ in rows], [s for _, s in rows])
    got = lines.remove_boilerplate(docs, share, least, 10).orderBy("doc_id").collect()
    want = brute.clean_lines(rows, share, least, 10)
    assert [r["text"] for r in got] == want
    assert want[:400] != [t for t, _ in rows[:400]] and want[400:] == [t for t, _ in rows[400:]]


def test_lines_odd_rows(spark, odd_documents, no_documents):
    got = lines.remove_boilerplate(odd_documents, 0.1, 2, 5, removed_col="gone")
    assert got.columns == [*odd_documents.columns, "gone"]
    rows = got.collect()
    assert len(rows) == 13 and sum(r["gone"] for r in rows) == 0  # whole copies stay
    assert {(r["doc_id"], r["text"]) for r in rows} == {
        (r["doc_id"], r["text"]) for r in odd_documents.collect()
    }
    assert lines.remove_boilerplate(no_documents).collect() == []


def test_mixed_pages_lose_their_boilerplate_whatever_its_share(spark):
    """Also under null and repeated ids, and where boilerplate is nearly all of the page."""
    line = "a very long line of boilerplate that stands on every page of the corpus"
    rows = [(None if i % 2 else 7, f"{line}\nown {i}\n{line}", "en", f"s{i % 9}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(4)
    got = lines.remove_boilerplate(docs, removed_col="gone").collect()
    assert sorted(r["text"] for r in got) == sorted(f"own {i}" for i in range(40))
    assert {r["gone"] for r in got} == {2}


def test_copies_are_left_whole(spark):
    text = "one line that is everywhere\nand a second one like it"
    docs = as_documents(spark, [text] * 30, [f"s{i}" for i in range(30)])
    assert {r["text"] for r in lines.remove_boilerplate(docs).collect()} == {text}


def test_the_threshold_follows_the_sites(spark):
    for sites, want in ((0, 3), (9, 3), (20, 4), (21, 5), (50, 10)):
        docs = as_documents(spark, ["x"] * (sites + 1), [f"s{i}" for i in range(sites)] + [None])
        assert lines.sites_needed(docs, 0.2, 3) == want
