"""Ranked search, structure repair and nearest neighbours against plain versions."""

import functools
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import neighbours, oracle, queries, ranked_search, repair
from tests.check import connect, differences
from tests.conftest import SF_DIR

TURNS = "conv_id bigint, turn bigint, role string, text string"


# --- ranked search -------------------------------------------------------------------------------


def plain_search(docs, items, k=20):
    """(item row, rank, doc row, score) by scoring every document."""
    split = functools.partial(re.findall, oracle.TERM)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    texts = {i: split((t or "").translate(lower)) for i, (_, t) in enumerate(docs)}
    texts = {i: terms for i, terms in texts.items() if terms}
    count, length = len(texts), sum(map(len, texts.values()))
    out = []
    for at, (_, text) in enumerate(items):
        scores = {}
        for term in split((text or "").translate(lower)):
            df = sum(term in terms for terms in texts.values())
            weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))
            for i, terms in texts.items():
                if tf := terms.count(term):
                    m = 75 + 25 * len(terms) * count // length
                    add = weight * (10**9 * tf // (1000 * tf + 12 * m))
                    scores[i] = scores.get(i, 0) + add
        best = sorted(
            (-s, docs[i][0] is None, docs[i][0] or 0, i) for i, s in scores.items() if s > 0
        )
        out += [(items[at][0], r + 1, docs[b[3]][0], -b[0]) for r, b in enumerate(best[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, k=20, **sizes):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id bigint, text string")
    rows = ranked_search.search(docs, items, k, **sizes).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_postings": 100, "block_queries": 3}])
def test_search_against_scoring_everything(spark, sizes):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["ÄÖ", "naïve", "x1"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(low, high):
        return " ".join(rng.choices(words, weights, k=rng.randint(low, high)))

    docs = [(i // 2 * 3 % 101, text(0, 30)) for i in range(150)]
    docs += [(7, docs[3][1]), (None, docs[3][1]), (500, None), (501, ""), (502, " ,.; ")]
    items = [(i, text(1, 12)) for i in range(9)] + [(None, "W1 w2"), (20, None), (21, "absent")]
    assert searched(spark, docs, items, 5, **sizes) == plain_search(docs, items, 5)


def test_search_stops_creating_accumulators_only_when_it_may():
    rng = np.random.default_rng(2)
    for _ in range(200):
        size, k = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        lists = []
        for _ in range(int(rng.integers(0, 7))):
            at = np.flatnonzero(rng.random(size) < rng.random())
            lists.append((len(at), at, rng.integers(0, 6, len(at)) * int(rng.integers(1, 50))))
        sums = np.zeros(size, np.int64)
        for _, at, scores in lists:
            sums[at] += scores
        want = [i for i in np.lexsort((np.arange(size), -sums)) if sums[i] > 0][:k]
        best, scores = ranked_search.top_documents(size, lists, k)
        assert best.tolist() == want and scores.tolist() == sums[want].tolist()


def test_search_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in random.Random(1).sample(range(400), 300)]
    docs += [(9000 + i, "other text") for i in range(50)]
    got = searched(spark, docs, [(1, "words")], 20, block_postings=32)
    ids = sorted(i for i, t in docs if t != "other text")[:20]
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ids


def test_search_on_odd_tables(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "lorem plain"), (None, None)], "item_id bigint, text string")
    assert ranked_search.search(no_documents, items).collect() == []
    assert ranked_search.search(odd_documents, items.limit(0)).collect() == []
    rows = ranked_search.search(odd_documents, items).collect()
    assert {r["doc_id"] for r in rows} == {1, 5, 6, 7} and len(rows) == 5


def test_search_matches_its_sql(spark):
    sql = oracle.oracle_sql()["op11_search"]
    found = queries.op11_search(spark, SF_DIR)
    assert differences(found, connect(SF_DIR), sql) is None


# --- structure repair ----------------------------------------------------------------------------


def exhaustive_repair(shape):
    """(cost, audit) by cheapest-first search over (rows used, roles made), without any bound."""
    import heapq

    form = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, made = heapq.heappop(heap)
        if at == len(shape) and form.fullmatch(made):
            # Audits of equal cost leave the heap in ASCII order only if none is still growing.
            rest = [x for x in heap if x[0] == cost]
            return min([(cost, audit), *_finished(rest, shape, form, cost)])
        if (cost, audit, at, made) in done:
            continue
        done.add((cost, audit, at, made))
        for node in _steps(cost, audit, at, made, shape, form):
            heapq.heappush(heap, node)


def _steps(cost, audit, at, made, shape, form):
    def ok(text):
        return any(form.fullmatch(text + tail) for tail in ("", "a", "ua"))

    if at < len(shape):
        initial, fault = shape[at]
        yield cost + 4, audit + "D", at + 1, made
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            if ok(made + initial):
                yield cost + more, audit + "K", at + 1, made + initial
            for i in "ua":
                if ok(made + i):
                    yield cost + 3 + more, audit + "R", at + 1, made + i
    for i in "ua":
        if ok(made + i):
            yield cost + 3, audit + "I", at, made + i


def _finished(nodes, shape, form, limit):
    """All (cost, audit) that the nodes reach without further cost."""
    nodes = list(nodes)
    while nodes:
        cost, audit, at, made = nodes.pop()
        if at == len(shape) and form.fullmatch(made):
            yield cost, audit
        nodes += [n for n in _steps(cost, audit, at, made, shape, form) if n[0] <= limit]


def test_search_for_edits_against_cheapest_first():
    rng = random.Random(3)
    faults = ["", "", "", "", "truncated", "blank", "duplicate"]
    shapes = [tuple(zip("sua?", [""] * 4))[:n] for n in range(5)]
    shapes += [
        tuple((rng.choice("suuaa?"), rng.choice(faults)) for _ in range(rng.randint(0, 7)))
        for _ in range(250)
    ]
    for shape in shapes:
        assert repair.search(shape, 0, repair.ENDS) == exhaustive_repair(shape), shape


def test_bounds_never_exceed_the_cost():
    rng = random.Random(4)
    for _ in range(100):
        shape = tuple((rng.choice("sua"), rng.choice(["", "truncated", "blank"])) for _ in range(9))
        bounds = repair.suffix_bounds(shape, repair.ENDS)
        for at in range(len(shape) + 1):
            for state in range(4):
                found = repair.search(shape[at:], state, repair.ENDS)
                assert bounds[at][state] <= found[0]


def test_long_conversations_are_searched_in_seconds():
    rng = random.Random(6)
    shape = tuple((rng.choice("suuaa?"), rng.choice(["", "", "truncated"])) for _ in range(5000))
    start = time.time()
    repair.search(shape, 0, repair.ENDS)
    assert time.time() - start < 5


def plain_conversation(rows):
    """The contract's columns for rows (turn, role, text) of one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, shape = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = (
            "blank" if not bare
            else "duplicate" if (role, text) in seen
            else "truncated" if bare[-1] not in ".!?"
            else ""
        )
        seen.add((role, text))
        shape.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = exhaustive_repair(tuple(shape))
    made, at = [], 0
    for letter in audit:
        following = "ua"[len([r for r in made if r[0][:1] != "s"]) % 2]
        name = {"u": "user", "a": "assistant"}[following]
        if letter == "I":
            made.append((name, ""))
            continue
        if letter != "D":
            made.append((rows[at][1] if letter == "K" else name, rows[at][2]))
        at += 1
    kinds = [f for _, f in shape]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    )


def repaired(spark, rows):
    frame = spark.createDataFrame(rows, TURNS).repartition(4)
    plan, made = repair.repair(frame)
    digests = {r["conv"]: r["repaired_sha256"] for r in repair.digests(made).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {
        r["conv"]: (
            *(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")),
            digests.get(r["conv"], empty),
        )
        for r in plan.collect()
    }


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


@pytest.mark.parametrize("piece", [1024, 4])
def test_repair_against_plain(spark, monkeypatch, piece):
    """In pieces of four rows most conversations are cut and joined again."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(8)
    texts = ["Fine.", "Fine.", "Well!", "cut off", " ", "", "So?  \n", " ", None, "né"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    rows = [
        (c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
        for c in range(40)
        for _ in range(rng.randint(1, 9))
    ]
    want = {c: plain_conversation(r) for c, r in by_conversation(rows).items()}
    got = repaired(spark, rows)
    for conv in want:
        assert got[conv] == want[conv], (conv, by_conversation(rows)[conv])
    assert set(got) == set(want)


def test_one_conversation_of_many_rows_is_cut(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"Text {i % 700}.") for i in range(6000)]
    rows += [(c, 0, "user", "Hi.") for c in range(2, 50)]
    placed = repair.numbered(spark.createDataFrame(rows, TURNS).repartition(5), *TURNS.split()[::2])
    flagged = repair._flagged(placed)
    sizes = flagged.groupBy("conv", "piece").count().agg(F.max("count")).first()[0]
    assert sizes <= repair.PIECE
    plan = {r["conv"]: r for r in repair.plans(placed).collect()}
    said = [(role, text) for conv, _, role, text in rows if conv == 1]
    first = {row: i for i, row in reversed(list(enumerate(said)))}
    shape = [(r[0], "" if first[r, t] == i else "duplicate") for i, (r, t) in enumerate(said)]
    assert (plan[1]["cost"], plan[1]["audit"]) == repair.search(tuple(shape), 0, repair.ENDS)
    assert plan[2]["cost"] == 3 and plan[2]["audit"] == "KI"


def test_repair_of_nothing_and_of_extra_columns(spark):
    empty = spark.createDataFrame([], TURNS + ", piece int, pos int")
    plan, rows = repair.repair(empty)
    assert plan.collect() == [] and rows.collect() == []
    clash = spark.createDataFrame(
        [(1, 0, "user", "Hi.", 3, 4), (1, 0, "user", "Hi.", 3, 4)], TURNS + ", piece int, pos int"
    )
    plan, rows = repair.repair(clash)
    assert [r["audit"] for r in plan.collect()] == ["KDI"]
    assert sorted((r["role"], r["text"]) for r in rows.collect()) == [("assistant", ""), ("user", "Hi.")]


def test_registered_repair_against_plain(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    damaged = {r["conv_id"]: [] for r in rows}
    for r in rows:
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"] or " ", " " if r["text"] is None else r["text"]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (r["turn"], "user" if kind == 4 else role, text)
        damaged[r["conv_id"]] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: plain_conversation(r) for c, r in damaged.items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_repair(spark, SF_DIR).collect()}
    assert got == want
    assert len(want) > 5 and sum("I" in w[6] for w in want.values())


# --- nearest neighbours --------------------------------------------------------------------------


def plain_nearest(vectors, asked, k):
    """{query row: [(id, distance)]}, by all distances."""
    points = np.array([v for _, v in vectors], float)
    out = {}
    for i in asked:
        far = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        order = sorted((far[j], vectors[j][0], j) for j in range(len(vectors)) if j != i)
        out[i] = [(key, d) for d, key, _ in order[:k]]
    return out


def recall(got, want):
    hits = sum(len({k for k, _ in got.get(q, [])} & {k for k, _ in near}) for q, near in want.items())
    return hits / sum(len(near) for near in want.values())


def found(spark, vectors, k=10, **more):
    frame = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").repartition(3)
    rows = neighbours.nearest(frame, F.col("vec_id") % 100 == 0, k, **more).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "one cluster"])
@pytest.mark.parametrize("block", [neighbours.BLOCK, 500])
def test_recall(spark, kind, block):
    rng = np.random.default_rng(9)
    size = 3 if kind == "line" else 32
    points = rng.normal(size=(3000, size))
    if kind == "clusters":
        points = np.repeat(rng.normal(size=(60, size)), 50, axis=0) + 0.05 * points
    elif kind == "one cluster":
        points = np.concatenate([5 + 1e-3 * points[:1000], points[1000:]])
    elif kind == "line":
        points[:, 1:] = 0
    vectors = [(i, p.tolist()) for i, p in enumerate(points)]
    want = plain_nearest(vectors, range(0, 3000, 100), 10)
    got = found(spark, vectors, block_rows=block)
    assert recall(got, want) >= 0.9
    for query, near in got.items():
        exact = [math.dist(vectors[query][1], vectors[key][1]) for key, _ in near]
        assert [d for _, d in near] == pytest.approx(exact, rel=1e-12)
        assert near == sorted(near, key=lambda x: (x[1], x[0]))


def test_recall_on_the_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [(r["vec_id"], list(r["embedding"])) for r in rows]
    asked = [i for i, (key, _) in enumerate(vectors) if key % 100 == 0]
    want = {vectors[i][0]: n for i, n in plain_nearest(vectors, asked, 10).items()}
    got = {}
    for r in queries.op13_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert recall(got, want) >= 0.9


def test_ties_repeats_and_odd_vectors(spark):
    same = [1.0, 2.0]
    vectors = [(i, same) for i in (100, 7, 3, 9, 5)] + [(100, same), (None, same)]
    vectors += [(200, None), (300, [0.0, 0.0]), (1, [None, 1.0]), (2, [math.nan, 1.0])]
    vectors += [(4, [math.inf, 1.0]), (400, [1.0, 2.0, 3.0]), (6, []), (500, [1e200, -1e200])]
    rows = neighbours.nearest(
        spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"),
        F.col("vec_id") % 100 == 0,
        3,
    ).collect()
    ids = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == 100)
    assert ids == [(1, 3), (1, 3), (2, 5), (2, 5), (3, 7), (3, 7)]
    assert {r["query_id"] for r in rows} == {100, 500}


def test_fewer_candidates_than_asked_and_none(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0])]) == {0: [(1, 1.0)]}
    assert found(spark, [(0, [1.0, 0.0])]) == {}
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, row int, block int")
    assert neighbours.nearest(empty, F.col("vec_id") % 100 == 0).collect() == []


def test_threshold_is_met_as_promised():
    assert neighbours.threshold(64, 0.97) < 64 * math.erf(neighbours.HALF_WIDTH / math.sqrt(2))
    needed = neighbours.threshold(64, 0.97)
    p = math.erf(neighbours.HALF_WIDTH / math.sqrt(2))
    tail = sum(math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(needed, 65))
    assert tail >= 0.97
