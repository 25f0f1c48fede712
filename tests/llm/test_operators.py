"""Edge cases and brute-force checks of the operators for training text."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.mixing import fill, mix
from quire.llm.neardup import groups, near_copies, pairs_of
from quire.llm.neighbours import graph_search, nearest, neighbour_graph
from quire.llm.packing import pack
from quire.llm.pairs import defective_pairs, is_copy
from quire.llm.scans import Lexicon, Reader, find_noise, lexicon, repair_noise
from quire.llm.splitting import quarters, split_oversized, split_text
from quire.llm.subjects import document_subjects
from quire.llm.tokenizer import token_counts
from quire.llm.topn import top_n

RECORD = "record_table string, record_id string, book_id string, title string, text string"


# 1: scanned text
BODY = "the quick derivative of the function converges toward the limit whenever the interval stays bounded and the sequence remains monotone"


def _noisy():
    clean = [("chunks", f"c{k}", "green-book-000001", "1.2 Long Limits", BODY + ".") for k in range(40)]
    scan = "the quick derivative of the func-\ntion converges toward the limit\nGreen Book\n12 |\nwhenever the intcrval stays bounded\nand the s0quence remains\n1.2 Long Limits   13\nmonotone.\n\nValues:\n12\n40\n7\nend"
    return clean, ("chunks", "s", "green-book-000001", "1.2 Long Limits", scan)


def test_noise_found_and_repaired(spark):
    clean, scan = _noisy()
    odd = [("chunks", "n", None, None, None), ("chunks", None, "b", "t", "x"), ("chunks", "e", "b", None, ""), ("chunks", "long", "b", None, "word " * 200_000), scan]
    df = spark.createDataFrame([*clean, scan, *odd], RECORD).withColumn("kind", F.lit(1)).withColumn("line_no", F.lit("x"))
    got = {(r["record_id"], r["line_no"], r["kind"]) for r in find_noise(df).collect()}
    assert got == {("s", 1, "hyphen"), ("s", 3, "header"), ("s", 4, "page_number"), ("s", 5, "misread"), ("s", 6, "misread"), ("s", 7, "header")}
    assert find_noise(df).count() == len(got)
    text = {r["record_id"]: r["text"] for r in repair_noise(df).collect()}
    assert text["s"] == BODY + ".\n\nValues:\n12\n40\n7\nend"
    assert text["c0"] == BODY + "." and text["e"] == ""


def test_misreads_do_not_depend_on_the_size_of_the_corpus(spark):
    text = "않는다 determinant " * 2000 + "않논다 determmant " * 15 + "word " * 4000
    for times in (1, 20, 200):
        df = spark.range(times).select(F.lit(text).alias("text"))
        share = 4 / len(text.split())
        reader = Reader(Lexicon(lexicon(df, share), share))
        assert [w for w in ("않논다", "determmant", "않는다", "determinant", "word") if reader.misread(w)] == ["않논다", "determmant"], times


def test_noise_empty(spark):
    assert find_noise(spark.createDataFrame([], RECORD)).count() == 0
    assert repair_noise(spark.createDataFrame([], RECORD)).count() == 0


# 2: pairs
CASES = [
    ("Why is the sky blue?", "", "empty"), ("Why is the sky blue?", None, "empty"), ("Why?", " N/A ", "empty"), ("Why?", "<think>hm</think>\n", "empty"), ("Why?", "​", "empty"),
    ("Why?", "I'm sorry, but I can't help with that request.", "refusal"), ("왜 그런가?", "이 요청은 도와드리기 어렵습니다.", "refusal"), ("Warum?", "Dabei kann ich leider nicht helfen.", "refusal"),
    ("Explain how the limit relates to the sequence.", "> Explain how the limit relates to the sequence.", "copy"), ("Explain how the limit relates to the sequence.", "EXPLAIN HOW THE LIMIT RELATES TO THE SEQUENCE.", "copy"),
    ("Why is the limit bounded?", "The limit is bounded since the sequence is monotone. This follows because", "truncated"), ("Why?", "See the code. ```python\nx = 1", "truncated"),
    ("Give a payload.", '{"a": [1, 2', "truncated"), ("Give a sum.", "The sum is $$\\sum_i x_i = \\frac{1}{", "truncated"),
    ("Why is the limit bounded?", "수열이 단조이므로 극한은 유계이다. 따라서 답은 분명하다.", "language"), ("Why is it bounded? Answer in German.", "The sequence is monotone and the limit is bounded by it.", "language"),
    ("Why is the limit bounded?", "The limit is bounded since the sequence is monotone.", None), ("How many?", "42.", None), ("How many are there?", "There are a few of them. So the answer is 42", None),
    ("Explain how the limit relates to the sequence.", "Explain how the limit relates to the sequence.\n\nEvery monotone sequence that is bounded has a limit, and that limit is its supremum.", None),
    ("Give a payload.", '{"a": [1, 2]}', None), ("Why is it bounded? Answer in German.", "Die Folge ist monoton und der Grenzwert ist durch sie bestimmt.", None),
]


def test_many_repeats_are_a_copy():
    question = "Explain how the limit relates to the sequence."
    assert is_copy(question, " ".join([question] * 40))


def test_pairs(spark):
    results = [(k, "r", k, a) for k, (_, a, _) in enumerate(CASES)] + [(0, "r", 0, ""), (None, "r", 0, "x"), (900, "gone", 0, "A whole answer without its task."), (901, "r", 0, "long text. " * 100_000)]
    tasks = [("r", k, q) for k, (q, _, _) in enumerate(CASES)] * 2 + [("r", 777, None)]
    r = spark.createDataFrame(results, "result_id bigint, run_id string, task int, output string").withColumns({"input": F.lit("clash"), "defect": F.lit(1)})
    t = spark.createDataFrame(tasks, "run_id string, task int, input string").withColumn("output", F.lit("clash"))
    got = defective_pairs(r, t).collect()
    assert {(x["result_id"], x["defect"]) for x in got} == {(k, d) for k, (_, _, d) in enumerate(CASES) if d}
    assert len(got) == sum(d is not None for *_, d in CASES)
    assert defective_pairs(r.limit(0), t.limit(0)).count() == 0


# 4: splitting
def tokens(text):
    return max(1, -(-int(quarters(text)[-1]) // 4))


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .,\n가나é", max_size=400), st.integers(1, 40), st.integers(0, 30))
def test_pieces_cover_and_overlap(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    shared = max(0, min(overlap, (limit - 1) // 2))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert tokens(text[a:b]) <= limit
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c <= b < d and (c == b if not shared else tokens(text[c:b]) == shared or c == 0)
    if tokens(text) <= limit:
        assert pieces == [(0, len(text))]


def test_cuts_at_boundaries():
    text = "One short sentence here. " * 40
    for _, b in split_text(text, 60, 0)[:-1]:
        assert text[:b].endswith(". ")
    assert len(split_text("x" * 300_000, 100, 10)) > 700


def test_split_oversized(spark):
    profiles = spark.createDataFrame([("default", 5, 8, 10, 2), ("big", 50, 80, 100, 10)], "name string, min_tokens int, target_tokens int, max_tokens int, overlap_tokens int")
    books = spark.createDataFrame([("b", "big", 1), ("b", "big", 1), ("c", None, 1), ("d", "unknown", 2)], "book_id string, chunk_profile string, added_at int")
    rows = [("t", "1", "b", "w " * 100), ("t", "2", "c", "w " * 100), ("t", "3", "d", "w " * 100), ("t", "4", None, "w " * 100), ("t", "5", "x", "가" * 11), ("t", "6", "c", "가" * 10), ("t", "7", "c", None), ("t", "8", "c", ""), ("t", None, "c", "w " * 99)]
    df = spark.createDataFrame(rows + rows, "record_table string, record_id string, book_id string, text string").withColumns({"limit": F.lit("x"), "tokens": F.lit(1)})
    got = split_oversized(df, books, profiles).collect()
    assert {r["record_id"] for r in got} == {"2", "3", "4", "5"} and all(r["tokens"] <= 10 for r in got)
    assert len({(r["record_id"], r["piece"]) for r in got}) == len(got)
    assert split_oversized(df.limit(0), books.limit(0), profiles).count() == 0


# 5: neighbours
def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16))
    rows = [(f"v{k:04d}", v.tolist()) for k, v in enumerate(np.r_[base, base[:200] + 0.1 * rng.standard_normal((200, 16))])]
    rows += [(f"w{k:04d}", (base[0] * (k + 1)).tolist()) for k in range(300)]
    bad = [("n", None), ("e", []), ("s", [1.0]), ("z", [0.0] * 16), ("nan", [float("nan")] + [1.0] * 15), ("inf", [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "ident string, vector array<double>").withColumns({"node": F.lit("x"), "sim": F.lit(1)})
    members, nodes, edges = neighbour_graph(df, dim=16, part=150)
    found = nearest(members, edges, 5)
    got = {}
    for r in found.collect():
        got.setdefault(r["ident"], {})[r["other"]] = r["similarity"]
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -2)
    hit = total = 0
    for k, i in enumerate(ids):
        true = sorted(range(len(ids)), key=lambda j: (-sims[k, j], ids[j]))[:5]
        hit += sum(ids[j] in got[i] for j in true)
        total += 5
        assert len(got[i]) == 5
    assert set(got) == set(ids) and hit / total >= 0.9
    asked = members.where("ident like 'v00_0'").join(nodes, "node").select(F.col("ident").alias("query"), "vec")
    best = graph_search(asked.select(F.xxhash64("query").alias("query"), "vec"), nodes, edges, k=3)
    assert best.count() == 30 and best.where("place = 1 and sim < 0.999").count() == 0


def test_neighbours_grow_until_recall(spark):
    x = np.random.default_rng(2).standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "ident string, vector array<double>")
    sims = x[::50] @ x.T
    sims[np.arange(len(sims)), np.arange(0, len(x), 50)] = -2
    true = {50 * q: set(np.argsort(-row)[:5].tolist()) for q, row in enumerate(sims)}

    def recall(**how):
        members, _, edges = neighbour_graph(df, dim=32, keep=8, leaf=60, trees=2, **how)
        got = nearest(members, edges, 5).where("cast(ident as int) % 50 = 0").collect()
        return sum(int(r["other"]) in true[int(r["ident"])] for r in got) / (5 * len(true))

    assert recall(rounds=1) < 0.7 and recall(rounds=2, recall=0.95) >= 0.9


def test_rounds_find_what_the_trees_do_not(spark):
    x = np.random.default_rng(4).standard_normal((6000, 24))
    df = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "ident string, vector array<double>")
    log = []
    neighbour_graph(df, dim=24, leaf=100, trees=2, rounds=6, part=2500, log=log)
    assert log[0] < 0.6 and log[-1] >= 0.9 and log == sorted(log)


def test_rounds_in_turns_of_many_parts(spark):
    x = np.random.default_rng(4).standard_normal((3000, 16))
    df = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "ident string, vector array<double>")
    log = []
    neighbour_graph(df, dim=16, keep=16, leaf=60, trees=2, rounds=4, part=200, asked=1500, log=log)
    assert log[0] < 0.8 and log[-1] >= 0.95 and log == sorted(log)


def test_a_part_takes_many_updates_in_little_memory():
    import tracemalloc

    from quire.llm import neighbours as nb

    rng = np.random.default_rng(6)
    n, keep, blocks = 4096, 20, 60
    blank = (np.full((n, keep), nb.NONE), np.zeros((n, keep), np.uint16), np.zeros((n, keep), np.uint8))
    at = np.repeat(np.arange(n, dtype=np.uint32), 15)
    told = [(at, other := rng.integers(0, 3000, 15 * n).astype(np.uint64), (at * 31 + other * 7919).astype(np.uint16)) for _ in range(blocks)]
    state, met = nb._blocks([(0, 0, nb._pack(*blank))]), nb._blocks([(0, k, nb._pack(*x)) for k, x in enumerate(told)])
    tracemalloc.start()
    ((_, _, data),) = nb._improved(0, 13, keep)(0, state, met)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    other, sim, fresh = nb._unpack(data)
    entries = list(zip(*(np.concatenate(x) for x in zip(*told))))
    for node in (0, n - 1):
        best = {int(b): int(s) for a, b, s in entries if a == node}
        assert sim[node].tolist() == sorted(best.values(), reverse=True)[:keep] and fresh[node].all()
        assert [best[int(b)] for b in other[node]] == sim[node].tolist()
    assert peak < 45 * blocks * 15 * n  # bytes of each update; all at once took more than twice as many


def test_search_reaches_every_cluster(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 16)), 40, axis=0) + 0.05 * rng.standard_normal((2400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(str(k), v.tolist()) for k, v in enumerate(x)], "ident string, vector array<double>")
    members, nodes, edges = neighbour_graph(df, dim=16, keep=16)
    asked = members.where("cast(ident as int) % 50 = 0").join(nodes, "node").select(F.col("ident").cast("bigint").alias("query"), "vec")
    got = graph_search(asked, nodes, edges, k=11).join(members, "node").collect()
    hit = sum(int(r["ident"]) in set(np.argsort(-(x @ x[r["query"]]))[:11].tolist()) for r in got)
    assert hit / (11 * 48) >= 0.95
    assert graph_search(asked, nodes.limit(0), edges.limit(0), k=3).count() == 0


def test_neighbours_empty(spark):
    members, _, edges = neighbour_graph(spark.createDataFrame([], "ident string, vector array<double>"), dim=4)
    assert nearest(members, edges, 5).count() == 0
    members, _, edges = neighbour_graph(spark.createDataFrame([("a", [1.0, 0.0])], "ident string, vector array<double>"), dim=2)
    assert members.count() == 1 and nearest(members, edges, 5).count() == 0


# 6: near copies
def jaccard(a, b, size):
    x, y = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (re.findall("[0-9a-z가-힣]+", t.lower()) for t in (a, b)))
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(("size", "threshold", "heavy"), [(3, 0.6, 20_000), (5, 0.8, 20_000), (3, 0.6, 8)])
def test_near_copies_against_brute_force(spark, size, threshold, heavy):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((8, 40, 300, 1200)))]
        for _ in range(rng.randint(1, 5)):
            copy = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0]] * 4 + [texts[1].upper()]
    rows = [(f"t{k:03d}", t) for k, t in enumerate(texts)]
    odd = [("n", None), ("e", ""), ("short", "two words"), (None, texts[0]), rows[0], rows[3]]
    df = spark.createDataFrame(rows + odd, "ident string, text string").withColumns({"node": F.lit("x"), "a": F.lit(1), "key": F.lit(2)})
    members, links = near_copies(df, size=size, threshold=threshold, heavy=heavy)
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(x, y, size) >= threshold - 1e-12}
    assert {tuple(r) for r in pairs_of(members, links).collect()} == want
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[root(a)] = root(b)
    got = {r["ident"]: r["class"] for r in groups(members, links).collect()}
    for a, b in itertools.combinations([i for i, _ in rows if i in got], 2):
        assert (got[a] == got[b]) == (root(a) == root(b))


def test_near_copies_empty(spark):
    members, links = near_copies(spark.createDataFrame([], "ident string, text string"))
    assert pairs_of(members, links).count() == 0 and groups(members, links).count() == 0


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    from quire.llm import neardup as nd

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "B2", "가나", "ΣΑ", "x-y", "\x00", "İ"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a", "a b", "a b c", "a\x00b\x00c", "\x00", "a b c " * 500, "c"]
    monkeypatch.setattr(nd, "READ", 500)
    for size in (1, 3):
        every, sizes = nd.shingle_sets(texts, size)
        assert np.array_equal(np.concatenate([nd.shingles(t, size) for t in texts]), every)
        for text, h in zip(texts, np.split(every, np.cumsum(sizes)[:-1])):
            words = re.findall("[0-9a-z가-힣]+", (text or "").lower())
            assert len(h) == len({tuple(words[k : k + size]) for k in range(len(words) - size + 1)}) and (np.diff(h.astype(object)) > 0).all()
    assert [len(x) for x in nd.shingle_sets([], 3)] == [0, 0]


# 7: top n
def test_top_n(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("g", f"i{k:03d}", float(k % 7)) for k in range(300)] + [("g", "i006", 99.0), ("g", "i006", 1.0), ("h", "x", nan), ("h", "y", inf), ("h", "z", None), (None, "n", 1.0), ("h", None, 5.0), ("h", "w", -2.0)]
    df = spark.createDataFrame(rows + rows, "grp string, id string, sc double").withColumns({"place": F.lit("x"), "salt": F.lit(1), "near": F.lit(2), "item": F.lit(3)})
    got = {(r["grp"], r["place"]): (r["id"], r["sc"]) for r in top_n(df, ["grp"], "id", "sc", 3).collect()}
    assert got == {("g", 1): ("i006", 99.0), ("g", 2): ("i013", 6.0), ("g", 3): ("i020", 6.0), ("h", 1): ("w", -2.0), (None, 1): ("n", 1.0)}
    assert top_n(df.limit(0), ["grp"], "id", "sc", 3).count() == 0 and top_n(df, ["grp"], "id", "sc", 0).count() == 0


# 8: packing
def test_packing(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(1, 90)) for k in range(3000)] + [(9000, 250), (9001, 100), (9002, 0), (9003, None), (None, 5)]
    df = spark.createDataFrame(rows, "ident bigint, tokens bigint").withColumns({"name": F.lit("x"), "container": F.lit(1)}).repartition(7)
    got = pack(df, {"a": 100, "b": 1000}, open_windows=16, fan_in=2).collect()
    for name, capacity in (("a", 100), ("b", 1000)):
        mine = [r for r in got if r["name"] == name]
        used, parts = {}, {}
        for r in mine:
            used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
            parts.setdefault(r["ident"], []).append((r["first"], r["tokens"]))
        assert max(used.values()) <= capacity
        assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: n for i, n in rows if i is not None and n}
        assert all(len(p) == -(-n // capacity) for i, p in parts.items() for k, n in rows if k == i)
        assert sum(used.values()) >= 0.9 * capacity * len(used)
        assert sum(used.values()) / (len(used) * capacity) > 0.93
    assert sorted((r["first"], r["tokens"]) for r in got if r["ident"] == 9000 and r["name"] == "a") == [(0, 100), (100, 100), (200, 50)]
    assert pack(df.limit(0), {"a": 10}).count() == 0


# 9: mixing
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=12), st.integers(0, 3000))
def test_fill_is_best(histogram, budget):
    lengths, counts = np.array(list(histogram)), np.array(list(histogram.values()))
    taken = fill(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all() and (taken * lengths).sum() <= budget
    if budget >= (lengths * counts).sum():
        assert (taken == counts).all()


def test_fill_hits_a_reachable_sum():
    assert int((fill(np.array([7, 11, 13]), np.array([5, 5, 5]), 100) * [7, 11, 13]).sum()) == 100


def test_fill_tries_the_shortest_lengths():
    lengths = np.array([*range(4000, 2400, -2), 1])  # only the last reaches an odd sum
    taken = fill(lengths, np.ones(len(lengths), np.int64), 100_001)
    assert int((taken * lengths).sum()) == 100_001 and taken.max() == 1


def test_mixing(spark):
    rows = [(k, "a" if k % 3 else "b", f"x{k}", 10 + k % 9) for k in range(900)] + [(5000, "c", "y", 40), (5001, "c", "y2", 30), (5002, None, "q", 9), (5003, "zz", "r", 9), (5004, "c", "e", 0), (None, "a", "s", 5), (5005, "c", "y", 40)]
    docs = spark.createDataFrame(rows, "ident bigint, source string, text_key string, tokens bigint").withColumns({"bucket": F.lit("x"), "copies": F.lit(9)})
    targets = spark.createDataFrame([("A", 0.5, 1), ("b", 0.2, 2), ("c ", 0.2, 3), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["missing"]["tokens"] == 0 and got["c"]["tokens"] == 210
    for s, t in (("a", 0.5), ("b", 0.2), ("c", 0.2)):
        assert abs(got[s]["share"] - t / 0.9) < 0.01
    used = chosen.collect()
    assert sum(r["tokens"] * r["copies"] for r in used) == sum(r["tokens"] for r in got.values())
    assert max(r["copies"] for r in used if r["source"] == "a") == 1 and {r["copies"] for r in used if r["source"] == "c"} == {3}
    assert {tuple(r) for r in mix(docs.repartition(5), targets)[0].collect()} == {tuple(r) for r in used}
    assert mix(docs.limit(0), targets)[0].count() == 0
    assert {r["source"]: r["tokens"] for r in mix(docs, targets, total_tokens=10**9)[1].collect()}["b"] > got["b"]["tokens"]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "가나다"), (5, "a" * 100_000)], "id bigint, text string").withColumn("tokens", F.lit("x"))
    got = {r["ident"]: r["tokens"] for r in token_counts(df, "id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 0 and got[5] > 0


# 10: subjects
def test_subjects(spark):
    from compare import DATA

    samples = spark.read.parquet(f"{DATA}/../sf0.01/subject_samples.parquet")
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    labelled = samples.select((F.col("sample_id") + 10**9).cast("bigint").alias("doc_id"), "text")
    odd = spark.createDataFrame([(10**10, None), (10**10 + 1, ""), (10**10 + 2, "Keep a pencil at hand."), (None, "x")], "doc_id bigint, text string")
    both = docs.unionByName(labelled).unionByName(labelled.limit(5)).unionByName(odd).withColumns({"subject": F.lit("x"), "parts": F.lit(1)})
    got = document_subjects(both, samples).where("doc_id >= 1000000000").collect()
    want = {r["sample_id"] + 10**9: r["subject"] for r in samples.collect()}
    right = sum(want.get(r["doc_id"]) == r["subject"] for r in got)
    assert right >= 0.9 * len(want) and len(got) <= 1.15 * len(want)
    assert len({(r["doc_id"], r["subject"]) for r in got}) == len(got)
    assert document_subjects(both.limit(0), samples).count() == 0 and document_subjects(docs.limit(9), samples.limit(0)).count() == 0


def test_mined_rules_find_what_the_seeds_do_not(spark):
    docs, samples = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/subject_samples.parquet")
    mined, seeds = ({(r["doc_id"], r["subject"]) for r in document_subjects(docs, samples, rounds=n).collect()} for n in (2, 0))
    assert len(seeds & mined) < 0.98 * len(mined) and len(seeds - mined) > 0.02 * len(seeds)
