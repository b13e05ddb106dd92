"""Near duplicates, passages, test items, search, language model and the pipeline against plain versions."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecohort.llm import common, decontaminate, maxscore, minhash, neardup, paragraphs, ppm, textkit

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))


def shingles(text):
    w = word_list(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(items):
    """Smallest id reachable, by comparing all pairs."""
    above = {d: d for d, _ in items}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (a, s) in enumerate(items):
        for b, t in items[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {d: top(d) for d in above}


@pytest.fixture(scope="module")
def texts():
    """Unique texts, exact copies, a hub with copies that are unlike each other, and a chain."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    make = lambda n: list(rng.choice(vocabulary, n))
    out = [" ".join(make(int(rng.integers(1, 90)))) for _ in range(60)]
    hub = make(200)
    for _ in range(60):
        t = list(hub)
        for at in rng.choice(len(t), 5, replace=False):
            t[at] = rng.choice(vocabulary)
        out.append(" ".join(t))
    chain = make(120)
    for _ in range(20):
        out.append(" ".join(chain))
        chain = chain[3:] + make(3)
    out += [out[0]] * 30 + [" ".join(hub), None, "", " \n", "one two", "One  TWO", "one two three"]
    return out


def test_shingle_hashes_match_plain_sets(texts):
    data = [t or "" for t in texts]
    raw = "".join(data).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in data)])
    w = textkit.words(np.frombuffer(raw, np.uint8), offsets)
    assert np.diff(w.first).tolist() == [len(word_list(t)) for t in data]
    assert [len(s) for s in textkit.shingle_sets(w)] == [len(shingles(t)) for t in data]


def test_floors_hold_the_miss_probability():
    b = neardup.Banding()
    for n, m in b.floors():
        below = sum(math.comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(m))
        assert below < 5 * b.miss


def test_pruning_over_all_batches_hardly_loses_a_pair_at_the_threshold():
    for banding in (minhash.BANDING, paragraphs.BANDING):
        live, at, lost = {0: 1.0}, 0, 0.0
        for n, need in banding.floors():
            now: Counter = Counter()
            for m, p in live.items():
                for k in range(n - at + 1):
                    now[m + k] += p * math.comb(n - at, k) * 0.75**k * 0.25 ** (n - at - k)
            lost += sum(p for m, p in now.items() if m < need)
            live, at = {m: p for m, p in now.items() if m >= need}, n
        assert lost < 1e-5


def test_documents_against_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in minhash.deduplicate(docs).collect()}
    wanted = components([(i, shingles(t)) for i, t in enumerate(texts)])
    assert {d: r["component_id"] for d, r in got.items()} == wanted
    assert all(r["n_shingles"] == len(shingles(texts[d])) and r["kept"] == (d == wanted[d]) for d, r in got.items())
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({d for d, c in wanted.items() if d == c})


def test_documents_with_one_id_and_without(spark):
    t = " ".join(f"a{i}" for i in range(20))
    docs = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (None, None), (7, "x y")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.deduplicate(docs).collect())
    assert rows == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True)]
    assert minhash.deduplicate(docs.limit(0)).count() == 0
    twice = minhash.keep_first(spark.createDataFrame([(5, t), (5, t), (6, t)], "doc_id long, text string"))
    assert [r["doc_id"] for r in twice.collect()] == [5]


def test_many_cells_lose_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 7)
    monkeypatch.setattr(neardup, "DRAWS", 0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.deduplicate(docs).collect()}
    assert got == components([(i, shingles(t)) for i, t in enumerate(texts)])


def test_passages_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    make = lambda n: " ".join(rng.choice([f"v{i}" for i in range(900)], n))
    shared, near = make(60), make(60)
    edited = near.replace(near.split()[30], "changed", 1)
    rows = [(2, f"{make(30)}\n{shared}\nshort line"), (1, f"short line\n{shared}"), (3, near), (4, f"{make(25)}\n{edited}\n{edited}"), (5, None), (6, ""), (7, make(40)), (8, shared.upper()), (8, shared.upper())]
    docs = spark.createDataFrame([(*r, "rest") for r in rows], "doc_id long, text string, places string")
    got = paragraphs.remove(docs).collect()
    units = [((d, p), shingles(line)) for d, t in sorted(set(rows), key=lambda r: r[0]) for p, line in enumerate((t or "").split("\n")) if len(line.split()) >= paragraphs.MIN_WORDS]
    first = components(units)
    for r in got:
        t = next(t for d, t in rows if d == r["doc_id"])
        kept = None if t is None else "\n".join(line for p, line in enumerate(t.split("\n")) if first.get((r["doc_id"], p), (r["doc_id"], p)) == (r["doc_id"], p))
        assert r["text"] == kept and r["places"] == "rest"
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["removed_words"]} == {2, 4, 8}
    assert paragraphs.remove(docs.limit(0)).count() == 0


def test_passages_are_found_whatever_the_lines(spark):
    rng = np.random.default_rng(12)
    make = lambda n: " ".join(rng.choice([f"z{i}" for i in range(3000)], n))
    broken = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    inside, rewrapped, short, least, less = make(60), make(120), make(70), make(50), make(49)
    rows = [(1, f"{make(23)}\n{make(80)} {inside} {make(20)}"), (2, f"{make(200)} é {inside.upper()} {make(40)}"), (3, broken(rewrapped, 40)), (4, make(9) + " " + broken(rewrapped, 33))]
    rows += [(5, broken(short, 7)), (6, broken(f"{make(30)} {short} {make(30)}", 8)), (7, f"{make(30)} {least} {make(90)} {least} tail"), (8, f"{make(60)} {less} {make(60)}"), (9, f"{make(60)} {less} {make(60)}")]
    rows += [(None, f"{make(100)} {inside}"), (None, "short"), (10, None)]
    got = {r["doc_id"] if r["text"] != "short" else "short": r for r in paragraphs.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    words = lambda t: t.lower().split()
    seen, wanted = set(), {}
    for d, t in [r for r in rows if r[0] is not None and r[1]] + [r for r in rows if r[0] is None and r[1] != "short"]:
        w = words(t)
        cut = set()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if run in seen:
                cut |= set(range(i, i + 50))
            seen.add(run)
        wanted[d] = [x for i, x in enumerate(w) if i not in cut], len(cut)
    assert {d for d, (_, n) in wanted.items() if n} == {2, 4, 6, 7, None}
    for d, (kept, n) in wanted.items():
        assert words(got[d]["text"]) == kept and got[d]["removed_words"] == n
    assert got[1]["text"] == rows[0][1] and got[8]["text"] == rows[7][1] and got[10]["text"] is None


def test_items_are_found_and_clean_texts_left(spark):
    rng = np.random.default_rng(9)
    make = lambda n: " ".join(rng.choice([f"k{i}" for i in range(700)], n))
    items = [(i, make(int(rng.integers(15, 60)))) for i in range(30)] + [(30, f"{make(20)}\n{make(20)}"), (31, make(400)), (None, make(30)), (33, None), (34, "")]
    docs, wanted = [], {}
    for i in range(150):
        t = make(int(rng.integers(1, 500)))
        if i % 3 == 0:
            k = int(rng.integers(0, 32))
            words = t.split()
            at = int(rng.integers(0, len(words) + 1))
            t = " ".join([*words[:at], items[k][1].upper().replace(" ", ", "), *words[at:]])
            wanted[i] = {k}
        docs.append((i, t, 0))
    docs += [(1000, None, 0), (1001, "", 0), (1002, make(20000) + " " + items[3][1], 0)]
    wanted[1002] = {3}
    d, b = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string")
    for index_bytes in (decontaminate.INDEX_BYTES, 2000):
        got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontaminate.find(d, b, index_bytes=index_bytes).collect()}
        assert {k: v for k, v in got.items() if v} == wanted
    assert decontaminate.clean(d, b).count() == len(docs) - len(wanted) and decontaminate.clean(d, b).columns == d.columns
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs) and decontaminate.find(d.limit(0), b).count() == 0


def test_skipping_retrieves_what_full_scores_do():
    rng = np.random.default_rng(2)
    items = [(i, " ".join(rng.choice([f"t{i}" for i in range(60)], 12))) for i in range(200)]
    index = decontaminate.build(items)
    dense = np.zeros((len(index.vocabulary), len(index.items)))
    for t in range(len(index.vocabulary)):
        for p in range(index.term_at[t], index.term_at[t + 1]):
            at = slice(index.pair_at[p], index.pair_at[p + 1])
            dense[t, index.entry[at]] = index.impact[at]
    assert np.allclose(dense.sum(axis=0), 1)
    keys = np.unique(rng.integers(0, 40, 500) * 1000 + rng.integers(0, len(index.vocabulary), 500))
    window, term = keys // 1000, keys % 1000
    for threshold in (0.2, 0.5):
        got = {(w, e) for w, e, _ in decontaminate.retrieve(index, window, term, threshold)}
        full = {(w, e) for w in set(window.tolist()) for e, s in enumerate(dense[term[window == w]].sum(axis=0)) if s >= threshold + 1e-9}
        assert full <= got and len(got) - len(full) <= 2


def test_search_is_exact(spark):
    rng = np.random.default_rng(4)
    v = [[float(x) for x in rng.normal(0, 0.2, 8)] for _ in range(300)]
    rows = [(i, x, 0) for i, x in enumerate(v)] + [(300, v[0], 0), (301, v[0], 0), (302, None, 0), (303, [], 0), (304, [1.0, None], 0), (305, [float("nan")] * 8, 0), (306, [float("inf")] * 8, 0), (350, [0.5, 0.5], 0), (351, [0.1, 0.1], 0), (0, v[1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    whole = [(i, k, [math.floor(256 * float(np.float32(x))) for x in e]) for k, (i, e, _) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e)]
    wanted = []
    for i, k, q in whole:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, m, c in whole if m != k and len(c) == len(q))
            wanted += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:5])]
    for shard, block in ((8192, 8192), (40, 3)):
        got = maxscore.top_k(df, F.col("vec_id") % 50 == 0, shard=shard, block=block).collect()
        assert sorted(map(tuple, got)) == sorted(wanted)
    assert maxscore.top_k(df.limit(0), F.lit(True)).count() == 0


def plain_ppm(train, text, order):
    """log10 probability by the definition, with dictionaries."""
    counts = [{} for _ in range(order + 1)]
    code = lambda t: b"\n" * order + b" ".join(word_list(t)) + b"\n"
    for t in train:
        s = code(t)
        for i in range(order, len(s)):
            for d in range(order + 1):
                counts[d].setdefault(s[i - d : i], Counter())[s[i]] += 1
    out, s = 0.0, code(text)
    for i in range(order, len(s)):
        excluded: set = set()
        for d in range(order, -1, -1):
            c = {k: n for k, n in counts[d].get(s[i - d : i], {}).items() if k not in excluded}
            if not c:
                continue
            total = sum(c.values())
            if s[i] in c:
                out += math.log10((2 * c[s[i]] - 1) / (2 * total))
                break
            out += math.log10(len(c) / (2 * total))
            excluded |= set(c)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def test_scores_against_the_definition(spark):
    rng = np.random.default_rng(6)
    make = lambda n: " ".join(rng.choice(["the", "cat", "Sat", "on", "mats", "é", "x1"], n))
    rows = [(i, make(int(rng.integers(0, 12)))) for i in range(60)] + [(100, None), (101, " \n"), (3, "the cat"), (None, "no id"), (102, "zebra qu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = ppm.score(docs, held_out=common.held_out("doc_id", 7)).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [t for d, t in rows if not out(d)]
    c = Counter(w for t in train for w in [*word_list(t), b"\n"])
    n, kinds = sum(c.values()), len(c)
    wanted = []
    for d, t in rows:
        w = [*word_list(t), b"\n"]
        wanted.append((d, out(d), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + kinds + 1)) for x in w), 6), round(plain_ppm(train, t, ppm.ORDER), 6)))
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=repr) == sorted(wanted, key=repr)
    assert ppm.score(docs.limit(0)).count() == 0
    none = ppm.score(docs.filter("doc_id = 3"), held_out=F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


@pytest.mark.parametrize("floor", [1, 4])
def test_probabilities_add_up_to_one(floor):
    rng = np.random.default_rng(8)
    s = rng.choice([97, 98, 99, 32, 10], 3000).astype(np.uint64)
    keys = s[2:] | s[1:-1] << np.uint64(8) | s[:-2] << np.uint64(16)
    pairs = [ppm.distinct(keys)]
    for d in (1, 0):
        pairs.append(ppm.summed(pairs[-1][0] & ppm.mask(d + 1), pairs[-1][1]))
    kept = []
    for k, n in reversed(pairs):
        _, inverse = np.unique(k >> np.uint64(8), return_inverse=True)
        keep = np.bincount(inverse, n)[inverse] >= floor
        kept.append((k[keep], n[keep]))
    trie = ppm.Trie(kept)
    for context in (97 << 8 | 98, 10 << 8 | 10, 200 << 8 | 97, 1 << 8 | 2):
        every = np.arange(256, dtype=np.uint64) | np.uint64(context << 8)
        assert (10 ** trie.score(every)).sum() == pytest.approx(1)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.6 * len(ids)
        ids, docs = now, out
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_rows_of_one_item_are_judged_each_on_its_own(spark):
    rng = np.random.default_rng(21)
    make = lambda n: " ".join(rng.choice([f"q{i}" for i in range(900)], n))
    versions = [make(30) for _ in range(4)]
    items = spark.createDataFrame([(7, t) for t in versions] + [(7, versions[0]), (8, make(30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{make(50)} {versions[2]} {make(50)}"), (2, make(120)), (3, f"{versions[0]} {versions[1]}")], "doc_id long, text string")
    for index_bytes in (decontaminate.INDEX_BYTES, 200):
        got = {r["doc_id"]: [(x["item_id"], x["overlap"]) for x in r["leaks"]] for r in decontaminate.find(docs, items, index_bytes=index_bytes).collect()}
        assert got == {1: [(7, 1.0)], 2: [], 3: [(7, 1.0)]}


@pytest.mark.parametrize("share", [ppm.SHARE, 50, 1])
def test_scores_keep_rare_contexts_whatever_the_share(spark, share):
    rng = np.random.default_rng(16)
    make = lambda n: " ".join(rng.choice(["the", "cat", "Sat", "on", "mats", "é", "x1"], n))
    rows = [(i, make(int(rng.integers(0, 12)))) for i in range(40)] + [(100, None), (102, "zebra qu"), (103, "qu\x01 Zebras the cab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ppm.score(docs, held_out=F.col("doc_id") % 4 == 3, share=share).collect()
    train = [t for d, t in rows if d % 4 != 3]
    assert {r["doc_id"]: round(r["score"], 6) for r in got} == {d: round(plain_ppm(train, t, ppm.ORDER), 6) for d, t in rows}


def test_items_of_few_words_are_found_inside_texts(spark):
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (4, "d e f\ng")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, f"{filler} Alpha, {filler}"), (2, f"{filler} beta gamma"), (3, f"gamma beta {filler}"), (4, f"x d e f g {filler}"), (5, "beta gamma")], "doc_id long, text string")
    got = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in decontaminate.find(docs, items).collect()}
    assert got == {1: {1}, 2: {2}, 3: set(), 4: {4}, 5: {2}}


def test_passes_over_the_benchmark_agree(spark):
    rng = np.random.default_rng(4)
    make = lambda n: " ".join(rng.choice([f"q{i}" for i in range(500)], n))
    items = [(i % 25, f"{make(int(rng.integers(12, 40)))}\n{make(int(rng.integers(3, 30)))}") for i in range(40)]
    docs = []
    for i in range(60):
        words = make(int(rng.integers(20, 300))).split()
        if i % 2:
            item = items[int(rng.integers(0, 40))][1].split()
            words[5:5] = item[: int(len(item) * rng.uniform(0.4, 1))]
        docs.append((i, " ".join(words)))
    docs, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = sum(len(t) for _, t in items)
    got = [{r["doc_id"]: sorted((x["item_id"], round(x["overlap"], 9), round(x["score"], 9)) for x in r["leaks"]) for r in decontaminate.find(docs, benchmark, index_bytes=b).collect()} for b in (size, size // 4)]
    assert got[0] == got[1] and 5 < sum(map(bool, got[0].values())) < 40


def test_chunks_of_windows_score_alike(monkeypatch):
    rng = np.random.default_rng(8)
    index = decontaminate.build([(i, " ".join(rng.choice([f"c{k}" for k in range(60)], 40))) for i in range(200)])
    window = np.repeat(np.arange(30), 12)
    term = np.concatenate([np.sort(rng.choice(len(index.vocabulary), 12, replace=False)) for _ in range(30)])
    whole = sorted(decontaminate.retrieve(index, window, term, 0.2))
    monkeypatch.setattr(decontaminate, "HELD", 50)
    assert whole and sorted(decontaminate.retrieve(index, window, term, 0.2)) == whole


def test_what_one_document_repeats_can_stay(spark):
    rng = np.random.default_rng(2)
    make = lambda n: " ".join(rng.choice([f"m{i}" for i in range(3000)], n))
    own, shared = make(60), make(60)
    rows = [(1, f"{own}\n{own}\n{make(30)} {shared}"), (2, f"{make(30)}\n{shared} {make(33)}"), (3, f"{make(5)} {own[:40]}")]
    got = {r["doc_id"]: r for r in paragraphs.remove(spark.createDataFrame(rows, "doc_id long, text string"), within=False).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[1]["first_ids"] == [] and got[3]["first_ids"] == []
    assert shared not in got[2]["text"] and got[2]["first_ids"] == [1] and got[2]["removed_words"] == 60


def test_shuffle_files_of_inner_tables_go_once_they_have_run(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    known = files()
    work = common.Workspace(spark, "test")
    made = work.table(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("key")).agg(F.count("*").alias("n")))
    assert common.hot_keys(spark.range(5000).groupBy("id").agg(F.count("*").alias("n")), "id") is None and common.count(made) == 7
    for _ in range(100):  # files go in the background
        if not files() - known:
            break
        time.sleep(0.1)
    assert not files() - known
    assert spark.conf.get(common.CLEANUP) == "false"


def test_near_duplicate_search_takes_few_queries(spark):
    # what each query leaves with the driver (plans, threads, stages) adds up to most of its memory
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijkl", k=60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(t + f" end{i}" for i, t in enumerate(texts))])), "doc_id long, text string")

    def queries(f):
        sc.listenerBus().waitUntilEmpty()
        before = store.executionsCount()
        out = f().collect()
        sc.listenerBus().waitUntilEmpty()
        return store.executionsCount() - before, len(out)

    taken, kept = queries(lambda: minhash.keep_first(docs))
    assert kept == 40 and taken <= 20
    taken, kept = queries(lambda: minhash.keep_first(docs.limit(40)))
    assert kept == 40 and taken <= 12


def test_tables_tell_what_they_hold_and_few_rows_are_never_dealt_out(spark):
    work = common.Workspace(spark, "test")
    made = work.table(spark.range(1000).select((F.col("id") % 3).alias("key"), F.col("id")).groupBy("key").agg(F.count("*").alias("n")), n=F.sum("n"))
    assert common.seen(made) == made.count() == 3 and common.seen(made, "n") == 1000
    nothing = work.table(made.filter("n < 0"), n=F.sum("n"))
    assert common.seen(nothing) == common.seen(nothing, "n") == nothing.count() == 0
    assert {r["key"] for r in common.hot_keys(made, "key", 1000).collect()} == {0, 1, 2}
    assert common.hot_keys(made.withColumn("n", F.lit(common.FEW).cast("long")), "key", 3 * common.FEW) is None
