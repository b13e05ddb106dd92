"""Pattern packing, the Merkle manifest and the filter audit against plain versions and their SQL."""

import hashlib
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakecohort.llm import filter_audit, merkle, oracles, pattern_packing

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans(merkle.UPPER, merkle.LOWER)
ODD = [None, "", " ", "a", "A  b\n\nc", "<|endoftext|> x <|startoftext|>", "é ü 日本語 😀!!", "don't WE'LL 12345", "a\x1cb c d", "x" * 3000, "İΣΑΣ ǅ", "a ́b", "tab\tand\r\nline", "word " * 5000]

_tokenizer = None


def library(text):
    global _tokenizer
    _tokenizer = _tokenizer or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return _tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=st.sampled_from("aB '\n\t.1é́日<|endoftext|>"), max_size=60))
def test_ids_of_words_are_the_library_s(text):
    assert np.frombuffer(pattern_packing.word_ids("word_bpe_49k.json").encode(text), "<u4").tolist() == library(text)


def test_all_patterns_are_enumerated():
    lengths = np.array([1, 2, 3, 5, 8, 9, 10, 12, 20])
    plain = {tuple(sorted((a, b, c))) for a in [0, *lengths] for b in lengths for c in lengths if a + b + c == 20 and max(a, b, c) < 20}
    assert set(map(tuple, pattern_packing.patterns(lengths, 20).tolist())) == plain


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
def test_plans_hold_each_piece_once(histogram):
    plan = pattern_packing.plan(histogram, 64)
    got: dict[int, int] = {}
    for n, lengths in plan:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            got[x] = got.get(x, 0) + n
    assert got == histogram
    # first fit and better: fewer than 11/9 of the least, and one
    assert sum(n for n, _ in plan) <= max(-(-sum(k * v for k, v in histogram.items()) // 64), sum(v for k, v in histogram.items() if k > 32)) * 1.5 + 1


def test_fit_meets_a_histogram_that_patterns_fill():
    rng = np.random.default_rng(3)
    histogram = np.zeros(257, np.int64)
    for _ in range(300):
        a, b = sorted(rng.integers(1, 256, 2))
        for x in (a, b - a, 256 - b):
            histogram[x] += 40
    histogram[0] = 0
    chosen, counts = pattern_packing.fit(histogram, 256)
    assert (counts >= 0).all() and (chosen.sum(1) == 256).all()
    left = histogram - pattern_packing._used(chosen, counts, 256)
    assert np.abs(left[1:] * np.arange(1, 257)).sum() < 0.1 * (histogram * np.arange(257)).sum()
    fitted, rest = pattern_packing.rounded(chosen, counts, histogram)
    assert (rest >= 0).all() and sum(n for n, _ in fitted) > 0.8 * (histogram * np.arange(257)).sum() / 256


def test_pieces_of_documents_are_packed(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "no id")] + [(100 + i, "copy " * 700) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, length long, part string, rank int")
    got = pattern_packing.pack(docs).collect()
    wanted = []
    for i, t in rows:
        ids = [*library(t), 0]
        wanted += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(wanted, key=repr) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(w[3] for w in wanted) // 2048) + 1 + sum(600 < w[3] < 1024 for w in wanted) // 2
    assert pattern_packing.pack(docs.limit(0)).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Top, and the siblings (left, right) of each node level by level."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        tops, members = [], []
        for at in range(0, len(nodes), 16):
            run, inside = nodes[at : at + 16], owners[at : at + 16]
            for j, own in enumerate(inside):
                for i in own:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            tops.append(digest("".join(run)))
            members.append(sum(inside, []))
        nodes, owners = tops, members
    return nodes[0], paths


def plain_manifest(rows):
    by: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = digest("".join(map(told, (doc_id, source, lang, n_chars, text))))
        changed = text.translate(LOW) if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        by.setdefault(source, []).append((doc_id, leaf, digest("".join(map(told, (doc_id, source, lang, n_chars, changed))))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], []
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, paths = tree([x[1] for x in by[s]])
        tops.append(top)
        inner.append(paths)
    root, upper = tree(tops) if tops else ("", [])
    out = []
    for k, s in enumerate(names):
        for (doc_id, leaf, changed), path in zip(by[s], inner[k]):
            node, path = changed, path + upper[k]
            for left, right in path:
                node = digest(left + node + right)
            out.append((doc_id, leaf, tops[k], root, digest("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def manifest_rows():
    rng = np.random.default_rng(7)
    rows = [(int(i), f"Text {i} É\n", "en", "hot", 9) for i in rng.permutation(9000)]  # three blocks
    rows += [(i, f"Some {i}", None, f"s{i % 300}", i) for i in range(9000, 9600)]  # three levels of sources
    rows += [(5, "Twice", "en", "two", 1)] * 20 + [(6, "Twice", "en", "two", 1), (6, "Other", "en", "two", 1), (None, "X", None, None, None), (None, None, None, "", None), (7, "", "", "", 0), (8, "Ab" * 50_000, "en", "é", 3), (9, "x", "en", "z", 1)]
    return rows


def test_manifest_against_a_plain_version_and_its_sql(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS)
    clash = docs.selectExpr("*", "1 AS tree", "2 AS pos", "'x' AS leaf", "3 AS block", "4 AS n", "5 AS path")
    wanted = plain_manifest(rows)
    assert sorted(map(tuple, merkle.manifest(clash.repartition(5)).collect()), key=repr) == wanted
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(con.sql(oracles.SQL["op12_merkle_manifest"]).fetchall(), key=repr) == wanted
    tops = {(r["source"], r["subroot"], r["root"]) for r in merkle.roots(docs).collect()}
    assert {(s, r) for _, s, r in tops} == {(w[2], w[3]) for w in wanted} and len(tops) == len({r[3] for r in rows})


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "a", 3)], [(5, "AB", "en", None, 2)] * 3, [(i, "T", "en", "a", 1) for i in range(17)], [(i, "T", "en", f"{i}", 1) for i in range(16)]])
def test_small_manifests(spark, rows):
    assert sorted(map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCUMENTS)).collect()), key=repr) == plain_manifest(rows)


@settings(max_examples=50, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**40), 2**40)))
def test_crc_in_sql(doc_id):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([doc_id], pa.int64()), "text": ["AB"], "lang": ["e"], "source": ["s"], "n_chars": pa.array([2], pa.int64())}))
    verified = con.sql(oracles.SQL["op12_merkle_manifest"]).fetchall()[0][-1]
    assert verified == (doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 != 0)


def plain_audit(rows, labels):
    facts = []
    for i, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        facts.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [x for x in own if f in x[1] and not x[1] & before]
                shapley[f] += len(here)
                out[part, order, step] = [
                    sum(not x[1] & before and f not in x[1] for x in own), len(here), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own),
                    sum(x[2] for x in here), sum(x[3] for x in here),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_a_plain_version_and_its_sql(spark):
    rng = np.random.default_rng(11)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d#", "é", "x|y", "ok", "z1", "ÄÖ", " "])
    texts = [" ".join(word() for _ in range(rng.integers(1, 40))) for _ in range(40)]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 51, 80)] + [" ".join(f"w{i % 52}" for i in range(80)), "A" + "b" * 19, "A" + "b" * 18, "\x1c\x1d", "word " * 20_000, "", "\t\n"]
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s0", 1), (101, texts[0], "en", None, 1), (102, None, None, "", None), (103, "", None, None, None), (None, texts[0], "en", "s1", 1), (5, texts[5], "en", "s1", 1), (1, texts[3], None, "s2", 1)]
    rows += [(1000 + i, "Hot copy $", "en", "s0", 1) for i in range(120)]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.integers(0, 60, 50)] + [(None, 1, 1), (1000, 1, None), (1001, None, 1), (1001, 0, 0), (99999, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    wanted = plain_audit(rows, labels)
    clash = docs.selectExpr("*", "1 AS part", "2 AS mask", "3 AS quality", "'q' AS digest", "5 AS step", "6 AS place")
    got = filter_audit.audit(clash, marks.selectExpr("*", "'l' AS text", "'s' AS part"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == wanted
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", marks.toArrow())
    found = con.sql(oracles.SQL["op13_filter_audit"])
    assert found.columns == got.columns and {r[:3]: r[3:] for r in found.fetchall()} == wanted
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert {tuple(r)[:3]: r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == dict.fromkeys(wanted, 0)
