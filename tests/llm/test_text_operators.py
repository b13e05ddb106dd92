"""Language identification, token counts, packing, token matrices, extraction."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakecohort.llm import bestfit, bpe_count, html, langid, packing, tokens

ODD = [None, "", " ", "a", "A  b\n\nc", " lead", "trail ", "<|endoftext|> x <|startoftext|>", "é ü 日本語 😀!!", "don't WE'LL 12345", "a\x1cb c d", "x" * 3000, "İΣΑΣ ǅ", "tab\tand\r\nline", "word " * 3000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(i, t, "en", "rest") for i, t in enumerate(ODD)] + [(3, "a", None, None), (None, "no id", "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, __text string")


def test_counts_are_the_library_s(spark, odd):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe_count.count_tokens(odd).collect()
    assert len(got) == odd.count()
    texts = [r["text"] or "" for r in odd.collect()]
    assert [r["n_tokens"] for r in got] == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert [r["n_bytes"] for r in got] == [len(x.encode()) for x in texts] and any(r["over_limit"] for r in got)
    assert bpe_count.count_tokens(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_in_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    global _library
    _library = globals().get("_library") or Tokenizer.from_file(path)
    assert bpe_count.counter(path).count(text) == len(_library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab '\n\t.1é日<|endoftext|>"), max_size=60))
def test_any_text_has_the_library_s_ids(text):
    e = tokens.encoder("byte_bpe_50k.json")
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.exact(text)


def whole(docs_rows, pieces, limit):
    """Every id of every document lies in one piece, and sequences are gapless."""
    e = tokens.encoder("byte_bpe_50k.json")
    wanted = sorted(((r["doc_id"], tuple([*e.exact(r["text"] or ""), packing.END_ID])) for r in docs_rows), key=repr)
    by = {}
    for p in pieces:
        assert 0 < p["length"] <= limit
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for (doc, n), parts in by.items():
        same = [ids for d, ids in wanted if d == doc and len(ids) == n]
        assert sum(p["length"] for p in parts) == n * len(same)
        for p in parts:
            assert p["ids_crc32"] in {zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for ids in same}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("limit", [2048, 16])
def test_packing_loses_nothing(odd, limit):
    whole(odd.collect(), packing.pack(odd, limit=limit).collect(), limit)
    assert packing.pack(odd.limit(0), limit=limit).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plans_place_every_length_once(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.plan(histogram, 20)
    placed = [n for count, p in patterns for n in p * count]
    assert sorted(placed) == sorted(lengths) and all(sum(p) <= 20 for _, p in patterns)
    used = {}
    for length, lo, hi, first, offset in packing.slots(patterns):
        for r in range(lo, hi):
            used.setdefault(length, []).append(r)
    assert all(sorted(v) == list(range(histogram[k])) for k, v in used.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_a_plain_search(lengths):
    rooms, plain = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [k for k, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: (rooms[k], 0))
            least = rooms[k]
            k = k if least != 30 else k
        else:
            rooms.append(30)
            k = len(rooms) - 1
        rooms[k] -= lengths[i]
        plain.setdefault(k, []).append(i)
    rows = bestfit.best_fit_decreasing(lengths, 30)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths))) and all(sum(lengths[i] for i in r) <= 30 for r in rows)
    assert sorted(30 - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def test_token_matrix_round_trip(spark, odd, tmp_path):
    e = tokens.encoder("byte_bpe_50k.json")
    bestfit.write(odd, str(tmp_path / "m"), shard_tokens=3000)
    parts = []
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = bestfit.matrix([r["ids"]])[0]
        assert len(ids) == bestfit.LENGTH and r["cu_seqlens"][:-1] == r["position_resets"]
        positions = bestfit.position_ids(r["cu_seqlens"])
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert positions[a] == 0 and positions[b - 1] == b - a - 1
            parts.append((doc, start, ids[a:b].tolist()))
    end = e.tokenizer.token_to_id(bestfit.END)
    wanted = []
    for r in odd.collect():
        ids = [*e.exact(r["text"] or ""), end]
        wanted += [(r["doc_id"], at, ids[at : at + bestfit.LENGTH]) for at in range(0, len(ids), bestfit.LENGTH)]
    assert sorted(parts, key=repr) == sorted(wanted, key=repr)
    assert bestfit.token_matrix(odd.limit(0)).count() == 0


def test_languages(spark, odd):
    words = {"en": "the of and with from this that was for is on by", "de": "der die und nicht mit von ist das zu auf ein", "fr": "le la les des est une dans pour que qui sur"}
    rng = np.random.default_rng(1)
    make = lambda k, n: " ".join(rng.choice(words[k].split(), n))
    train = spark.createDataFrame([(make(k, 60), k) for k in words for _ in range(30)] + [(None, "en"), ("x", None), ("123", "de")], "text string, lang string")
    model = langid.fit(train)
    held = [(k, make(k, 25)) for k in words for _ in range(20)]
    assert sum(model.predict(t)[0] == k for k, t in held) >= 57
    assert model.predict("12 34 !?") == ("und", 0.0, True) and model.predict(None)[0] == "und"
    got = langid.identify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["lang_score"] <= 1 for r in got) and got[0]["__text"] == "rest"
    assert langid.fit(train.limit(0)).predict("abc") == ("und", 0.0, True)
    long = make("de", 20000) + " " + make("fr", 200)
    assert model.predict(long)[0] == "de"


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header class="site"><a href=/>Home</a></header>
    <nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies, please, accept them.</div><div id="wrap"><div class="content"><h1>Head &amp; tail</h1>
    <p><b>First para, with some commas, that is long enough, to count.<br>More <i>o</i>f it<p>Second&nbsp;&eacute; paragraph,
    also long, with words, and more.</p><div class="ad">Buy</div><ul><li>One point</li><li>Two</li></ul><ul><li><a>r1</a><li><a>r2</a></ul></div></div>
    <div class="sidebar"><p>Side, text, here, and there, is long enough as well.</p></div><section id="comments"><p>Nice, article, very, good, thanks, a lot.</p></section>
    <form><p>Subscribe, to, us</p></form><footer>&copy; us</footer>"""
    assert html.extract(page) == "Head & tail First para, with some commas, that is long enough, to count. More of it Second é paragraph, also long, with words, and more. One point Two"
    assert [html.extract(x) for x in (None, "", "plain", "<p>Short.", "<nav>x</nav>", "<!-- c", '<div "x><p>a b</p>', "<script>x", "</p></div>a")] == ["", "", "plain", "Short.", "", "", "a b", "", "a"]
    assert html.extract("<div>" * 3000 + "deep text here" + "</div>" * 3000) == "deep text here"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None)], "page_id long, url string, html string, text2 string")
    rows = html.main_text(df, keep=["page_id", "url"]).collect()
    assert len(rows) == 3 and rows[2]["text"] == "" and rows[2]["n_chars"] == 0 and rows[0]["n_chars"] == len(rows[0]["text"])
    assert html.main_text(df.limit(0), keep=["page_id"]).count() == 0


def test_arrow_slices():
    from lakecohort.llm import common

    column = common.strings(pa.chunked_array([pa.array(["ab", None, "c" * 50]), pa.array(["d"])]))
    assert column.to_pylist() == ["ab", "", "c" * 50, "d"]
    assert list(common.byte_slices(column, 10)) == [(0, 2), (2, 3), (3, 4)] and list(common.byte_slices(column[:0], 10)) == []
    data, offsets = common.text_buffer(column.slice(2, 2))
    assert bytes(data) == b"c" * 50 + b"d" and offsets.tolist() == [0, 50, 51]


def test_number_characters_are_no_letters():
    model = langid.Classifier({"a": ["some words of a"], "b": ["other text in b"]})
    assert all(model.predict(t)[:2] == (langid.UNDETERMINED, 0.0) for t in ("½", "²", "Ⅷ ①", "12 _", ""))
    assert model.predict("ª words")[0] == "a"


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>" * 8000 + "text, " * 50 + "</div>" * 8000, "<table><tr><td>" * 4000 + "some words here, and more", "<ul><li>x" * 5000):
        began = time.process_time()
        html.extract(page)
        assert time.process_time() - began < 3


def test_the_head_of_an_article_stays():
    words = "some words of an article, with commas, that go on for a while. " * 4
    page = f"<body><div class='site-header'>brand</div><article><div class='article-header'><h1>Headline</h1></div><p>{words}</p><p>{words}</p></article></body>"
    assert html.extract(page).startswith("Headline some words") and "brand" not in html.extract(page)
