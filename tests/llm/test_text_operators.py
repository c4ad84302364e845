"""Token counts, packing, pages: against the libraries themselves and hand-made pages."""

import time
import zlib

import numpy as np
import public_tokenizers

import pytest

from tarnfold.llm import htmltext, packing, tokencount
from tests.llm.cases import ROWS, docs, read

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["it's we'll WE'LL 'tis don't.", "A<|endoftext|>B <|ENDOFTEXT|> x", "naïve  H̱ ẖ ﬁ Σίσυφος ΣΑΣ", "a b \x1c c\x85d", "1234 12.5% x2y", "", "  \n ", "... a... b.!?c", "İstanbul é́"]


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (300, 20), (3000, 64)])
def test_spliced_counts_equal_whole_counts(chunk, overlap):
    counter = tokencount.PieceCounter(PIECES, chunk, overlap)
    texts = [t or "" for _, t in ROWS] + ODD + ["ab   cd\n" * 500, "é" * 900 + " " + "b" * 1200, "x▁y " * 400, " " * 999, "中文" * 700]
    assert counter.stable
    assert counter.counts([t.encode() for t in texts]) == [len(x) for x in counter.model.encode(texts)]


def test_token_counts_of_rows(spark):
    out = tokencount.count_tokens(docs(spark), PIECES, limit=4096).collect()
    model = tokencount.PieceCounter(PIECES).model
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want and all(r.over_limit == (r.n_tokens > 4096) for r in out)
    assert tokencount.count_tokens(docs(spark, []), PIECES).count() == 0


def test_ids_equal_the_library():
    encoder = packing.WordEncoder(WORDS)
    texts = [t or "" for _, t in ROWS] + ODD
    got = list(encoder.ids([t.encode() for t in texts]))
    assert got == [np.array(encoder.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_are_encoded_once_and_ids_equal_the_library(monkeypatch):
    encoder, encoded = packing.WordEncoder(WORDS), []
    own = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda words: encoded.extend(words) or own(words))
    texts = [f"Call {i * 7919:09d} (or +1-{i:04d}), 'Word' word,word. WORD/{i}#word; ÉCOLE, école: {i}" for i in range(1000)]
    want = [want_of(encoder, t) for t in texts]
    assert list(encoder.ids([t.encode() for t in texts])) == want
    assert len(encoded) < 60  # numbers and words with punctuation are put together from pieces
    # every character beside letters, digits, punctuation and apostrophes, in chunks and caches of any size
    texts = [f"aB{c}Bé A{c}, .{c}. 1{c}2 {c}{c} '{c}s a'{c}S <|endoftext|>{c}<|ENDOFTEXT|> H{c}" for c in map(chr, [*range(0x370), 0x1E96, 0x2026, 0x20AC, 0x212A, 0x3000, 0x4E2D, 0xAC00, 0x1F642])]
    want = [want_of(encoder, t) for t in texts]
    for together, cache in ((1, 100), (5000, 0), (1 << 22, 400_000)):
        monkeypatch.setattr(packing, "TOGETHER", together)
        monkeypatch.setattr(packing, "CACHE", cache)
        assert list(encoder.ids([t.encode() for t in texts])) == want
    assert list(encoder.ids([])) == [] and list(encoder.ids([b"", b" ", b"", b"a "])) == [b"", b"", b"", want_of(encoder, "a")]


def want_of(encoder, text):
    return np.array(encoder.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_two_fit_fills_well_and_keeps_all():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2049, 4000), rng.integers(300, 900, 3000), np.full(500, 1025), np.array([2048]), np.array([1] * 3000), np.zeros(0, int)):
        out = packing.best_two_fit(lengths, 2048)
        assert sorted(x for s in out for x in s) == sorted(lengths.tolist()) and all(sum(s) <= 2048 for s in out)
    assert len(packing.best_two_fit(rng.integers(1, 700, 5000), 2048)) <= 1.01 * 5000 * 350 / 2048 + 2
    # the smallest, 3, gives way to two that fit the gap of 4 exactly
    assert sorted(map(sorted, packing.best_two_fit(np.array([6, 3, 2, 2]), 10))) == [[2, 2, 6], [3]]


def test_packed_rows(spark):
    source = docs(spark)
    out = packing.pack(source, WORDS, size=64).toPandas()
    encoder = packing.WordEncoder(WORDS)
    want = []
    for i, t in ROWS:
        ids = encoder.model.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k, 64 * k, len(ids[64 * k:64 * k + 64]), zlib.crc32(np.array(ids[64 * k:64 * k + 64], "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    got = [(str(r.doc_id) if r.doc_id == r.doc_id else "None", r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted((x[0].removesuffix(".0"), *x[1:]) for x in got) == sorted(want)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 64 and (s.offset.to_numpy() == np.cumsum(s.length.to_numpy()) - s.length.to_numpy()).all()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) + 3
    assert packing.pack(docs(spark, []), WORDS).count() == 0


PAGE = """<html><body class="page"><div id="header"><a href=x>Home</a> Site name</div><div class="cookie-notice">We use the cookies on this site to give you
a better experience of it. <button>OK</button></div><ul class="menu"><li><a href=1>One</a></li></ul><div id="c"><h2>Title of it</h2><p>This is the first of many paragraphs
that we have in the page, and it is long enough to be of some use to the reader of it, so that it should be kept.</p><p>Short one.</p><p>Another of the paragraphs in which
there is a <a href=z>link</a> to the other page &amp; more text that is good, with all the words that we need to have for it to be seen.</p></div>
<div class="sidebar"><p>This is the sidebar of the page and it has some text that is long enough to be seen as good but it is not.</p></div>
<section id="comments"><p>I think that this is the best of all the articles that I have read on this site and it is so good.</p></section>
<form><label>Name</label></form><script>var t="</p>";</script><footer>&copy; 2020 Foo</footer></body></html>"""


def test_page_without_article_tag():
    out = htmltext.main_text(PAGE).split("\n\n")
    assert [x[:20] for x in out] == ["Title of it", "This is the first of", "Short one.", "Another of the parag"] and "page & more" in out[3]


def test_article_is_whole_and_plain():
    page = "<nav><a href=/>x</a></nav><div class=ad>Buy it now.</div><article><h1>T</h1><p><b>One\n two &lt;3&#8364;<br><p>Three.<p>All rights reserved.</p></article><footer>f</footer>"
    assert htmltext.main_text(page) == "T\n\nOne two <3€\n\nThree.\n\nAll rights reserved."
    for text in (None, "", "<html></html>", "<script>x</script>", "<!-- c", "<div class='ad'>only this</div>"):
        assert htmltext.main_text(text) == ""
    assert htmltext.main_text("a" * 50000 + "<p" * 2000)


def test_articles_of_any_class_and_language():
    assert htmltext.main_text('<article class="post more share"><p>One text of it.</p></article><article class="comment"><p>Mine.</p></article>') == "One text of it."
    italian = "Il gatto nero salta sopra il cane pigro mentre una volpe corre lontano verso casa vecchia sulla collina verde accanto al fiume. " * 2
    assert htmltext.main_text(f"<nav><a href=/>Su</a></nav><p>{italian}</p><p>Breve.</p><footer>Tutto</footer>") == f"{italian.strip()}\n\nBreve."


def test_many_short_blocks_and_open_tags_take_linear_time():
    start = time.perf_counter()
    assert htmltext.main_text("<p>ab c</p>" * 20_000).count("ab c") in (0, 20_000)
    for page in ("<p" * 16_000, '<a x="' * 8_000, "<div>a" * 8_000):
        htmltext.main_text(page)
    assert time.perf_counter() - start < 10
    assert htmltext.main_text("<article><p>One.</p><script>a > b") == htmltext.main_text("<article><p>One.</p><!-- a > b") == htmltext.main_text("<article><p>One.</p><!-- a") == "One."


@pytest.mark.parametrize("before", ["<svg-icon name=a></svg-icon>", "<button-group>", "<template-part/>", "<title-bar></title-bar>", "<svg viewBox='0 0 1 1'/>", "<math />", '<svg data-x="a>b"/>',
                                    "<button>", "<select>", "<object data=x>", "<canvas>", "<svg>", "<noscript>", '<i data-x="' + "<p>leak</p> " * 900 + '"></i>',
                                    "<i srcdoc='" + "<script>" * 900 + "'></i>", "<svg><path/></svg>", "<button data-x='>leak'>leak</button>", "<script-x></script-x>"])
def test_tags_that_lose_no_text_and_leak_none(before):
    for after in ("", "<button>leak</button>", "<select><option>leak</select>"):
        page = f"<body>{before}<article><p>One of the texts.</p></article>{after}</body>"
        assert htmltext.main_text(page) == "One of the texts."


def test_raw_parts_run_to_their_end():
    for raw in ("script", "style", "textarea", "title"):
        assert htmltext.main_text(f"<article><p>One.</p><{raw}>leak <p>leak</p>") == "One."
    assert htmltext.main_text("<article><p>One <BUTTON a='>'>leak <b>leak</b></Button >two</p></article>") == "One two"


def test_real_pages_keep_their_article(spark):
    import html
    import re
    rows = htmltext.extract_text(read(spark, "pages")).join(read(spark, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_pages_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", PAGE), (2, "u", PAGE)], "page_id long, url string, html string")
    out = htmltext.extract_text(rows.selectExpr("*", "'c' as text", "'c' as id")).collect()
    assert len(out) == 4 and sorted(r.n_chars for r in out)[:2] == [0, 0] and htmltext.extract_text(rows.limit(0)).count() == 0
