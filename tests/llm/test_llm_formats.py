"""Chat formatting, BPE and HTML extraction: round trips and plain rules."""

import hashlib
import json
import pickle
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from vanemesh.llm import bpe, chat, html_extract

CONTROL = chat.END + chat.START + "assistant ok"
MESSAGES = "conv_id long, node long, parent long, role string, text string, score double"


def linear(spark, turns):
    return chat.chained(spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, node int, parent string"))


def test_conversations_round_trip(spark):
    turns = [
        (1, 0, "system", "be \\ good"), (1, 1, "user", CONTROL), (1, 2, "assistant", CONTROL + "<\\|im_end|><\\\\|"), (2, 0, "assistant", None),
        (3, 5, "user", "late"), (3, 1, "user", "early"), (3, 1, "assistant", "tie"), (3, None, "user", "last"), (None, 0, "a\nb\\n<|", "x"),
        (4, 0, "user", ""), (5, 0, None, "x\ny"), (6, 0, "assistant", "same"), (6, 0, "assistant", "same"), (7, 0, "assistant", "long " * 100_000),
    ]
    rows = {r.conv_id: r for r in chat.format_conversations(linear(spark, turns)).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(linear(spark, turns))).collect()}
    by = {}
    for t in sorted(turns, key=lambda t: (str(t[0]), t[1] is None, t[1] or 0, t[2] or "")):
        by.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    assert set(rows) == set(by)
    for conv, want in by.items():
        assert chat.parse(rows[conv].formatted) == want
        learned = "".join(t for r, t in want if r == "assistant")
        assert "".join(chat.unescape(rows[conv].formatted[s.start:s.end]) for s in rows[conv].loss) == learned
        assert (back[conv].n_turns, back[conv].loss_chars, back[conv].formatted_chars) == (len(want), len(learned), len(rows[conv].formatted))
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert rows[conv].formatted.count(chat.START) == rows[conv].formatted.count(chat.END) == len(want)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(chat.chained(empty))).count() == 0


def test_branches_of_trees_are_ranked(spark):
    rows = [
        (1, 10, None, 1.0), (1, 11, 10, 5.0), (1, 12, 10, 1.0), (1, 13, 12, 4.5), (1, 14, 13, None),  # 10-12-13-14 has 6.5, 10-11 has 6
        (2, 20, None, 0.0), (2, 21, 20, 0.0), (2, 22, 20, 0.0), (2, 23, 22, 0.0),  # ties: the longest
        (3, 30, 999, 0.0), (3, 31, 30, 0.0), (3, 32, 30, 0.0),  # unknown parent: a root; ties: the largest leaf
        (4, 40, 41, 9.0), (4, 41, 40, 9.0), (4, 42, None, 0.0), (5, 50, 50, 1.0),  # cycles are left out
    ]
    messages = spark.createDataFrame([(c, n, p, "user", "t", s) for c, n, p, s in rows], MESSAGES)
    got = {r.node: r.depth for r in chat.branches(messages).collect()}
    assert got == {10: 1, 12: 2, 13: 3, 14: 4, 20: 1, 22: 2, 23: 3, 30: 1, 32: 2, 42: 1}


def test_random_trees_against_recursion(spark):
    rng = random.Random(12)
    rows, base = [], 0
    for conv in range(15):
        n = rng.randrange(1, 40)
        rows += [(conv, base + i, base + rng.randrange(max(0, i - 3), i) if i else None, "user", "t", float(rng.randrange(4))) for i in range(n)]
        base += n
    parent, score = {r[1]: r[2] for r in rows}, {r[1]: r[5] for r in rows}

    def path(node):
        return [] if node is None else [*path(parent[node]), node]

    want = {}
    for conv in range(15):
        nodes = [r[1] for r in rows if r[0] == conv]
        leaves = [x for x in nodes if x not in parent.values()]
        best = max(leaves, key=lambda x: (sum(score[y] for y in path(x)), len(path(x)), x))
        want |= {x: i + 1 for i, x in enumerate(path(best))}
    got = {r.node: r.depth for r in chat.branches(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert got == want


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "Hello world", "it's we'll  two  spaces\n\n\ttab ", "été über 北京市 日本語テキスト", "👩‍👩‍👧 emoji 🤷🏽", "a" * 400, "ab" * 150 + "é" * 60, "1234567 ٣٤٥ ½",
    "<|endoftext|> <|im_start|>", "\x00\x01\x7f\x85\xa0 ", "x" * 33 + " " + "y" * 70, "the the the the " * 300, "!!??..--==", "\U0010ffff", "Ⅷ ǅ ß ﬁ",
]


@pytest.mark.parametrize("head", [0, 3, 1_000_000])
def test_bpe_as_the_tokenizer_library(spark, ranks, tokenizer, head):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, word string, n int")
    encoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, head), ranks)
    rows = encoded.collect()
    shas = {r.doc_id: r for r in bpe.digests(encoded, ranks).collect()}
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id % len(TEXTS)] or ""
        want = tokenizer.encode_ordinary(text)
        assert r.ids == want, text[:40]
        assert bytes(r.bytes) == text.encode()
        told = shas[r.doc_id]
        assert (told.n_tokens, told.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert told.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.word, r.n) == ("x", 1)
    at_once = bpe.encode(docs, ranks, public_tokenizers.PATTERN, head, reader=bpe.decoder(spark, ranks))
    assert at_once.columns == encoded.columns and sorted(at_once.collect()) == sorted(rows)
    told = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, head, reader=bpe.digester(spark, ranks))
    assert {r.doc_id: r for r in told.collect()} == shas


def test_dictionary_finds_words_and_numbers_the_rare_ones_inside_their_text():
    known = {f"w{i}": list(range(i, 2 * i)) for i in range(1, 300)}
    packed = [np.array(x, np.int32).tobytes() for x in known.values()]
    table = pa.table([pa.array(list(known)), pa.array(packed, pa.binary())], names=["word", "ids"])
    for entries in (table, table.slice(0, 0)):
        dictionary = pickle.loads(pickle.dumps(bpe.Dictionary(entries)))
        held = dict(list(known.items())[:len(entries)])
        asked = ["w7", "", "é", "w299", "w300", "w1"]
        assert [int(x) for x in dictionary.find(asked)] == [list(held).index(w) if w in held else -1 for w in asked]
        texts = ["w3 x w299 y x", None, "", "y w2 w2 z y", "w5"]
        ids, rare = bpe.looked_up(texts, str.split, dictionary)
        for text, got, names in zip(texts, ids.to_pylist(), rare.to_pylist(), strict=True):
            missing = iter([x for x in got if x < 0])
            words = (text or "").split()
            assert sorted(names) == sorted({w for w in words if w not in held})
            assert got == [x for w in words for x in (held[w] if w in held else [next(missing)])]
            assert [names[-1 - x] for x in got if x < 0] == [w for w in words if w not in held]


def test_splitting_spelled_out_is_the_pattern():
    import regex

    split, fast = regex.compile(public_tokenizers.PATTERN).findall, bpe.splitter(public_tokenizers.PATTERN)
    for cp in [*range(0, 0xD800, 3), *range(0xE000, 0x11000), *range(0x1F000, 0x1F800)]:
        c = chr(cp)
        text = f"a{c}b 1{c}2 !{c}! {c} {c}{c}x'll"
        assert fast(text) == split(text), hex(cp)


def test_words_of_equal_pairs_and_a_small_plan(spark, ranks, tokenizer):
    words = ["a", "aa", "aaaaaaa", "abababab", " the", "Ā", "é" * 9, "\x00\xff", "🙂🙂🙂", "zqxjzqxj" * 6]
    encoded = spark.createDataFrame([(w,) for w in words], "word string").select("word", bpe.encode_word(F.col("word"), ranks).alias("ids"))
    assert all(r.ids == tokenizer._encode_single_piece(r.word) for r in encoded.collect())
    literal = spark.range(1).select(bpe.rank_literal(ranks).alias("maps"))
    assert len(literal._jdf.queryExecution().optimizedPlan().toString()) < 1_500_000


def test_pieces_of_rows_stand_behind_each_other():
    pieces = [b"", b"a", "\u00e9".encode(), b"\xff\x00"]
    rows = [[], [1, 2, 3, 3], [], [0], [2, 1]]
    some = pa.array([[3, 3], *rows, [1]], pa.list_(pa.int32())).slice(1, len(rows))
    for ids in (some, some.slice(0, 0), some.slice(0, 1)):
        joined = bpe.Pieces(pieces).joined(ids)
        want = [b"".join(pieces[i] for i in row) for row in ids.to_pylist()]
        assert joined.to_pylist() == want
        assert bpe.sha256s(joined).to_pylist() == [hashlib.sha256(x).hexdigest() for x in want]
        assert bpe.sha256s(joined, 1).to_pylist() == [hashlib.sha256(x[:-1]).hexdigest() for x in want]


def test_driver_gives_memory_back_once_the_dictionary_is_written(spark, ranks, monkeypatch):
    calls = []
    empty = pa.table({"word": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})
    monkeypatch.setattr(bpe, "dictionary", lambda *_: calls.append("dictionary") or empty)
    monkeypatch.setattr(bpe, "give_back", lambda: calls.append("give back"))
    monkeypatch.setattr(bpe.Dictionary, "__getstate__", lambda _: calls.append("written") or b"")
    bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ranks, public_tokenizers.PATTERN)
    assert calls == ["dictionary", "written", "give back"]


def test_bpe_of_an_empty_table(spark, ranks):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, ranks, public_tokenizers.PATTERN).count() == 0


def test_the_dictionary_is_written_by_a_plan_that_is_told_once(spark, monkeypatch):
    ranks, seen, write, size = {bytes([i]): i for i in range(256)}, {}, bpe.settle, "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(bpe, "settle", lambda df, name: seen.update({name: spark.conf.get(bpe.ADAPTIVE)}) or write(df, name))
    docs = spark.createDataFrame([(1, "a b a b"), (2, None), (3, "\u00e9 a")], "doc_id long, text string")
    before, adaptive = spark.conf.get(size), spark.conf.get(bpe.ADAPTIVE)
    try:
        spark.conf.set(bpe.ADAPTIVE, "true")
        got = {r.doc_id: r.ids for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN, batch_bytes=1 << 16).collect()}
        assert got == {1: list(b"a b a b"), 2: [], 3: list("\u00e9 a".encode())}
        assert seen == {"words": "true", "dictionary": "false"}
        assert (spark.conf.get(bpe.ADAPTIVE), spark.conf.get(size)) == ("true", str(1 << 16))
    finally:
        spark.conf.set(size, before), spark.conf.set(bpe.ADAPTIVE, adaptive)


def test_frequent_words_stay_within_the_head(spark):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(1, 200)] + [("long" * 20, 999)], "word string, n long")
    for head in (1, 10, 50, 500):
        got = [r.n for r in bpe.frequent_words(words, head).collect()]
        assert len(got) <= head and 999 not in got
        if got:
            assert sorted(got) == list(range(min(got), 200))
    assert bpe.frequent_words(words, 500).count() == 198  # a word that stands once is no entry


def page(html):
    return html_extract.main_text(html, json.dumps(html_extract.shape(html)), None)


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("just &lt;text&gt;", "just <text>"), ("<p>a<p>b</p>c", "a\nb\nc"),
    ("<article><h1>T</h1><p>One <b>two</b><br>three</p><nav>m</nav></article>", "T\nOne two three"),
    ("<html><body><header><h1>Site</h1></header><main><article><header><h1>T</h1><p>by</p></header><p>x</p><aside>no</aside></article></main></body>", "T\nx"),
    ("<article><p>x<!-- <p>no</p> --><script>var a='</p>';</script>y</p></article>", "xy"),
    ("<article><ul><li>i<li>j</ul><table><tr><td>a<td>b</table></article>", "i\nj\na\nb"),
    ("<div class='post-content'><p>hello<div class=cookie-notice>c</div><form>f</form></div>", "hello"),
    ("<article>a&nbsp;&amp;&#x41;&#66;\n\n b<section id='comments'><p>c</p></section></article><div class='sidebar'>s</div>", "a &AB b"),
    ("<article><p title='a>b' class=\"x'y\">q</p><p>z < 3 > 2</p></article>", "q\nz < 3 > 2"),
    ("<article><p>a</b></div></p><p>b</article><footer>f", "a\nb"), ("<nav>only</nav><script>x", ""), ("<!DOCTYPE html><title>t</title><p>x", "x"),
])
def test_main_text_of_a_page(html, text):
    assert page(html) == text


@pytest.mark.parametrize("code", ["for(i=0;i<n;i++){f()}", "var s='<!--'", "var s=\"<a href='\";"])
@pytest.mark.parametrize("name", ["script", "STYLE", "textarea", "title", "iframe", "noscript"])
def test_raw_text_ends_at_its_end_tag(name, code):
    assert page(f"<{name} id=x>{code}</{name.lower()} ><article><p>A<{name}>{code}</{name}>B</p></article>") == "AB"
    assert page(f"<svg><title/><style/></svg><article>A<object><{name}></object>{code}</{name}>no</object>B</article>") == "AB"


@pytest.mark.parametrize(("html", "text"), [
    ("<article><h2 id='related-work'>Related</h2><h2 id=search-algorithms>S</h2><p>x <a id=social>y</a></p></article>", "Related\nS\nx y"),
    ("<article><section id='social-impact'><p>x</p></section><section id=comments><p>c</p></section></article>", "x"),
    ("<div class='page with-sidebar'><article><p>x</p></article></div>", "x"), ("<div class='page with-sidebar'><p>x</p></div>", "x"),
    ("<div class='container right-sidebar'><div class=sidebar-wrapper>s</div><article>x</article></div>", "x"),
    ("<div class='container right-sidebar'><p>x</p><div class=right-sidebar>s</div></div>", "x"),
    ("<form><nav>m</nav><main><h1>T</h1><p>x</p><form>f</form><aside><article>t</article></aside></main></form>", "T\nx"),
    ("<div id=search><div class=banner>b</div><article><p>x</p><div class=ad>a</div></article></div>", "x"),
    ("<p>A long text of the page</p><div class=related><article>teaser</article></div><form><p>f", "A long text of the page"),
    ("<main>x</main><div class=related><article>a longer teaser</article></div>", "x"),
    ("<div class=comments><article class=comment>c</article></div><nav><article>n</article></nav>", ""),
])
def test_words_do_not_hide_articles(html, text):
    assert page(html) == text


def test_the_host_confirms_words(spark):
    body = "<article><p>Text {0}</p><section id=social-{1}>{0} likes</section></article>"
    rows = [(i, f"http://{h}.org/{i}", body.format(i, w or ["impact", "theory", "order"][i])) for h, w in (("same", "counts"), ("other", None)) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.url[7:11], r.page_id): r.text for r in html_extract.extract(pages).collect()}
    assert got == {(h, i): f"Text {i}" + f"\n{i} likes" * (h == "othe") for h in ("same", "othe") for i in range(3)}


def test_texts_of_most_pages_go_also_within_an_article(spark):
    box = "<div><h3>Stay informed</h3><p>Get our letter every week</p></div>"
    rows = [(i, f"http://box.org/{i}", f"<article><h1>Title {i}</h1><p>{f'Words about {i}. ' * 9}</p>{box * (i < 3)}<p>End {i}</p></article>") for i in range(4)]
    rows += [(10 + i, f"http://copies.org/{i}", f"<article><h1>Copied</h1><p>{'The same words. ' * 9}</p><p>Edit {i}</p></article>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Title {i}\n{f'Words about {i}. ' * 9}".strip() + f"\nEnd {i}" for i in range(4))
    assert all(got[10 + i] == f"Copied\n{'The same words. ' * 9}".strip() + f"\nEdit {i}" for i in range(4))


def test_shapes_fold_repeats_and_wrappers_hold_options():
    a = html_extract.shape("<article><h1>t</h1><p>1</p><p>2</p></article><dl><dt>a<dd>b<dt>c<dd>d</dl>")
    assert a == [["1", "article", [["1", "h1", [["1", "#", []]]], ["+", "p", [["1", "#", []]]]]], ["1", "dl", [["+", "", [["1", "dt", [["1", "#", []]]], ["1", "dd", [["1", "#", []]]]]]]]]
    b = html_extract.shape("<article><h1>t</h1><div class=ad>x</div><p>1</p></article>")
    both = html_extract.align(html_extract.shape("<article><h1>t</h1><p>1</p><p>2</p></article>"), b)
    assert both == [["1", "article", [["1", "h1", [["1", "#", []]]], ["?", "div-", [["1", "#", []]]], ["+", "p", [["1", "#", []]]]]]]
    assert html_extract.align(both, both) == both


def test_pages_of_hosts(spark):
    body = "<html><body><div>Brand</div><div><a href=/>Home</a> <a href=/x>All of it</a></div>{}<div>All rights reserved</div></body></html>"
    rows = [(i, f"http://plain.org/{i}", body.format(f"<p>Text {i} of the page</p>" + "".join(f"<p>More {i} {k}</p>" for k in range(i % 3)))) for i in range(6)]
    rows += [(10, "https://News.example/a", "<article><p>A</p></article>"), (11, "https://news.example/b", "<div>ad</div><article><p>B</p><p>C</p></article>")]
    rows += [(12, None, None), (13, "not a url", "<p>x</p>"), (13, "not a url", "<p>x</p>"), (None, "http://one.org/", "<p>" * 3000 + "deep")]
    rows += [(14, "http://deep.org", "<div>" * 500 + "inside" + "</div>" * 500)]
    pages = spark.createDataFrame([(*r, "h", "w") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    for bucket in (2, 32):
        wrappers = html_extract.infer_wrappers(pages, bucket).collect()
        assert len(wrappers) == len({w.host for w in wrappers}) == 5
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages).collect()), key=str)
    want = [(i, u, t, len(t)) for i, u, t in [
        *((i, f"http://plain.org/{i}", "\n".join([f"Text {i} of the page", *(f"More {i} {k}" for k in range(i % 3))])) for i in range(6)),
        (10, "https://News.example/a", "A"), (11, "https://news.example/b", "B\nC"), (12, None, ""), (13, "not a url", "x"), (13, "not a url", "x"),
        (None, "http://one.org/", "deep"), (14, "http://deep.org", "inside")]]
    assert got == sorted(want, key=str)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_extracted_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", html[r.page_id], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        plain = [" ".join(html_extract.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in plain if b)
