"""Cross-tokenizer alignment, ranked search and URL filters against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from functools import cache
from itertools import combinations

import numpy as np
import pytest

from vanemesh.llm import lexical_search, token_align, url_filter
from vanemesh.llm.queries import A_VOCABULARY, B_VOCABULARY, URL_RULES

TEXTS = [
    (1, "Plain words, and some more words."), (2, None), (3, ""), (4, " leading and  double  blanks \n\n\tand tabs"), (5, "<|endoftext|> <s> <0x41> plain"),
    (6, "naïve café 数学 🙂🙂 \U0001f469‍\U0001f4bb"), (7, "a▁b"), (None, "Plain words, and some more words."), (1, "Plain words, and some more words."),
    (8, "x" * 30_000), (9, "long text of words " * 4000), (10, "\r\n\x00\x7f"), (11, " "), (12, "数学" * 500),
]


@cache
def models():
    return token_align.Tokenizers.load(A_VOCABULARY, B_VOCABULARY)


def expected_alignment(texts):
    """Positions byte by byte, without any of the operator's parts but the encoders."""
    m, found, counts = models(), [], Counter()
    for doc_id, text in texts:
        [(a, b)] = [[x.tolist() for x in ids] for ids in m.encode([text or ""])]
        ends = []
        for ids, pieces in ((a, m.bytes_a), (b, m.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(pieces[i]), i))
                at = own[-1][1]
            ends.append(own)
        cuts = sorted({x[1] for x in ends[0]} & {x[1] for x in ends[1]})
        shared, halves = set(cuts), []
        for own in ends:
            open_, closed = [], []
            for _, e, i in own:
                open_.append(str(i))
                if e in shared:
                    closed.append(",".join(open_))
                    open_ = []
            halves.append(closed)
        groups = [f"{x}|{y}" for x, y in zip(*halves, strict=True)]
        links, j = [], 0
        for s, e, x in ends[0]:
            while j and ends[1][j - 1][1] > s:
                j -= 1
            while j < len(ends[1]) and ends[1][j][0] < e:
                if ends[1][j][1] > s:
                    links.append((x, ends[1][j][2]))
                j += 1
        found.append((doc_id, a, b, cuts, groups, links))
        counts.update(set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for doc_id, a, b, cuts, groups, links in found:
        yield (doc_id, len(a), len(b), len(cuts), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) else "")


@pytest.mark.parametrize("head", [token_align.HEAD, 50, 1])
def test_alignment_against_byte_positions(spark, head):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS a", "'x' AS n_a").repartition(3)
    got = token_align.score(token_align.align(docs, models()), token_align.Sizes.of(models()), head).collect()
    want = list(expected_alignment(TEXTS))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if head == 50:
        read = {r.doc_id: r for r in token_align.tokens(token_align.align(docs.where("doc_id > 2"), models()), token_align.Sizes.of(models())).collect()}
        for doc_id, text in TEXTS[3:7]:
            [(a, b)] = models().encode([text])
            assert (read[doc_id].a, read[doc_id].b) == (a.tolist(), b.tolist())
            assert (sum(read[doc_id].in_a), sum(read[doc_id].in_b)) == (len(a), len(b))
    assert {tuple(r)[1:] for r in got if r.doc_id in (2, 3, 7)} == {(0, 0, 0, 0, 0, 0, "")}


def test_encoders_give_the_bytes_back():
    m = models()
    for _, text in TEXTS:
        a, b = next(m.encode([text or ""]))
        for ids, pieces in ((a, m.bytes_a), (b, m.bytes_b)):
            assert b"".join(pieces[i] for i in ids) in (b"", b" " + (text or "").encode())


def test_words_of_a_text_are_encoded_like_the_text(monkeypatch):
    m = token_align.Tokenizers.load(A_VOCABULARY, B_VOCABULARY)
    texts = [t for _, t in TEXTS if t] + ["It's  we'll 3²x\n\n y \t<|endoftext|>é÷×", "à1½ª º"]
    want = [e.ids for e in m.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    for kept in (token_align.KEPT, 3):
        monkeypatch.setattr(token_align, "KEPT", kept)
        for _ in range(2):
            assert [a.tolist() for a in m.encode_a(texts)] == want


def test_stretches_are_encoded_once_and_like_the_text(monkeypatch):
    rng = random.Random(4)
    letters = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x100)), *"etaoin" * 40, *"\n\t\r" * 4]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(400)] + ["a\n", "\n", "", "b\n\n", "<s>", "<unk>", "<|endoftext|>", "'s"]
    texts = [" ".join(rng.choices(words if i % 2 else [w for w in words if w[:1].strip()], k=rng.randint(1, 60))) for i in range(200)]
    texts += [t for _, t in TEXTS if t]
    want = list(token_align.Tokenizers(*models().files).encode_whole(texts))
    m, whole = token_align.Tokenizers(*models().files), []
    one_by_one = m.encode_whole
    m.encode_whole = lambda x: whole.extend(x) or one_by_one(x)
    for kept in (token_align.KEPT, 300):
        monkeypatch.setattr(token_align, "KEPT", kept)
        for at in range(0, len(texts), 20):
            for own, other in zip(m.encode(texts[at:at + 20]), want[at:at + 20], strict=True):
                assert [x.tolist() for x in own] == [x.tolist() for x in other]
    assert m.apart and not m.strange and not {t for t in texts[:200:2] if " " in t} & set(whole)
    monkeypatch.undo()
    whole.clear()
    list(m.encode(["pear fig"] * 9 + ["fig pear apple"])), list(m.encode(["apple pear"]))
    assert len(whole) == 1 and sorted(whole[0].split(" ")) == ["apple", "fig", "pear"]


def test_a_stretch_whose_bytes_differ_leaves_only_its_texts_out():
    spoilt = token_align.Tokenizers(*models().files)
    spoilt.bytes_b[spoilt.b.piece_to_id("▁x")] = b"y"
    spoilt.bytes_a[spoilt.a.token_to_id("Ġx")] = b"y"
    assert [len(a) > 0 for a, _ in spoilt.encode(["x", "a plain text", "text x plain", "plain text"])] == [False, True, False, True]
    assert spoilt.strange == {"x"}


def test_groups_of_random_ends():
    rng = random.Random(3)
    for _ in range(300):
        at, all_a, all_b, n_a, n_b, cuts = 0, [], [], [], [], []
        for _ in range(rng.randint(0, 6)):
            last = rng.randint(0, 60)
            a, b = (sorted({*rng.sample(range(1, last + 1), rng.randint(0, last)), last}) if last else [] for _ in range(2))
            shared = sorted(set(a) & set(b))
            for whole, own in ((all_a, a), (all_b, b), (cuts, shared)):
                whole += [at + x for x in own]
            n_a.append(len(a)), n_b.append(len(b))
            at += last
        a, b, n_a, n_b = (np.array(x, np.int64) for x in (all_a, all_b, n_a, n_b))
        in_a, in_b = token_align.shared_cuts(a, b, n_a, n_b)
        assert a[in_a].tolist() == b[in_b].tolist() == cuts


def test_small_intervals_are_compared_at_once(monkeypatch):
    rng, rounds, halve = np.random.default_rng(5), [], token_align.shared_ends
    monkeypatch.setattr(token_align, "shared_ends", lambda *x: rounds.append(len(x[2])) or halve(*x))
    n = 4096
    token_align.shared_cuts(np.arange(n), np.arange(n), np.array([n]), np.array([n]))
    assert sum(rounds) < 100  # 4095 if every interval is halved
    ends = [np.append(np.flatnonzero(rng.random(3000) < share), 3000) for share in (0.3, 0.4)]
    for few in (1, 5, 64):
        monkeypatch.setattr(token_align, "FEW", few)
        in_a, in_b = token_align.shared_cuts(*ends, *(np.array([len(x)]) for x in ends))
        assert ends[0][in_a].tolist() == ends[1][in_b].tolist() == np.intersect1d(*ends).tolist()


def test_texts_that_need_no_comparison_are_those_that_pass_it():
    texts = [t or "" for _, t in TEXTS] + ["a  b \n", "\t", " ", "é÷×"]
    m, compared = models(), token_align.Tokenizers(*models().files[:2], False)
    assert m.faithful and not m.odd
    for own, other in zip(m.encode(texts), compared.encode(texts), strict=True):
        assert [x.tolist() for x in own] == [x.tolist() for x in other]
    spoilt = token_align.Tokenizers(*models().files)
    spoilt.bytes_a[spoilt.a.token_to_id("Ġx")] = b"y"
    assert [len(a) for a, _ in spoilt.encode(["x", "plain"])] == [len(a) for a, _ in m.encode(["", "plain"])]


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.score(token_align.align(empty, models()), token_align.Sizes.of(models())).count() == 0


def expected_ranking(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(i, Counter(split(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    for item, text in items:
        found = []
        for doc_id, c in terms:
            score = 0
            for t in set(split(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * sum(c.values()) * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(found)[:k], 1):
            yield item, rank, None if null else doc_id, -score


@pytest.mark.parametrize("k,size", [(10, 8192), (3, 7)])
def test_ranking_against_all_scores(spark, monkeypatch, k, size):
    monkeypatch.setattr(lexical_search, "DOCS", size)
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["Éa", "éa", "ÀB", "the"]
    pick = lambda n: " ".join(rng.choice(words[:rng.randint(1, len(words))]) for _ in range(n))
    docs = [(i, pick(rng.randint(0, 60))) for i in range(300)] + [(5, "the W1 w2"), (5, "the W1 w2"), (None, "the w1, w2"), (None, None), (900, ""), (901, "..."),
                                                                (902, "w3 " * 50_000)]
    items = [(i, pick(rng.randint(1, 20))) for i in range(6)] + [(7, None), (8, "?"), (9, "the the THE"), (9, "the the THE"), (None, "w1"), (10, " ".join(words)), (11, "unseen")]
    got = lexical_search.rank(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item", "3 AS n").repartition(3),
        spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS item"), k)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected_ranking(docs, items, k), key=str)


def test_ranking_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{x}_id long, text string") for x in ("doc", "item"))
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.rank(docs, items).count() == lexical_search.rank(docs, one).count() == 0


def test_overflow_is_left_to_whole_numbers():
    stats = lexical_search.Statistics(10**12, 10**14, np.array([1]))
    tf, n = np.array([3, 10**10]), np.array([10**8, 10**8])
    assert list(lexical_search.impacts(tf, n, stats)) == [(10**9 * int(t)) // (1000 * int(t) + 8 * (10 + (90 * 10**8 * 10**12) // 10**14)) for t in tf]


URLS = [
    (1, "http://www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/"), (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"),
    (3, "ftp://notexample.com/en/x?q=/fr/", "notexample.com", "/en/x", "com/"), (4, "x://b.net/es/#frag", "b.net", "/es/", "net/es/"),
    (5, "x://net/fr/..", "net", "/fr/..", "net/fr/"), (6, "x://b.net/esp", "b.net", "/esp", None), (7, "http://example.com", "example.com", "", None),
    (8, None, "", "", None), (9, "no scheme.com/", "", "", None), (10, "", "", "", None), (11, "a://b://c.com/x", "b:", "//c.com/x", None),
    (12, "http://É.com/?", "É.com", "/", "com/"), (13, "http://com?x", "com", "", None), (14, "http://x.COM/" + "y/" * 20_000, "x.com", "/" + "y/" * 20_000, "com/"),
    (14, "http://x.com/\nz", "x.com", "/\nz", "com/"), (15, "http://EXAMPLE.com/en/#?", "example.com", "/en/", "example.com/en/"),
]


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u, *_ in URLS], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS _tokens")
    got = url_filter.judge(pages, URL_RULES, url_filter.Mined([])).collect()
    verdicts = {r.text: r.verdict for r in URL_RULES}
    assert sorted(map(str, ((r.page_id, r.url, r.host, r.path, r.rule) for r in got))) == sorted(map(str, URLS))
    assert all(r.verdict == verdicts.get(r.rule, "allow") and r._tokens == 3 for r in got)
    assert url_filter.judge(pages.limit(0), [], url_filter.Mined([])).count() == 0


def brute_rules(rows, support, confidence):
    """Every combination of tokens of any row, counted one by one."""
    n, seen, with_label = len(rows), Counter(), Counter()
    for tokens, label in rows:
        for size in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), size):
                seen[some] += 1
                with_label[some, label] += 1
    return {(some, label): (k / seen[some], k / n) for (some, label), k in with_label.items()
            if k / n >= max(support, url_filter.LEAST_ROWS / n) and k / seen[some] >= confidence}


def test_mined_rules_against_all_combinations(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        host, lang = rng.choice(["a.org", "spam.org", "b.org"]), rng.choice(["en", "fr"])
        rows.append((f"http://{host}/{lang}/{i}", "block" if (host == "spam.org" and lang == "fr") or rng.random() < 0.05 else "allow"))
    odd = [(None, "block"), ("http://a.org/en/1", None), ("http://a.org/en/1", "other"), ("none", "block")]
    labelled = spark.createDataFrame(rows + odd, "url string, label string").selectExpr("*", "1 AS row", "2 AS items")
    mined = url_filter.mine(labelled)
    chosen = [(r["items"][:-1], r["items"][-1][len(url_filter.LABEL):]) for r in url_filter.transactions(labelled).collect()]
    assert max(len(t) for t, _ in chosen) <= url_filter.MOST
    every = brute_rules(chosen, url_filter.SUPPORT, url_filter.CONFIDENCE)
    want = {(t, label) for (t, label), (c, _) in every.items()
            if not any(l2 == label and set(s) < set(t) and c2 >= c for (s, l2), (c2, _) in every.items())}
    assert {(r[0], r[1]) for r in mined.rules} == want
    for tokens, label, confidence, support in mined.rules:
        assert every[tokens, label] == pytest.approx((confidence, support))
    urls = [(0, "http://x.spam.org/fr/9"), (1, "http://spam.org/en/9"), (2, "http://a.org/fr/7"), (3, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), [], mined).collect()}
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "allow", "allow"]
    assert "host=spam.org" in got[0].mined and "path=fr" in got[0].mined and got[3].mined is None
    for i, url in urls[:3]:
        tokens = set(spark.createDataFrame([(url,)], "u string").select(url_filter.tokens(url_filter.F.col("u")).alias("t")).first().t)
        fits = [r for r in mined.rules if set(r[0]) <= tokens]
        assert mined.best(sorted(tokens)) == (mined.rules.index(fits[0]) if fits else None)


def test_nothing_to_mine(spark):
    assert url_filter.mine(spark.createDataFrame([], "url string, label string")).rules == []
