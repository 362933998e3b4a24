"""The registered queries at the smallest scale: against their SQL, or against plain Python."""

import hashlib
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
import check_queries  # noqa: E402
from vanemesh.llm import mixing, quality  # noqa: E402
from vanemesh.llm.queries import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check_queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = check_queries.rows_of(df.columns, df.collect())
    cursor = con.execute(SQL[name])
    want = check_queries.rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    assert got and got == want


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stage_by_stage(spark, con, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = docs.collect()
        if name != "byte-level BPE":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    lowered = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    good = [r.doc_id for r in seen["quality classifier"]]
    judged = QUERIES["op7_quality_classifier"](spark, SF).where(f"score >= {quality.THRESHOLD}").collect()
    assert sorted(good) == sorted(r.doc_id for r in judged)
    last = {}
    for i in sorted(good):
        last[lowered(texts[i])] = i
    assert sorted(r.doc_id for r in seen["exact dedup"]) == sorted(last.values())
    from test_llm_join import expected

    groups = expected([(i, texts[i]) for i in last.values()])
    kept = sorted({component for _, n, component in groups if n} | {i for i, n, _ in groups if not n})
    assert sorted(r.doc_id for r in seen["n-gram Jaccard join"]) == kept
    counts = {}
    for r in seen["mixing sources"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= set(kept) and max(counts.values()) <= mixing.MAX_COPIES
    import public_tokenizers
    import tiktoken

    from vanemesh.llm import bpe

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    assert sorted(r.doc_id for r in seen["byte-level BPE"]) == sorted(i for i, n in counts.items() for _ in range(n))
    for r in seen["byte-level BPE"]:
        assert r.exact and r.ids == encoding.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_bpe_query(spark, con):
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op9_byte_bpe"](spark, SF).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_join_query(spark, con):
    from test_llm_join import expected

    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op3_ngram_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


@pytest.mark.parametrize("name", ["op2_document_fingerprints", "op4_mixing_sources", "op6_language_id", "op7_quality_classifier"])
def test_one_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 200


def test_alignment_query(spark, con):
    from test_llm_align_search import expected_alignment

    texts = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = [tuple(r) for r in QUERIES["op11_token_alignment"](spark, SF).collect()]
    assert sorted(got) == sorted(expected_alignment(texts))


def test_url_query(spark, con):
    from urllib.parse import urlsplit

    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    rows = QUERIES["op13_url_filters"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        parts = urlsplit(urls[r.page_id])
        assert (r.host, r.path) == (parts.netloc.lower(), parts.path)
        fits = [(len(h + p), v, h + p) for v, h, p in (
            ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
            if ("." + r.host).endswith("." + h) and r.path.startswith(p)]
        assert r.rule == (max(fits)[2] if fits else None)
        assert r.verdict == (max(fits)[1] if fits else r.mined.split(" -> ")[1] if r.mined else "allow")
