"""Each operator against a brute-force version, and on null, empty, tied, repeated and missing rows and clashing columns."""

import hashlib
import html as html_
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fotolith.llm import decontaminate, html_extract, queries
from fotolith.llm.chat_format import formatted_chats, read_back
from fotolith.llm.decontaminate import benchmark_matches
from fotolith.llm.exact_dedup import exact_duplicates
from fotolith.llm.html_extract import main_texts
from fotolith.llm.mixing import cumulative, mixed
from fotolith.llm.ngram_join import ngram_classes
from fotolith.llm.quality import scored, train
from fotolith.llm.substring_dedup import repeated_passages
from fotolith.llm.url_filter import url_verdicts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, row long, score double, n_words long, digest string"
ODD = [(1, "a b c d e a b c d"), (2, None), (3, ""), (None, "A b c d x"), (5, "a b c d e a B c d"), (5, "a b c d e a b c d"), (5, "a b c d e a b c d"), (7, "q q q q q q q"), (8, "one"), (4, "One"), (None, "a b c d x"), (9, "é\u00a0ö \x1c z" * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0.0, 0, "") for r in rows], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def key(r):
    return tuple((x is None, x or 0) for x in r)


def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("size", [32, 1])
def test_exact_dedup(spark, size):
    rows = ODD
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    got = exact_duplicates(frame(spark, rows), "max", digest_bytes=size).collect()
    assert len(got) == len(rows)
    want = sorted((d, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).digest()) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, bytes(r.sha)) for r in got if r.doc_id is not None) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_duplicates(frame(spark, [])).count() == 0


def brute_components(rows, n, share):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if o and 100 * o >= share * len(x | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None and (least[root[i]] is None or d < least[root[i]]):
            least[root[i]] = d
    return sorted(((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows))), key=key)


def test_ngram_join(spark):
    df, rows = documents(spark)
    group = [(1000 + k, " ".join(f"w{i}" if i != k else "other" for i in range(120))) for k in range(40)]  # near copies, some of which link through others only
    for given, n, share in ((rows + group, 3, 90), (ODD, 3, 90)):
        got = ngram_classes(frame(spark, given), n, share).select("doc_id", "n_grams", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == brute_components(given, n, share)
    assert ngram_classes(frame(spark, [])).count() == 0


def brute_passages(rows, size):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lost = [False] * len(w)
        for i in range(len(w) - size + 1):
            if (k := tuple(w[i : i + size])) in seen:
                lost[i : i + size] = [True] * size
            seen.add(k)
        kept = " ".join(x for x, gone in zip(w, lost, strict=True) if not gone)
        out.append((d, len(w), sum(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


def test_substring_dedup(spark):
    df, rows = documents(spark)
    odd = [r for r in ODD if r not in ((5, "a b c d e a B c d"), (None, "a b c d x"))]  # rows that tie in doc_id have an order of their own
    for given, size in ((rows, 20), (odd, 4)):
        got = repeated_passages(frame(spark, given), size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=key) == brute_passages(given, size)
    assert repeated_passages(frame(spark, []), 4).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    df, rows = documents(spark)
    rows = rows[:60] + ODD
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:10] + [(91, "one"), (91, "C d e"), (None, "x"), (92, None), (93, rows[3][1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in tests:
        w = words(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add("null" if i is None else str(i))
    want = []
    for d, t in rows:
        w = words(t)
        hit, items = [False] * len(w), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if found := windows.get(tuple(w[j : j + k])):
                    items |= found
                    hit[j : j + k] = [True] * k
        want.append((d, len(w), sum(hit), sorted(items)))
    got = benchmark_matches(frame(spark, rows), spark.createDataFrame(tests, "item_id long, text string")).select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("matches.item"))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert benchmark_matches(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).filter("n_hit > 0").count() == 0


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from fotolith.llm.token_count import token_counts

    rng = np.random.default_rng(0)
    signs = list(" \n\t'srevmltdaZé1²,.!\u3000中\x1c\r\u00a0") + ["<|endoftext|>", "😀"]
    texts = [None, "", "<|endoftext|>", "x" * 2000, "ab1" * 500, "I'll we've 'tis '''s they're", *("".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000))]
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = token_counts(frame(spark, list(enumerate(texts))), public.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert [r.n_bytes for r in got] == [len((x or "").encode()) for x in texts]
    assert token_counts(frame(spark, []), public.path("byte_bpe_50k.json")).count() == 0


def test_chat_formatting(spark):
    rows = [(1, 0, "us\ner~1", "<|x<\\|y<\\\\|"), (1, 1, "assistant", "<<|im_end|>\n<|im_start|>"), (None, None, None, None), (None, 2, "assistant", "é\n<\\|"), (1, None, "assistant", ""), (2, 0, "assistant", "same"), (2, 0, "assistant", "same")]
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    want = []
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [tuple(r)[:5] for r in read_back(formatted_chats(df)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert formatted_chats(df.limit(0)).count() == 0


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html_.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
    odd = [(1, "http://a/x", "<main><h1>T &lt;x&gt;</h1><p>a\n b<p>c<div class='comments'><p>no</div><form><p>no</form></main><footer>f", 1), (2, None, None, 1), (3, "x", "", 1), (4, "http://a/y", "plain <b>text", 1), (4, "http://a/y", "plain <b>text", 1), (5, "http://b/", "<p>" * 3000 + "deep", 1), (6, "http://c/", "<div>" * 3000 + "down<nav>no</nav>" + "</div>" * 10 + "up", 1)]
    texts = main_texts(spark.createDataFrame(odd, "page_id long, url string, html string, text int")).orderBy("page_id").collect()
    assert [r.text for r in texts] == ["T <x>\n\na b\n\nc", "", "", "plain text", "plain text", "deep", "down\n\nup"]
    assert main_texts(pages.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in main_texts(df).orderBy("page_id").collect()]


def test_html_wrapper_decides_inside_articles(spark):
    notice = "<p>All rights of this text are kept.</p>"
    pages = [("http://a/", f"<div>Home</div><article><h1>Title {k}</h1><p>First story of {k}.</p>{notice}<p>It goes on for {k}.</p><div>Get our letter</div></article>") for k in range(6)]
    pages += [("http://b/", f"<div>Home</div><div class='story'>A long story that varies from page to page, here {k}.</div><article>Card {k}</article>") for k in range(6)]
    pages += [("http://c/", f"<article><p>Near copies share this long paragraph.</p><p>Part {k}</p></article>") for k in range(4)]
    want = [f"Title {k}\n\nFirst story of {k}.\n\nIt goes on for {k}." for k in range(6)]
    want += [f"A long story that varies from page to page, here {k}.\n\nCard {k}" for k in range(6)]
    want += [f"Near copies share this long paragraph.\n\nPart {k}" for k in range(4)]
    assert extracted(spark, pages) == want


@pytest.mark.parametrize("fanout", [128, 3])
def test_html_wrappers_of_all_pages(spark, monkeypatch, fanout):
    monkeypatch.setattr(html_extract, "FANOUT", fanout, raising=False)
    pages = [("http://a/", f"<div>Home</div><article><h1>Title {k}</h1><p>First story of {k}.</p></article>") for k in range(60)]
    pages += [("http://a/", f"<div>Home</div><article><h1>Title {k}</h1><p>Second story of {k}.</p><section id='s{k}'>Printed in our paper</section></article>") for k in range(60, 64)]
    pages += [("http://a/", f"<article><h1>Title {k}</h1><p>Story.</p></article><section class='{'abcdefgh'[k % 8] * k}'>Beside</section>") for k in range(64, 80)]
    want = [f"Title {k}\n\nFirst story of {k}." for k in range(60)] + [f"Title {k}\n\nSecond story of {k}." for k in range(60, 64)] + [f"Title {k}\n\nStory." for k in range(64, 80)]
    assert extracted(spark, pages) == want
    assert extracted(spark, pages[::-1]) == want[::-1]


def test_url_filters(spark):
    urls = [None, "abc", "http://X.NET", "a://b://c/d?e", "http://org/fr/x#y", "http://EXAMPLE.net/en/", "https://m.casino-win.example.com/en/1", "https://www.ththa.example.com/en/1", "http://a.example.com/de/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_verdicts(df, queries.URL_RULES).orderBy("page_id").collect()]
    assert got[:6] == [("", "", None, "allow"), ("", "", None, "allow"), ("x.net", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("org", "/fr/x", "org/fr/", "allow"), ("example.net", "/en/", "example.net/en/", "allow")]
    assert [g[3] for g in got[6:]] == ["block", "allow", "block"]
    assert url_verdicts(df.limit(0), queries.URL_RULES).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    weights = train(docs, labels.filter(~held).select("doc_id", F.col("quality").alias("label")))
    rows = scored(docs, weights).join(labels.filter(held), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows]) > 0.9
    odd = scored(frame(spark, ODD), weights)
    assert odd.count() == len(ODD) and odd.filter("score between 0 and 1").count() == len(ODD)
    none = train(frame(spark, ODD), labels.limit(0).select("doc_id", F.col("quality").alias("label")))
    assert not none.any() and scored(frame(spark, []), none).count() == 0


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixed(docs, {"src0": 0.5}, size=40.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 40 * docs.count()) < 6 * (40 * docs.count()) ** 0.5
    assert abs(n["src0"] / total - 0.5) < 0.02
    assert abs(cumulative(2.0)[1] - 3 * np.exp(-2)) < 1e-12
    tied = spark.createDataFrame([(None, None, None, 1), (1, "", "src0", 1), (1, "", "src0", 1)], "doc_id long, text string, source string, copy_no long")
    assert mixed(tied, {"src0": 0.5}, size=9.0).filter("source = 'src0'").count() % 2 == 0
    assert mixed(docs.limit(0), {"src0": 0.5}).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        kept = {r.doc_id for r in out.collect()}
        if name == "exact_dedup":
            first = {}
            for d, t in sorted(rows):
                first.setdefault(lower(t), d)
            assert kept == set(first.values())
        elif name == "ngram_jaccard_join":
            assert kept == {c if c is not None else d for d, _, c in brute_components(rows, 5, 80)}
        if name != "mixing_sources":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {"copy_no", "mix_key"} <= set(docs.columns)


def test_text_buffers():
    from fotolith.llm.words import SPACED, Words, text_buffer

    column = pa.array(["skipped", "a bc", None, "", " x" * 3], pa.large_string()).slice(1)
    w = Words(*text_buffer(column), SPACED, True)
    assert list(np.diff(w.first)) == [2, 0, 0, 3]
