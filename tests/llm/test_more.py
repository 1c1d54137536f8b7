"""Brute force for scores, very long texts, hot groups, and every stage on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.llm import ngram_join, url_filter
from fotolith.llm.chat_format import formatted_chats, read_back
from fotolith.llm.decontaminate import benchmark_matches
from fotolith.llm.exact_dedup import DigestIndex, exact_duplicates
from fotolith.llm.html_extract import main_texts
from fotolith.llm.mixing import mixed
from fotolith.llm.ngram_join import ngram_classes
from fotolith.llm.quality import scored
from fotolith.llm.substring_dedup import repeated_passages
from fotolith.llm.url_filter import url_verdicts
from fotolith.llm.url_table import labelled_urls
from fotolith.llm.words import U, Words, constants, mix, text_buffer

from .test_operators import ODD, SF, brute_components, brute_passages, documents, frame, key, lower


def mixed_int(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def test_url_scores_equal_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    w = url_filter.train(labelled_urls())
    for r in url_verdicts(pages, []).collect():
        score = w[-1]
        for part, text, weight in ((0, f".{r.host}.".encode(), 1.0), (1, ("\n" + r.path).encode(), url_filter.PATH)):
            grams = []
            for size in url_filter.GRAMS:
                for i in range(len(text) - size + 1):
                    h = size
                    for b in text[i : i + size]:
                        h = mixed_int(h ^ b)
                    grams.append((h + part) % 2**64 % url_filter.DIMENSIONS)
            score += sum(w[g] for g in grams) * weight / max(1, len(grams)) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-score))) < 1e-9 and r.verdict == ("block" if r.score >= 0.5 else "allow")


def test_url_words_that_the_table_lacks(spark):
    from fotolith.llm.url_table import ALLOW, BLOCK

    out_b, out_a = BLOCK[::8], ALLOW[::8]
    known = labelled_urls([x for x in BLOCK if x not in out_b], [x for x in ALLOW if x not in out_a])
    left = [x for x in BLOCK if x not in out_b]
    beside = [(i, f"http://www.{a}-{left[5 * i % len(left)]}.example.com/en/{i}") for i, a in enumerate(out_b)]
    good = [(i, f"http://www.{a}-{b}.example.com/en/{i}") for i, (a, b) in enumerate(zip(out_a, reversed(out_a), strict=True))]
    blocked = lambda rows: url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), [], known).filter("verdict = 'block'").count()
    assert blocked(beside) >= 0.6 * len(beside) and blocked(good) <= 0.2 * len(good)


def test_quality_scores_equal_brute_force(spark):
    d = 1 << 12
    w = np.random.default_rng(1).normal(size=d + 1)
    df, rows = documents(spark)
    rows = rows[:80] + ODD
    word = lambda x: int(Words(*text_buffer(__import__("pyarrow").array([x])), np.ones(256, np.uint8), False).hash[0])
    got = {(r.doc_id, r.text): r.score for r in scored(frame(spark, rows), w).collect()}
    pattern = [int(c % U(d - 1)) + 1 for c in constants(11, 4)]
    for i, t in rows:
        words = [word(x) for x in re.findall(r"[A-Za-z\u0080-\U0010ffff]+|[0-9]+|[!-/:-@\[-`{-~]+", t or "")]
        counts = Counter(h % (d - 1) + 1 for h in words)
        counts.update(mixed_int(a * 0x9E3779B97F4A7C15 + b) % (d - 1) + 1 for a, b in zip(words, words[1:]))
        counts.update(pattern[k - 1] for k in range(1, 5) for a, b in zip(words, words[k:]) if a == b)
        total = sum(counts.values())
        s = sum(w[f] * (n / total) ** 0.5 for f, n in counts.items()) if words else w[0]
        assert abs(got[i, t] - 1 / (1 + np.exp(-np.clip(s + w[-1], -35, 35)))) < 1e-4


def test_long_columns_are_parted_by_second_ones(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 2)
    monkeypatch.setattr(ngram_join, "WIDEN", 2)
    rng = np.random.default_rng(3)
    # Texts that share a passage, too little to link, and pairs of near copies among them.
    rows = []
    for k in range(30):
        own = " ".join(f"v{x}" for x in rng.integers(0, 400, 6))
        rows += [(2 * k, "a b c d e f " + own), (2 * k + 1, "a b c d e f " + own + (" z" if k % 2 else " a b c"))]
    got = ngram_classes(frame(spark, rows), 2, 60).select("doc_id", "n_grams", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 2, 60)


def test_columns_of_the_same_rows_are_asked_once(spark, monkeypatch):
    asked, table = [], ngram_join.Scratch.table

    def noted(self, df, *more):
        out = table(self, df, *more)
        asked.extend([out.count()] if "asks" in df.columns else [])
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", noted)
    # Ten pairs of texts that share 174 n-grams of 198 each, too little to link; each pair shares some 16 of its first columns.
    rows = [(2 * k + i, " ".join(f"w{k}x{x}" if x < 176 else f"w{k}y{i}z{x}" for x in range(200))) for k in range(10) for i in range(2)]
    got = ngram_classes(frame(spark, rows), 3, 80).select("doc_id", "n_grams", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 80)
    assert sum(asked) <= 20


@pytest.mark.parametrize("edits, most", [(2, 9000), (4, 9000), (6, 9000)])
def test_a_large_group_is_dealt_out_in_proportion(spark, monkeypatch, edits, most):
    held, table = [], ngram_join.Scratch.table

    def noted(self, df, *more):
        out = table(self, df, *more)
        held.extend([out.count()] if {"col", "row", "place"} <= set(df.columns) else [])
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", noted)
    monkeypatch.setattr(ngram_join, "LONG", 8)
    monkeypatch.setattr(ngram_join, "WIDEN", 4)
    rng = np.random.default_rng(edits)
    # Near copies of one text with words put in, taken out and changed, about as similar as the bound.
    rows = []
    for k in range(80):
        words = [f"w{x}" for x in range(90)]
        for at in rng.integers(0, 80, edits):
            words[at : at + int(rng.integers(0, 3))] = [f"own{rng.integers(0, 40)}"][: int(rng.integers(0, 3))]
        rows.append((k, " ".join(words)))
    got = ngram_classes(frame(spark, rows), 3, 80).select("doc_id", "n_grams", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 80)
    assert sum(held) <= most


def test_columns_without_a_near_row_are_left_out(spark, monkeypatch):
    first, shared, table = [], [], ngram_join.Scratch.table

    def noted(self, df, *more):
        out = table(self, df, *more)
        if "first" in df.columns and "sketch" in df.columns:
            first.append(out.agg(F.sum(F.size("first"))).first()[0])
        elif {"col", "row", "place"} <= set(df.columns):
            shared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", noted)
    # Texts that share nothing: no column is dealt out. Then short texts that lie in long ones: their columns hold no two rows near by size.
    for rows in ([(k, " ".join(f"w{k}x{x}" for x in range(100))) for k in range(20)], [(2 * k + i, " ".join(f"w{k}x{x}" for x in range(20 + 20 * i))) for k in range(20) for i in range(2)]):
        got = ngram_classes(frame(spark, rows), 3, 80).select("doc_id", "n_grams", "component_id").collect()
        assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 80)
    assert first[0] == 0 and sum(shared) == 0


def test_index_of_several_batches(spark):
    rows = [(i, f"text {i % 37}" if i % 3 else f"T own {i}") for i in range(200)]
    index = DigestIndex(spark, "min", expected=200)
    index.insert(frame(spark, rows[:90]).select("doc_id", "text"))
    seen = {r.doc_id: r.first_id for r in index.seen(frame(spark, rows[90:]).select("doc_id", "text")).collect()}
    first = {}
    for d, t in rows[:90]:
        first.setdefault(lower(t), d)
    assert seen == {d: first[lower(t)] for d, t in rows[90:] if lower(t) in first}
    for k in range(90, 200, 22):
        index.insert(frame(spark, rows[k : k + 22]).select("doc_id", "text"))
    assert len(index.levels) > 2  # runs were merged over two levels
    whole = index.compact().rows
    n = Counter(lower(t) for _, t in rows)
    first = {}
    for d, t in rows:
        first.setdefault(lower(t), d)
    assert sorted((r.doc_id, r.n) for r in whole.collect()) == sorted((first[t], k) for t, k in n.items())


def test_hot_groups(spark):
    rows = [(i, "the same words in every one of them") for i in range(2500)] + [(5000 + i, f"text number {i} of its own") for i in range(40)]
    out = exact_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == 41 and {r.keep_id for r in out if r.group_size == 2500} == {0}
    classes = ngram_classes(frame(spark, rows), 3, 90).collect()
    assert len(classes) == len(rows) and {r.component_id for r in classes if r.doc_id < 5000} == {0}
    removed = repeated_passages(frame(spark, rows), 4).groupBy("n_removed").count().collect()
    assert dict(map(tuple, removed))[8] == 2499


def test_very_long_texts(spark):
    rng = np.random.default_rng(0)
    body = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 60_000))
    near = body.replace("w7 ", "w8 ", 3)
    rows = [(1, body), (2, near), (3, body), (4, body[: len(body) // 2]), (5, "x" * 300_000)]
    got = ngram_classes(frame(spark, rows), 3, 90).select("doc_id", "n_grams", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 90)
    got = repeated_passages(frame(spark, rows), 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=key) == brute_passages(rows, 20)
    assert sum(r.kept for r in exact_duplicates(frame(spark, rows)).collect()) == 4
    tests = spark.createDataFrame([(1, " ".join(body.split()[30_000:30_050]))], "item_id long, text string")
    hit = {r.doc_id: r.matches for r in benchmark_matches(frame(spark, rows), tests).filter("n_hit > 0").collect()}
    assert [m.words for m in hit[1]] == [50] and hit[1][0].word == 30_000 and 3 in hit
    assert scored(frame(spark, rows), np.zeros(1 << 10)).filter("score = 0.5").count() == 5
    said = spark.createDataFrame([(1, 0, "user", body), (1, 1, "assistant", body)], "conv_id long, turn long, role string, text string")
    r = read_back(formatted_chats(said)).first()
    assert r.loss_chars == len(body) and r.loss_sha256 == hashlib.sha256(body.encode()).hexdigest()
    url = "http://a.example.org/" + "long-path/" * 20_000
    assert url_verdicts(spark.createDataFrame([(1, url)], "page_id long, url string"), []).first().path == url[20:]


def test_one_long_page(spark):
    page = "<nav><ul><li>Home</li></ul></nav><article>" + "".join(f"<p>Line {i}.</p><ul><li>Item {i}</li></ul>" for i in range(8000)) + "</article>"
    out = main_texts(spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")).first()
    assert out.text == "\n\n".join(f"Line {i}.\n\nItem {i}" for i in range(8000))


def test_class_words_inside_articles(spark):
    page = "<article><h1>T</h1><p class='form social-history'>Of forms.</p><div class='search related-work'><p>Of search.</p></div><div class='ad-slot'>Buy</div><div class='comments'><p>Nice</p></div></article>"
    assert main_texts(spark.createDataFrame([(1, "http://a/", page)], "page_id long, url string, html string")).first().text == "T\n\nOf forms.\n\nOf search."


def test_token_counts_with_clashing_columns(spark):
    public = pytest.importorskip("public_tokenizers")
    from fotolith.llm.token_count import token_counts

    df = frame(spark, ODD).withColumns({"n_bytes": F.lit("old"), "n_tokens": F.lit("old")})
    out = token_counts(df, public.path("byte_bpe_50k.json"))
    assert dict(out.dtypes)["n_tokens"] == "bigint" and out.count() == len(ODD)


def test_mixing_refuses_endless_copies(spark):
    docs = spark.createDataFrame([(1, "a", "rare")] + [(i, "b", "x") for i in range(2, 50)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixed(docs, {"rare": 0.9}, size=1e7)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, rows):
    import corpus_pipeline

    docs = frame(spark, rows).withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") > 3, "src0"), "n_chars": F.length("text"), "kept": F.lit(1), "_in": F.lit(2), "n_hit": F.lit("x")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns)
        assert out.filter("kept <> 1 OR _in <> 2 OR n_hit <> 'x' OR score <> 0").count() == 0  # the documents' own columns
        n = out.count()
        if not rows:
            assert n == 0
        elif name == "exact_dedup":
            assert n == len({lower(t) for _, t in rows})
        elif name == "ngram_jaccard_join":
            apart = {c if c is not None else (d, i) for i, (d, _, c) in enumerate(brute_components(rows, 5, 80))}
            assert n <= len(rows) and n >= len(apart) - 2
        elif name == "benchmark_decontamination":
            assert n == len(rows)


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, monkeypatch, few):
    from fotolith.llm import components as module
    from fotolith.llm.scratch import Scratch

    monkeypatch.setattr(module, "FEW", few)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = module.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {x: root[x] for x in linked}
    assert module.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def test_tied_ids_and_copies_link_once(spark):
    """Rows that repeat with their doc_id, or without one, count their overlap once: texts below the bound stay apart."""
    base = [f"w{k}" for k in range(60)]
    near, far = base[:58] + ["x", "y"], base[:40] + [f"z{k}" for k in range(20)]
    rows = [(7, " ".join(base))] * 40 + [(7, " ".join(near))] * 40 + [(None, " ".join(far))] * 40 + [(9, " ".join(far[:39]))]
    got = ngram_classes(frame(spark, rows), 3, 80).select("doc_id", "n_grams", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == brute_components(rows, 3, 80)


def jobs_of(spark, run):
    """What run() gives, the number of its jobs, and the bytes of results that its tasks sent to the driver."""
    sc, name = spark.sparkContext, f"jobs-{id(run)}"
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs, store = sc.statusTracker().getJobIdsForGroup(name), sc._jsc.sc().statusStore()
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    return out, len(jobs), sum(store.lastStageAttempt(s).resultSize() for s in stages)


def test_the_classifier_sends_no_rows_to_the_driver(spark):
    from fotolith.llm.quality import train

    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 5003}" for k in range(900))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    weights, _, sent = jobs_of(spark, lambda: train(docs, labels, dimensions=1 << 10))
    assert len(weights) == (1 << 10) + 1 and weights.any() and sent < 400_000
    assert (weights == train(docs.repartition(7), labels, dimensions=1 << 10)).all()


def test_bits_of_ngrams_reach_the_driver_in_few_jobs(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 31 + k) % 997}" for k in range(60))) for i in range(200)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (bits, alone), jobs, _ = jobs_of(spark, lambda: ngram_join._often(docs, 5, ngram_join.Scratch(spark, "bits")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    words = Words(*text_buffer(__import__("pyarrow").array([r.text for r in docs.collect()])), ngram_join.SPACED, True)
    held = Counter(int(g) >> 64 - ngram_join.BUCKET_BITS for s in ngram_join._grams(words, 5) for g in s)
    assert alone and jobs <= 20
    assert set(np.flatnonzero(np.unpackbits(bits[0], bitorder="little"))) == {b for b, n in held.items() if n >= ngram_join.OFTEN}
