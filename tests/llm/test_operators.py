"""Every operator on tricky rows against the plain versions, on an empty table, and with clashing column names."""

import math
import time
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import (
    decontaminate, html_text, jaccard, language_model, mixing, quality, secret_scan, substrings, token_counts, toxicity,
)

ITEMS = [(1, "w1 w2 w3"), (2, None), (3, "!!"), (4, "the w5"), (5, "")]


def by_row(df, *columns):
    """Results by the number of the row, kept in the column ``row``."""
    return {r["row"]: r.asDict() for r in df.select("row", *columns).collect()}


def check(got, tricky, want):
    assert len(got) == len(tricky)
    for k, expected in enumerate(want):
        found = {c: got[k][c] for c in expected}
        assert found == pytest.approx(expected) if any(isinstance(v, float) for v in expected.values()) else found == expected, tricky[k][:2]


def test_decontamination(spark, tricky, documents, no_documents):
    long_item = [(9, tricky[13][1][:400])]
    items = spark.createDataFrame(ITEMS + long_item, "item_id long, text string")
    columns = ["n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"]
    want = brute.decontaminate([r[1] for r in tricky], ITEMS + long_item)
    found = decontaminate.find_contamination(documents, items)
    check(by_row(found.select("row", "contamination.*"), *columns), tricky, want)
    # Several automata, one after another, find the same.
    split = decontaminate.find_contamination(documents, items, automaton_bytes=40)
    check(by_row(split.select("row", "contamination.*"), *columns), tricky, want)
    for r in found.filter("contamination.n_hit > 0").select("text", "contamination.spans").collect():
        assert all(brute.BENCHMARK_WORD.findall(r["text"][s["start"] : s["end"]]) for s in r["spans"])
    assert decontaminate.find_contamination(no_documents, items).count() == 0
    none = decontaminate.find_contamination(documents, items.limit(0))
    assert none.filter("contamination.n_hit > 0").count() == 0 and none.count() == len(tricky)


def test_substrings(tricky, documents, no_documents):
    want = brute.substrings([r[1] for r in tricky])
    cut = substrings.remove_repeats(documents, chunk_bytes=2000, shard_keys=1000)
    assert cut.columns == [*documents.columns, "dedup"]
    check(by_row(cut.select("row", "dedup.*"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), tricky, want)
    assert any(w["n_removed"] for w in want) and substrings.remove_repeats(no_documents).count() == 0
    assert {r["row"]: r["text"] for r in cut.select("row", "text").collect()} == {k: r[1] for k, r in enumerate(tricky)}


def test_quality(tricky, documents, no_documents):
    judged = quality.quality_rules(documents)
    want = brute.quality([r[1] for r in tricky])
    got = by_row(judged.select("row", "quality.*"), *want[0], "kept", "clean_text")
    check(got, tricky, want)
    assert not any(got[k]["kept"] for k, w in enumerate(want) if w["base_failed"])
    assert got[0]["kept"] and got[0]["clean_text"] == tricky[0][1] and not got[17]["kept"]
    assert quality.quality_rules(no_documents).count() == 0


@pytest.mark.parametrize("line, fails", [
    ("Home | News | Sport | About", True), ("THIS IS ALL VERY LOUD NOW", True), ("plain words of an ordinary sentence.", False),
    ("of*** the### and&&& to%%%", True), ("We use cookies on this site", True), ("Wait!! What?! Really?!", True),
    ("A | in a long line of ordinary words that go on", False), ("NATO and the EU met in Paris today", False),
])
def test_line_rules(line, fails):
    assert quality.line_fails(line, line.split()) is fails


def test_secrets(tricky, documents, no_documents):
    found = secret_scan.find_secrets(documents)
    base = F.col("secrets.base")
    counts = [secret_scan.n_of(base, k).alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:-1])]
    got = by_row(found, *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"), secret_scan.written(F.col("secrets.spans")).alias("spans"),
                 secret_scan.redact(F.col("text"), F.col("secrets.spans")).alias("masked"))
    check(got, tricky, brute.secrets([r[1] for r in tricky]))
    assert got[25]["spans"] == "random:4:36" and got[25]["masked"] == "key [secret] end"
    assert "hunter2" not in got[18]["masked"] and got[0]["masked"] == tricky[0][1]
    assert secret_scan.find_secrets(no_documents).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 50, 1000])
def test_running(spark, n):
    values = [(k * 37) % 11 for k in range(n)]
    v = F.lit(values).cast("array<bigint>") if n else F.array().cast("array<bigint>")
    total, most = spark.range(1).select(
        secret_scan.running(v, lambda a, b: a + b), secret_scan.running(v, lambda a, b: F.greatest(a, b))).first()
    assert total == [sum(values[:k]) for k in range(n)] and most == [max(values[:k], default=0) for k in range(n)]


def test_masking_overlaps(spark):
    text = "é" + "0123456789🙂" * 30
    for spans in ([], [(0, 0, 331)], [(1, 0, 3), (2, 1, 9), (4, 2, 5), (9, 0, 9 + 1), (330, 0, 331)], [(k, 0, k + 2) for k in range(1, 300, 3)]):
        want, at = "", 0
        for start, _, end in spans:
            if start >= at:
                want += text[at:start] + "[secret]"
            at = max(at, end)
        want += text[at:]
        df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:bigint,kind:int,end:bigint>>")
        assert df.select(secret_scan.redact(F.col("t"), F.col("s"))).first()[0] == want


def test_secrets_in_long_texts(spark):
    """40,000 runs in one text: no step is quadratic in the spans."""
    runs = [f"{k * 7919:016x}" for k in range(40_000)]
    keyed = " ".join(f"token={r} Zq{r}" for r in runs[:10_000])
    began = time.monotonic()
    df = spark.createDataFrame([(1, " ".join(runs)), (2, keyed)], "doc_id long, text string")
    found = secret_scan.find_secrets(df).select(
        "doc_id", F.size("secrets.base").alias("n"), secret_scan.redact(F.col("text"), F.col("secrets.spans")).alias("masked"))
    got = {r["doc_id"]: r for r in found.collect()}
    assert time.monotonic() - began < 60
    assert got[1]["n"] == 40_000 and got[1]["masked"] == " ".join(["[secret]"] * 40_000)
    assert got[2]["n"] == 30_000 and got[2]["masked"].count("[secret]") >= 20_000


def test_bytes_that_are_no_utf8(spark):
    """They read as U+FFFD where an operator writes texts, and end no job."""
    docs = spark.range(3).selectExpr(
        "id AS doc_id", "'s' AS source", "CASE id WHEN 0 THEN cast(unhex('6120FF6220632064') AS string) WHEN 1 THEN 'x c d e' END AS text")
    judged = {r["doc_id"]: r["quality"] for r in quality.quality_rules(docs).collect()}
    assert judged[0]["n_words"] == 4 and judged[0]["clean_text"] == "a \ufffdb c d" and judged[2]["clean_text"] == ""
    cut = {r["doc_id"]: r["dedup"] for r in substrings.remove_repeats(docs, window=2).select("doc_id", "dedup").collect()}
    assert cut[0]["n_removed"] == 2 and cut[0]["kept"] == "a \ufffdb" and cut[1]["kept"] == "x e"
    assert jaccard.keep_one(docs).count() == 3 and secret_scan.find_secrets(docs).count() == 3
    assert mixing.mix_sources(docs.withColumn("size", mixing.word_count("text"))).count() == 3


def test_mixing_spreads_rows_without_id(spark):
    docs = spark.range(4000).selectExpr("cast(null AS long) AS doc_id", "'s' AS source", "id % 7 + 1 AS size", "cast(id AS string) AS text")
    whole = mixing.mix_sources(docs, block_rows=100).select("text", "mix.taken").collect()
    again = mixing.mix_sources(docs.repartition(7), block_rows=100).select("text", "mix.taken").collect()
    assert sorted(whole) == sorted(again) and len(whole) == 4000


def test_randomness_scores(spark):
    rows = [("0f3a9c1e7b5d8264" * 2,), ("thethethethethethethethethethethe1",), ("a1" * 16,), ("9fK2xQ7mZpL4vT8bN3wR6yHc5D1gJ0sA",)]
    df = spark.createDataFrame(rows, "t string").withColumn("d", secret_scan.distance(F.col("t")))
    p = [r[0] for r in df.select(secret_scan.random_p(F.col("d"))).collect()]
    assert p[1] < 0.01 and p[2] < 0.01 and p[3] > secret_scan.LEAST_P
    x = spark.range(1).select(secret_scan.random_p(F.lit(7.814728))).first()[0]
    assert math.isclose(x, 0.05, abs_tol=1e-5)  # the 95 % point of chi-squared with three degrees of freedom


def test_mixing(tricky, documents, no_documents):
    sized = documents.withColumn("size", mixing.word_count("text"))
    for block_rows in (3, 1000):
        mixed = mixing.mix_sources(sized, block_rows=block_rows)
        got = by_row(mixed.select("row", "size", "source", F.col("mix.target").alias("goal"), "mix.taken", "mix.source_size"), "size", "source", "goal", "taken", "source_size")
        sizes = {}
        for r in tricky:
            sizes[r[2]] = sizes.get(r[2], 0) + len(brute.words(r[1]))
        goal = brute.targets(sizes)
        taken = dict.fromkeys(sizes, 0)
        for k, r in enumerate(tricky):
            assert got[k]["size"] == len(brute.words(r[1])) and got[k]["goal"] == pytest.approx(goal[r[2]]) and got[k]["source_size"] == sizes[r[2]]
            assert got[k]["taken"] in (0, got[k]["size"], 2 * got[k]["size"])
            taken[r[2]] += got[k]["taken"]
        longest = max(len(brute.words(r[1])) for r in tricky)
        assert all(abs(taken[s] - goal[s]) <= longest for s in sizes)
        assert sum(taken.values()) <= sum(goal.values()) + 1e-6
    assert mixing.mix_sources(no_documents.withColumn("size", F.lit(1))).count() == 0


def test_near_duplicates(tricky, documents, no_documents):
    groups, links = brute.near([r[1] for r in tricky])
    ids = [r[0] for r in tricky]
    least = {g: min((i for i, h in zip(ids, groups, strict=True) if h == g and i is not None), default=None) for g in set(groups)}
    got = sorted((tuple(r) for r in jaccard.link_documents(documents).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted(((i, least[g], n) for i, g, n in zip(ids, groups, links, strict=True)), key=str)
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns
    worded = {g for g, r in zip(groups, tricky, strict=True) if brute.words(r[1])}
    assert kept.count() == len(worded) + sum(not brute.words(r[1]) for r in tricky)
    assert jaccard.link_documents(no_documents).count() == 0 and jaccard.keep_one(no_documents).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A group and a bucket that are cut into blocks give the links of one piece."""
    base = [f"v{k}" for k in range(200)]
    texts = []
    for k in range(60):
        edited = list(base)
        for j in range(k % 4):
            edited[(37 * k + 50 * j) % 200] = f"e{k}_{j}"
        texts.append(" ".join(edited))
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 9)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups, links = brute.near(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link_documents(df).collect()}
    assert got == {k: (groups[k], links[k]) for k in range(len(texts))}


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    for n, need in zip(range(16, 129, 16), least, strict=True):
        lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need))
        assert lost < 1e-5
    assert least[-1] > 60  # and drops pairs at half the threshold


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, tricky, documents, no_documents, order):
    keep = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    model = language_model.train(documents.filter(keep), order=order, shard_keys=5000)
    got = by_row(language_model.score(documents, model).select("row", "lm.*"), "n_tokens", "n_known", "base_score", "score")
    train = [r[1] for r in tricky if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    want = brute.kneser_ney(train, [r[1] for r in tricky], 2)
    assert model.train_tokens == want[0]["train_tokens"]
    check(got, tricky, [{c: w[c] for c in ("n_tokens", "n_known", "base_score", *(["score"] if order == 2 else []))} for w in want])
    assert all(g["score"] <= 0 for g in got.values())
    empty = language_model.train(no_documents)
    assert language_model.score(documents, empty).count() == len(tricky) and language_model.score(no_documents, model).count() == 0


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([(t,) for t in ("a b a c", "b a b", "c c a d e", "a b c d")] * 2, "text string")
    model = language_model.train(docs, order=2)
    one = spark.createDataFrame([(f"a {w}",) for w in ("a", "b", "c", "d", "e", "unseen")] + [("a",)], "text string")
    rows = {r["text"]: r["lm"]["score"] for r in language_model.score(one, model).collect()}
    want = {t: w["score"] for t, w in zip(rows, brute.kneser_ney([r["text"] for r in docs.collect()], list(rows), 2), strict=True)}
    assert rows == pytest.approx(want)


def test_toxicity(spark, documents, no_documents, tricky):
    texts = [(k, ("nasty vile " if k % 4 == 0 else "") + " ".join(f"w{(k * 7 + j * j) % 90}" for j in range(40)) + (" rotten" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    rows = [(t, y, k % 3 == 0) for k, t, y in texts]
    model = toxicity.fit(rows)
    labelled = spark.createDataFrame(texts, "doc_id long, text string, label int")
    scored = toxicity.score(labelled, model)
    assert scored.filter((F.col("toxicity") >= 0.7) != (F.col("label") == 1)).count() == 0
    got = [r["toxicity"] for r in toxicity.score(documents, model).collect()]
    assert len(got) == len(tricky) and all(0 <= v <= 1 for v in got)
    assert toxicity.score(no_documents, model).count() == 0
    nothing = toxicity.train(documents, documents.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.score(documents, nothing).filter("toxicity > 0.1").count() == 0


def test_token_counts(documents, no_documents, tricky):
    from tokenizers import Tokenizer, models

    pieces = token_counts.load_vocabulary()
    reference = Tokenizer(models.Unigram([("<unk>", -200.0), *pieces.items()], unk_id=0, byte_fallback=False))
    got = by_row(token_counts.count_tokens(documents).select("row", "tokens.*"), "n_words", "n_tokens")
    for k, r in enumerate(tricky):
        w = brute.words(r[1])
        assert got[k]["n_words"] == len(w)
        if len(w) < 1000 and all(c in pieces for x in w for c in x):
            assert got[k]["n_tokens"] == sum(len(reference.encode("▁" + x).tokens) for x in w if len(x) < 1000) or any(len(x) > 999 for x in w)
    trie = token_counts.PieceTrie(pieces)
    assert token_counts.count_words(["▁͸"], trie)[0] == 1 + 2  # two bytes of a character without a piece
    assert token_counts.count_tokens(no_documents).count() == 0


PAGE = (
    '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this</div>'
    "<article><h1>The &amp; title</h1><p>First <b>bold</b>\n  line<br>more<p>Second &lt;p&gt;<div class='share'><a>Tweet</a></div>"
    '<aside>Side</aside><form>Mail <input></form><section id="comments"><p>Reader says that this is a fine article</p></section></article>'
    "<footer>&copy; Site</footer></body></html>"
)


@pytest.mark.parametrize("html, text", [
    (PAGE, "The & title\n\nFirst bold line more\n\nSecond <p>"), (None, ""), ("", ""), ("<article></article>", ""),
    ("<article><p>cut off <a hre", "cut off"), ("<article><p>a < b &am", "a < b &am"),
    ("<div class='page with-sidebar'><article><p>Short.</p></article></div>", "Short."),
    ("<main><p>Hello there</p></main><p>Not this</p>", "Hello there"), ("<form id=aspnet><article><p>In a form</p></article></form>", "In a form"),
    ("<article><script>var a='<p>x</p>'</script><p>y</p></article>", "y"), ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
])
def test_main_text(html, text):
    assert html_text.main_text(html or "", html_text.train()) == text


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "html", "main_text"] and sorted(len(r["main_text"]) for r in got.collect())[:2] == [0, 0]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_tree_fits_its_table():
    x, y = html_text.labelled_blocks()
    assert (html_text.train().predict(x) == y).all()
