"""Edge cases: nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from wayfare.llm import chunk_dedup, common, decontamination, embedding_graph, html_extract, minhash, packing, secrets, sharding, suffix_dedup, toxicity
from wayfare.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ROWS = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, None), (None, "x y z"), (3, ""), (4, None), (5, LONG), (6, LONG), (7, " \t\n "), (8, "ünïcödé “text” 漢字 \U0001f600 end")]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("key", "part", "token", "kinds", "row_id", "row_key", "leaks", "score", "removed", "size", "salt", "block", "secret_spans")}
    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "q one two three four? five six seven"), (3, "q one two three four? five six seven"), (None, "x")], "item_id long, text string")


def everything(docs, labels, items):
    model = toxicity.fit(docs, labels)
    return {
        "toxicity": toxicity.score(docs, model),
        "leaks": decontamination.find_leaks(docs, items),
        "suffix": suffix_dedup.remove_repeats(docs),
        "packing": packing.pack_documents(docs, tokenizer_path()).where("piece = 0"),
        "sharding": sharding.shard_documents(docs),
        "minhash": minhash.near_duplicates(docs),
        "chunks": chunk_dedup.remove_repeats(docs),
        "secrets": secrets.scan_secrets(docs),
        "redacted": secrets.redact_secrets(docs),
    }


def test_every_row_has_a_result(docs, labels, items):
    for name, out in everything(docs, labels, items).items():
        assert out.count() == len(ROWS), name


def test_empty_tables(docs, labels, items):
    for name, out in everything(docs.limit(0), labels.limit(0), items.limit(0)).items():
        assert out.count() == 0, name


def test_defined_results(docs, spark):
    rows = minhash.near_duplicates(docs).collect()
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[1, 6].component_id == 1 and by[2, 6].component_id == 1 and not by[2, 6].kept and by[6, 29_999].component_id == 5
    assert by[3, 0].component_id == 3 and by[7, 0].kept and by[None, 2].kept and by[None, 2].component_id is None
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).where("doc_id is not null").collect()}
    assert cut[6].kept == b"" and len(cut[6].removed) == 1 and cut[5].kept.decode() == LONG and cut[2].removed == []
    chunks = {r.doc_id: r for r in chunk_dedup.remove_repeats(docs).where("doc_id is not null").collect()}
    assert chunks[6].kept_text == "" and chunks[6].first_doc_ids == [5] and chunks[5].removed == []
    slots = sharding.shard_documents(docs).select("shard", "slot").collect()
    for s in {r.shard for r in slots}:
        assert sorted(r.slot for r in slots if r.shard == s) == list(range(sum(r.shard == s for r in slots)))


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (12, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1))
    out = {r.vec_id: r for r in embedding_graph.near_duplicates(df).collect()}
    assert {k: v.n_links for k, v in out.items()} == {1: 3, 2: 3, 3: 3, 12: 3, 4: 1, None: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0}
    assert [out[i].component_id for i in (1, 2, 3, 12, 4, None, 7)] == [1, 1, 1, 1, 4, 4, 7] and not out[2].kept
    assert embedding_graph.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["<svg class=i />", "<math/>", "<svg>", "<iframe src=x>", "<button>"])
def test_skipped_elements_without_an_end(tag):
    page = f"<main><h1>T</h1>{tag}<p>one two three</p></main>"
    assert html_extract.main_text(page) == "T\none two three"
    if tag.endswith("/>"):
        assert html_extract.main_text(page + "<svg><text>x</text></svg>") == "T\none two three"
    assert html_extract.main_text("<main><p>a b</p><script>var x</main><p>y") == "a b"


def test_private_keys_are_masked_whole(spark):
    body = "\n".join("MIIEowIBAAKCAQEA" + "aB3/+" * 9 + str(i) for i in range(400))
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    crypt = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = [f"a {head}\n{body}\n{end} z", f"a {head}\n{crypt}{body}\nab==\n{end} z", f"a {head} {body.replace(chr(10), ' ')} {end} z", f"a {head}\n{body}\nab==\n\nz", f"a {head}\\n{body}\\n{end} z", f"a {head} z", f"a {head}\n{crypt}{body}\n\nz {head}\n{body}\n{end}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text.split() for r in secrets.redact_secrets(df).orderBy("doc_id").collect()]
    assert out == [["a", "[REDACTED]", "z"]] * 6 + [["a", "[REDACTED]", "z", "[REDACTED]"]]


def test_near_copies_leave_one_row(spark):
    import corpus_pipeline

    t, u, a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "tuab")
    rows = [(1, t), (1, t), (2, t), (None, t), (None, u), (None, u), (None, ""), (None, None), (3, a), (3, b), (4, b + " end"), (5, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("clash"))
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    left = sorted(map(str, ((r.doc_id, r.text) for r in out.collect())))
    lost = [r for r in left if r.startswith("(4")]
    want = [(1, t), (None, u), (None, ""), (None, None), (3, a), (3, b), (5, ""), (6, None)]
    first = [(1, t), (None, u), (None, ""), (None, None), (3, a), (4, b + " end"), (5, ""), (6, None)]
    assert left == sorted(map(str, first if lost else want))


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<nav>x"), (4, None, "<article><p>A &amp; B<p>c</article><footer>f</footer>"), (4, None, "<article><p>A &amp; B<p>c</article><footer>f</footer>"), (5, "u", "<!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_extract.extract(df).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in out] == [("", 0), ("", 0), ("", 0), ("A & B\nc", 7), ("A & B\nc", 7), ("", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path, docs, labels, items):
    """Nulls in any column, blank and very long texts, repeated rows and ids, clashing names, empty tables."""
    import corpus_pipeline

    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        rows.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}).write.parquet(f"{folder}/documents.parquet")
        (labels if name == "odd" else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        (items if name == "odd" else items.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        packed = corpus_pipeline.run(spark, folder).toPandas()
        if name == "empty":
            assert not len(packed)
            continue
        left = packed[packed.piece == 0]
        # the copies 1, 1 and 2 leave one; 6 copies 5; blank texts stay
        assert sorted(left.doc_id.dropna()) == [1, 3, 4, 5, 7, 8] and left.doc_id.isna().sum() == 2
        assert packed.groupby("sequence_id").length.sum().max() <= 2048
        stages = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, step in corpus_pipeline.STAGES[:-1]:
            assert step(spark, stages, folder).columns == stages.columns, stage


def test_tables_of_a_stage_are_removed(spark):
    kept = common.settled(lambda: common.stored(spark.range(5), "one").union(common.stored(spark.range(3), "two")), "both")
    assert kept.count() == 8
    folder = spark._jvm.java.io.File(common.scratch_root(spark).removeprefix("file://"))
    names = [f.getName().split("-")[0] for f in folder.listFiles()]
    assert "both" in names and "one" not in names and "two" not in names
    common.forget(kept)
    assert "both" not in [f.getName().split("-")[0] for f in folder.listFiles()]


def test_components_of_a_hub(spark):
    links = spark.range(1, 30_000).selectExpr("id * 3 as u", "0L as v").union(spark.createDataFrame([(1, 2), (2, 4), (None, 5), (7, 7)], "u long, v long"))
    found = {r.id: r.component_id for r in common.connected_components(links).collect()}
    assert len(found) == 30_003 and found[89_997] == 0 and (found[1], found[2], found[4]) == (1, 1, 1)


def test_an_item_of_several_texts(spark):
    one, two = "what is the first of these many words here? alpha beta gamma", "where do all the other words of this go? delta epsilon zeta"
    items = spark.createDataFrame([(1, one), (1, two), (2, "none of this at all is in there? so it is")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y z {one} and on"), (2, f"x y z {two} and on"), (3, f"{one} {two}")], "doc_id long, text string")
    found = {r.doc_id: [h.item_id for h in r.leaks] for r in decontamination.find_leaks(docs, items).collect()}
    assert found == {1: [1], 2: [1], 3: [1]}
