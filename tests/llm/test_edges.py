"""Every operator and stage over an empty table and over rows with nulls, empty and very long texts, ties and repeats, and columns
whose names clash with those used inside."""

import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from millrace.llm import fingerprints, minhash, packing, pii, pieces, quality, rans, sharding, toxicity, warc
from millrace.llm.tokens import tokenizer_path

LONG = "word after word, " * 20_000
PLAIN = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, PLAIN), (2, None), (3, ""), (4, LONG), (5, PLAIN), (5, PLAIN), (None, PLAIN), (None, None), (6, " \n\t "), (7, "x"),
    (8, "a" * 50_000), (9, "1" * 30_000), (10, "🙂é" * 40), (11, "a  b <|endoftext|> ▁ \x00"), (1, "the same id, another text"),
]
CLASHES = (
    "score predicted part at ahead to id key start size shard slot node class_id _node _rep _place measured_n_words failed kept "
    "toxic spans sequence_id offset token text_crc32"
).split()
BPE, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, None, 0), (None, 1, 1), (3, 0, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark, docs_of):
    made = docs_of(ROWS if request.param == "rows" else [])
    return made.select("*", *[F.lit("clash").alias(name) for name in CLASHES])


def ids_file(docs, folder):
    rans.write_ids(docs, folder, tokenizer_path(BPE))
    return rans.read_ids(docs.sparkSession, folder)


def operators(labels, folder):
    return {
        "pii": lambda d: pii.found(d, pii.train(d)), "token files": lambda d: ids_file(d, folder),
        "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, labels)), "pieces": lambda d: pieces.encoded(d, tokenizer_path(PIECES)),
        "quality": lambda d: quality.applied(quality.ledger(d)), "near duplicates": minhash.near_duplicates, "shards": sharding.shard_by_bytes,
        "fingerprints": fingerprints.compared,
    }


@pytest.mark.parametrize("name", operators(None, ""))
def test_one_row_for_each_document(docs, labels, tmp_path, name):
    made = operators(labels, str(tmp_path / "ids"))[name](docs)
    found = made.select("doc_id").collect()
    want = docs.select("doc_id").collect()
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert len(set(made.columns)) == len(made.columns)


def test_packing(docs):
    pieces_of = packing.pack(docs, tokenizer_path(BYTES))
    found = {(r.doc_id, r.doc_tokens): r.n for r in pieces_of.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()}
    assert len(found) == 0 or (3, 1) in found and found[3, 1] == 1
    assert docs.count() == pieces_of.where("start = 0").count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(docs, labels, tmp_path, k, spark):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    made = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    rows = {tuple(r) for r in docs.drop("text", "n_chars").collect()}
    assert {tuple(r) for r in made.drop("text", "n_chars").collect()} <= rows


def test_near_duplicate_stage_keeps_one_of_each(docs):
    if docs.isEmpty():
        return
    kept = [(r.doc_id, r.text) for r in minhash.near_duplicate_stage(docs).select("doc_id", "text").collect()]
    assert sorted(kept, key=str) == sorted(
        [(1, PLAIN), (2, None), (4, LONG), (6, " \n\t "), (7, "x"), (8, "a" * 50_000), (9, "1" * 30_000), (10, "🙂é" * 40),
         (11, "a  b <|endoftext|> ▁ \x00"), (1, "the same id, another text")],
        key=str,
    )


def test_null_text_counts_as_empty(docs, labels, tmp_path):
    if docs.isEmpty():
        return
    for name, make in operators(labels, str(tmp_path / "ids")).items():
        if name in ("near duplicates", "fingerprints"):
            continue
        rows = {r.doc_id: tuple(r)[1:] for r in make(docs).where("doc_id IN (2, 3)").drop("start", "slot", "shard", "held_out").collect()}
        assert rows[2] == rows[3], name


def test_warc_of_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "<p>x</p>", "c"), (1, "http://a", "<p>x</p>", "c"), (None, None, None, "c"), (2, "", "", "c"), (3, "u", "<script>" + "x" * 200_000, "c")],
        "page_id long, url string, html string, record_id string",
    )
    rows = warc.derived(warc.responses(pages)).collect()
    assert len(rows) == 10
    assert [r.block for r in rows if r.page_id == 1 and r.record_type == "conversion"] == ["x", "x"]
    assert {r.block for r in rows if r.page_id != 1 and r.record_type == "conversion"} == {""}
    empty = warc.derived(warc.responses(spark.createDataFrame([], pages.schema)))
    assert empty.count() == 0 and StructType.fromDDL(warc.SCHEMA).names == empty.columns


def test_shards_of_ties(docs):
    rows = sharding.shard_by_bytes(docs).collect()
    for r in rows:
        if r.doc_id == 5:
            assert (r.size, r.text_crc32) == (len(PLAIN) + 8, zlib.crc32(PLAIN.encode()))
    assert len({r.shard for r in rows if r.size == len(PLAIN) + 8 and r.text_crc32 == zlib.crc32(PLAIN.encode())}) <= 1


def test_page_text_is_that_of_the_declared_steps(spark):
    import random

    from pyspark.sql import functions as F

    from millrace.llm import warc

    bits = [" ", "  ", "\t", "\n", "\r", "\x0b", "a", "b1", "<p>", "</div>", "<BR/>", "<h1 x>", "<header>", "<headerx>", "<dl", "<d>", ">", "<b>"]
    bits += ["\u0085", " ", " ", " ", "</", " \n "]
    rnd = random.Random(1)
    texts = [("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))),) for _ in range(5000)]
    one = two = F.col("t")
    for pattern, to in (*warc.STEPS[-2:], *warc.SPACES):
        one = F.regexp_replace(one, pattern, to)
    for pattern, to in (*warc.TAGS, *warc.SPACES[:-1]):
        two = F.regexp_replace(two, pattern, to)
    assert spark.createDataFrame(texts, "t string").where(one != warc.trimmed(two)).count() == 0
    # One pass over the page less than the steps have.
    assert spark.range(1).select(warc.plain_text(F.lit("<p> x"))).first()[0] == "x"
    assert all(f"{word[0]}(?:" in warc.TAGS[0][0] for word in warc.BLOCKS.split("|"))


def test_page_text_is_made_once(spark):
    import random

    from millrace.llm import warc

    bits = [" ", "  ", "\t", "\n", "\r", "\x0b", "\x0c", "a", "&amp;", "&lt;", "&", "<p>", "<b>", "<!--x-->", "<script>s</script>", "\u0085"]
    rnd = random.Random(2)
    texts = [(k, None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for k in range(2000)]
    pages = spark.createDataFrame([*texts, (2000, "u", None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    found = warc.with_plain_text(source, "payload", "text").withColumn("whole", warc.plain_text(F.col("payload")))
    assert found.where("text <> whole").count() == 0
    spaced = F.col("html")
    for pattern, to in warc.SPACES[:-1]:
        spaced = F.regexp_replace(spaced, pattern, to)
    assert pages.where(spaced != warc.spaced(F.col("html"))).count() == 0
    plan = warc.derived(source)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("noscript") == warc.HIDDEN.count("noscript")
