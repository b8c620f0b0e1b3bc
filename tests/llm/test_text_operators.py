import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from millrace.llm import pieces, pii, quality, toxicity, warc
from millrace.llm.scan import words_of
from millrace.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a  bé\tc\x0b", "x", "\n", "ab ab", "é é ab"]
    words = words_of(pa.array(texts))
    want = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    got = [(int(r), bytes(words.data[s:e]).decode()) for r, s, e in zip(words.row, words.start, words.end)]
    assert got == want
    by = {}
    for (_, word), h in zip(got, words.hash.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_quality_equals_sql(spark):
    assert difference(quality.op5_quality_rules(spark, SF), duck(SF), quality.ORACLE_SQL) is None


def test_repeated_windows_overlap_and_stay_in_their_text():
    found = quality.measured(pa.array(["a a a a a a", "a b c d e", "a b c d e", "x a b c d e y a b c d e z", "a\na\n \nb\na"]))
    assert found["n_repeat_words"].tolist() == [6, 0, 0, 10, 0]
    assert found["n_dup_lines"].tolist() == [0, 0, 0, 0, 2]


def test_ablation(spark):
    book = quality.op5_quality_rules(spark, SF)
    masks = [r.failed for r in book.collect()]
    for r in quality.ablation(book).collect():
        bit, reject = quality.BIT[r.rule], quality.bits(quality.POLICIES[r.policy])
        assert r.failed == sum(bool(m & bit) for m in masks)
        assert r.only_this == sum(m & reject == bit for m in masks)
        assert r.kept == sum(not m & reject for m in masks)
        assert r.kept_without == sum(not m & reject & ~bit for m in masks) == r.kept + r.only_this


def test_toxicity_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op3_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    # A third of the toxic labels is noise that no text feature shows.
    assert right > 0.955
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert np.array_equal(one.index, two.index) and np.allclose(one.weight, two.weight) and one.bias == two.bias
    assert len(one.index) < 2000


def test_ftrl_leaves_rare_features_out():
    examples = [(k % 2, np.array([k % 2, 10 + k])) for k in range(200)]
    model = toxicity.fit(examples, 200, 100)
    assert set(model.index.tolist()) <= {0, 1} and len(model.index) >= 1


MODEL = tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "the", "é", " ", "  ", "\n", "\t", "▁", "1", "日本", "🙂", "\0", "<s>", "<0x41>", "ing", "zzzz", ".", "’"]


def test_pieces_equal_the_library():
    mine, dice = pieces.CheckedEncoder(MODEL), random.Random(8)
    texts = ["".join(dice.choices(PARTS, k=dice.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, "▁" * 300, " " * 70 + "x", "word" * 60 + " y "]
    for text, (ids, shown, corrected) in zip(texts, mine.encode(texts)):
        want = mine.library.encode(text)
        assert ids.decode() == ",".join(map(str, want)) and shown.decode() == mine.library.decode(want) and not corrected, repr(text)


def test_rows_and_heap_of_the_agenda_agree():
    model, dice = pieces.PieceModel(MODEL), random.Random(9)
    chunks = ["▁" + "".join(dice.choices("abcdeinorst é🙂▁".replace(" ", ""), k=dice.randrange(1, 30))) for _ in range(500)]
    assert model.encode_rows(chunks) == [model.encode_long(c) for c in chunks]


def test_models_it_cannot_follow_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x0a\x05\x0a\x01a\x18\x01\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceModel(str(tmp_path / "m"))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plainly(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_base_spans_are_those_of_the_patterns():
    dice = random.Random(6)
    bits = ["a", "b@", "@", "1", "22", "255.", ".", "-", " ", "+1", "(", "%", "_", "é", "4111 1111 1111 1111", "0", "x.y", "@c.d", "\n"]
    for _ in range(20_000):
        text = "".join(dice.choices(bits, k=dice.randrange(24)))
        assert pii.base_spans(text) == plainly(text), repr(text)
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@") == []


def test_personal_data_of_a_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op1_personal_data(spark, SF).collect():
        base = plainly(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(r.spans.split(",")) | {""}


def test_messages_give_exact_marginals_on_a_tree():
    dice = np.random.default_rng(3)
    width = pii.unfolded(np.zeros(1, np.int64)).shape[1]
    pair = dice.normal(size=(3, 5, 5))
    model = pii.Crf(dice.normal(size=(width, 5)), (pair + pair.transpose(0, 2, 1)) / 2)
    field = pii.Field([(0, 1)] * 4, [3, 700, 41, 3], [-1, 2, -1, -1], [(0, 1, 0), (1, 2, 1), (1, 3, 2)])
    got = pii.marginals(field, model, turns=60)
    score = pii.unfolded(np.array(field.features)) @ model.unary
    want = np.zeros((4, 5))
    for y in np.ndindex(5, 5, 5, 5):
        if y[1] == 2:
            p = np.exp(sum(score[k, y[k]] for k in range(4)) + sum(model.pair[t, y[i], y[j]] for i, j, t in field.edges))
            for k in range(4):
                want[k, y[k]] += p
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_messages_on_loops_are_near_the_exact_marginals():
    """Cycles of skip and chain edges, every assignment enumerated; potentials of the size that training gives weak ones."""
    dice = np.random.default_rng(8)
    width = pii.unfolded(np.zeros(1, np.int64)).shape[1]
    for _ in range(5):
        pair = dice.normal(size=(3, 5, 5)) * 0.5
        model = pii.Crf(dice.normal(size=(width, 5)) * 0.5, (pair + pair.transpose(0, 2, 1)) / 2)
        edges = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (0, 2, 1), (1, 4, 2), (0, 3, 2)]
        field = pii.Field([(0, 1)] * 5, [3, 700, 41, 3, 900], [-1, -1, 2, -1, -1], edges)
        got = pii.marginals(field, model, turns=200)
        score = pii.unfolded(np.array(field.features)) @ model.unary
        want = np.zeros((5, 5))
        for y in np.ndindex(5, 5, 5, 5, 5):
            if y[2] == 2:
                p = np.exp(sum(score[k, y[k]] for k in range(5)) + sum(model.pair[t, y[i], y[j]] for i, j, t in edges))
                for k in range(5):
                    want[k, y[k]] += p
        assert np.abs(got - want / want.sum(axis=1, keepdims=True)).max() < 0.05


TELEPHONES = ["+1 555-010-7788 or 555-010-7788", "mail a@b.co, 10.0.0.1 and 10.0.0.2 4111 1111 1111 1111", "7 of 9", None, "", "x " * 9 + "a@b.co 12"]


def test_configurations_are_counted_over_all_documents(docs_of):
    want = Counter()
    for text in filter(None, TELEPHONES * 40):
        field = pii.field_of(text, pii.base_spans(text))
        label = [max(k, 0) for k in field.observed]
        for k, feature in enumerate(field.features):
            near = []
            for kind in range(3):
                ends = [label[i + j - k] for i, j, t in field.edges if t == kind and k in (i, j)]
                near.append(1 + max(ends) if ends else 0)
            want[feature, near[0] * 36 + near[1] * 6 + near[2], label[k]] += 1
    rows = pii.configurations(docs_of(TELEPHONES * 40).repartition(5)).collect()
    got = {(r.feature, r.near, k): r[f"n{k}"] for r in rows for k in range(5) if r[f"n{k}"]}
    assert got == dict(want) and len({(r.feature, r.near) for r in rows}) == len(rows)


def test_fit_follows_the_gradient_of_the_pseudo_likelihood():
    """The first steps against the objective differentiated numerically, one cell and one label at a time."""
    feature, near = np.array([3, 700, 700]), np.array([0, 1 * 36 + 2 * 6 + 5, 5 * 36])
    counts, l2 = np.array([[4, 0, 0, 0, 0], [1, 0, 0, 9, 0], [0, 0, 16, 0, 1]]), 1e-3
    weight = np.sqrt(counts) / np.sqrt(counts).sum()

    def loss(unary, pair):
        total = l2 / 2 * ((unary**2).sum() + (pair**2).sum())
        for k in range(3):
            score = pii.unfolded(feature[k : k + 1])[0] @ unary
            for kind, number in enumerate((near[k] // 36, near[k] // 6 % 6, near[k] % 6)):
                if number:
                    score = score + pair[kind, number - 1]
            total -= sum(weight[k, y] * (score[y] - np.log(np.exp(score).sum())) for y in range(5))
        return total

    unary, pair = np.zeros((pii.unfolded(feature).shape[1], 5)), np.zeros((3, 5, 5))
    memory = [np.full(m.shape, 1e-8) for m in (unary, pair)]
    for _ in range(3):
        slopes = []
        for m in (unary, pair):
            slope = np.zeros(m.shape)
            for at in np.ndindex(*m.shape):
                old, ends = m[at], []
                for step in (1e-5, -1e-5):
                    m[at] = old + step
                    ends.append(loss(unary, pair))
                m[at], slope[at] = old, (ends[0] - ends[1]) / 2e-5
            slopes.append(slope)
        # A table of potentials is symmetric, so its slope is the mean of both places.
        slopes[1] = (slopes[1] + slopes[1].transpose(0, 2, 1)) / 2
        for m, g, c in zip((unary, pair), slopes, memory):
            c += g**2
            m -= 0.5 * g / np.sqrt(c)
        for kind, a, b in np.ndindex(3, 5, 5):
            if kind and (pair[kind, a, b] < 0) == (a == b):
                pair[kind, a, b] = 0.0
    got = pii.fit(feature, near, counts, steps=3)
    assert np.allclose(got.unary, unary, atol=1e-3) and np.allclose(got.pair, pair, atol=1e-3)


def test_spans_are_added_only_where_skip_edges_lead_to_an_observed_one():
    """A field that is sure of "phone" everywhere: only what is connected by skip edges to an observed phone is added."""
    width = pii.unfolded(np.zeros(1, np.int64)).shape[1]
    unary = np.zeros((width, 5))
    unary[-1, 4] = 50.0
    model = pii.Crf(unary, np.zeros((3, 5, 5)))
    text = "+1 555-010-7788 x x x x 555-010-7788 x x x x 666-010-7788 x x x x 77.77 x x x x 77.77 x x x x a@b.co"
    more = pii.added_spans(text, pii.base_spans(text), model)
    assert [(k, text[s:e]) for k, s, e in more] == [("phone", "555-010-7788"), ("phone", "666-010-7788")]


def test_ftrl_equals_one_coordinate_at_a_time():
    dice = random.Random(4)
    examples = []
    for _ in range(300):
        label = int(dice.random() < 0.3)
        examples.append((label, np.array(sorted(set(dice.choices(range(label * 6, 30 + label * 3), k=8))))))
    how = toxicity.Ftrl(alpha=0.7, beta=0.9, l1=1.5, l2=0.2, epochs=3)
    z, n = {}, {}

    def weight(k, l1=how.l1, l2=how.l2):
        zk = z.get(k, 0.0)
        if abs(zk) <= l1:
            return 0.0
        return -(zk - math.copysign(l1, zk)) / ((how.beta + math.sqrt(n.get(k, 0.0))) / how.alpha + l2)

    positive = sum(label for label, _ in examples)
    offset = math.log((positive + 0.5) / (len(examples) - positive + 1.5))
    for _ in range(how.epochs):
        for label, at in examples:
            used = {k: weight(k) for k in at.tolist()} | {"bias": weight("bias", l1=0.0)}
            bias = used["bias"]
            g = 1 / (1 + math.exp(-(offset + sum(used.values())))) - label
            for k, w in used.items():
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / how.alpha * w
                n[k] = before + g * g
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    got = toxicity.fit(examples, len(examples), positive, how)
    assert dict(zip(got.index.tolist(), got.weight)) == pytest.approx(want) and 0 < len(want) < 30
    assert got.bias == pytest.approx(offset + bias)


def test_model_does_not_depend_on_the_order_of_repeated_ids(spark, docs_of):
    texts = [(k, f"{word}{'abcde'[k % 5]} {'xyz'[k % 3]} day") for k in range(60) for word in ("awful", "lovely", "plain")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    how = toxicity.Ftrl(l1=0.01)
    one = toxicity.train(docs_of(texts).coalesce(1), labels, how=how)
    two = toxicity.train(docs_of(texts[::-1]).repartition(7), labels, how=how)
    assert len(one.index) and one.bias == two.bias and np.array_equal(one.index, two.index) and np.array_equal(one.weight, two.weight)


def test_skip_edges_carry_a_label():
    width = pii.unfolded(np.zeros(1, np.int64)).shape[1]
    unary, pair = np.zeros((width, 5)), np.zeros((3, 5, 5))
    unary[-1, 0] = 2.0
    pair[1:] = np.eye(5) * 9
    model, text = pii.Crf(unary, pair), "tel +1 555-010-7788, again 555-010-7788 or 555-010-7788; 42 apples"
    base = pii.base_spans(text)
    assert [k for k, _, _ in base] == ["phone"]
    more = pii.added_spans(text, base, model)
    assert [text[s:e] for _, s, e in more] == ["555-010-7788"] * 2 and {k for k, _, _ in more} == {"phone"}
    assert pii.redacted(text, base + more) == "tel [PHONE], again [PHONE] or [PHONE]; 42 apples"
    assert pii.added_spans("only 42 and 43", [], model) == []


def test_warc_equals_sql(spark):
    assert difference(warc.op9_warc_derivatives(spark, SF), duck(SF), warc.oracle_sql()) is None


class Reader(HTMLParser):
    """The words of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.text = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def test_plain_text_equals_a_parser(spark):
    pages = [
        "<p>one</p><script><!--\ntrack();\n</script><p>page text</p>",
        "<p>a</p><script>if (x < '<!--') {}</script><p>b</p><!-- <script> --><p>c</p><style>/* <!-- */</style><p>d</p>",
        "<p>l&#8217;&#x27;&#X2019;&eacute;&Eacute;&amp;lt; &#38;amp; &unknown; & &; &#; &#150; &#0; &#x110000; &#99999999999; &#128512;&hearts;&#65</p>",
        "<p>x &vert;&equals;&comma;&NotEqualTilde;&AMP;</p>", "no reference", "", "&amp;", "a&#xA0;b",
    ]
    frame = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = [r.text for r in frame.orderBy("k").select(warc.plain_text(F.col("html")).alias("text")).collect()]
    for page, text in zip(pages, got):
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert "".join(text.split()) == "".join("".join(reader.text).split())


def test_warc_records_are_linked(spark, tmp_path):
    source = warc.responses(spark.createDataFrame([(1, "http://a/", "<title>T\n t</title><p>x &amp; y<!-- n --><script>s</script><b>z</b></p>")], "page_id long, url string, html string"))
    response = source.first()
    meta, text = warc.derived(source).collect()
    assert (meta.record_type, text.record_type, text.block) == ("metadata", "conversion", "T\nt\nx & yz")
    assert meta.refers_to == text.refers_to == response.record_id and meta.payload_digest == response.payload_digest
    assert f"conversion-record: {text.record_id}" in meta.block and "title: T t\r\n" in meta.block
    assert f"WARC-Concurrent-To: {text.record_id}" in meta.header and f"Content-Length: {len(text.block.encode())}" in text.header
    warc.write_warc(warc.derived(source).coalesce(1), str(tmp_path / "warc"))
    lines = spark.read.text(str(tmp_path / "warc"), wholetext=True).first().value
    assert lines == meta.header + meta.block + "\r\n\r\n" + text.header + text.block + "\r\n\r\n"
