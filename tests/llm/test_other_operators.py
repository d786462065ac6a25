import hashlib
import math
import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import pairs, same
from pyspark.sql import functions as F

from emberway.llm import chat_format, html_layout, mixing, topk, toxicity, warc

TURNS = "conv_id long, turn long, role string, text string, keys int"
ODD_TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "bye"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
    (4, 1, "assistant", "</s>[INST] \\ <s>[TURN]x[BODY]y</s>"), (4, 0, "system", None), (4, None, None, "late"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"),
    (6, 0, "user", ""), (6, 0, "user", ""), (None, 0, "user", "nobody"), (7, 0, "assistant", "long " * 40_000), (8, 0, "assistant", "<" + "s>"), (8, 1, "assistant", "<"),
]


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], TURNS)


@pytest.mark.parametrize("limit", [20, 200, chat_format.PACK])
def test_chats_read_back(spark, limit):
    segments, leaves = chat_format.format_chats(turns(spark, ODD_TURNS), limit)
    back = chat_format.read_back(segments).join(leaves, ["pack", "node"])
    same(back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), [(k, *v) for k, v in brute.chats(ODD_TURNS).items()])


def test_chats_table(spark, sf):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    segments, leaves = chat_format.format_chats(turns(spark, rows), 3000)
    back = chat_format.read_back(segments).join(leaves, ["pack", "node"])
    same(back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), [(k, *v) for k, v in brute.chats(rows).items()])


def test_shared_turns_are_emitted_once_and_positions_follow_the_path(spark):
    segments, _ = chat_format.format_chats(turns(spark, ODD_TURNS[:6]))
    rows = sorted(segments.collect(), key=lambda r: r["seq_start"])
    assert len(rows) == 3 and [r["seq_start"] for r in rows][1:] == [r["seq_end"] for r in rows][:-1]
    root, *leaves = rows
    assert root["ancestors"] == [] and root["pos_start"] == 0
    for leaf in leaves:
        assert [tuple(a) for a in leaf["ancestors"]] == [(root["seq_start"], root["seq_end"])] and leaf["pos_start"] == len(root["text"])


@pytest.mark.parametrize("text", ["", "\\", "\\s", "</s>", "<s></s>", "[INST] ok [/INST]", "<<s>s>", "[TURN][BODY]", "<<SYS>><</SYS>>\\e"])
def test_escapes_are_reversible(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.ESCAPES if c != "\\")
    assert chat_format.parse(chat_format.turn_text(text, text) * 2) == [(text, text)] * 2


def test_chats_empty(spark):
    segments, leaves = chat_format.format_chats(turns(spark, []))
    assert segments.collect() == [] and leaves.collect() == []


PAGES = [(1, "u", "<p>a"), (2, "u\r\n", "<p>a"), (3, None, ""), (4, "v", None), (5, "w", "é" * 3000), (None, "z", "only"), (6, "w", "é" * 3000), (7, "q", "x" * 5000), (7, "q2", "x" * 5000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("chunk", [16, 1000, warc.CHUNK])
def test_warc_round_trip(spark, chunk):
    out = warc.read_archive(spark, warc.write_archive(pages(spark), chunk=chunk))
    same(out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), brute.records([(p, h) for p, _, h in PAGES]))
    assert out.where("not digest_ok").count() == 0
    assert {(r["page_id"], r["url"]) for r in out.collect()} == {(p, u or "") for p, u, _ in PAGES}


def test_warc_chunks_carry_digests(spark):
    rows = warc.chunk_rows(warc.typed(pages(spark, [(1, "u", "abcdefghij" * 10)])), 32).orderBy("chunk_no").collect()
    body = b"abcdefghij" * 10
    assert [r["payload_so_far"] for r in rows] == [warc.base32(hashlib.sha1(body[: 32 * (i + 1)]).digest()) for i in range(4)]
    assert max(len(r["data"]) for r in rows[1:-1]) <= 32


def test_warc_least_size_and_files(spark, tmp_path):
    path = warc.write_archive(pages(spark), least=5, chunk=64)
    assert warc.read_archive(spark, path).where("page_id in (1, 2)").select("record_type").distinct().collect() == [("response",)]
    files = warc.export_files(spark, path, str(tmp_path)).collect()
    text = b"".join((tmp_path / f["file"].rpartition("/")[2]).read_bytes() for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and sum(f["n_bytes"] for f in files) == len(text)


def test_warc_empty(spark):
    assert warc.read_archive(spark, warc.write_archive(pages(spark, []))).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)] + [(300, rows_ := [0.1] * 8), (301, rows_), (302, rows_), (20, [0.1] * 8), (303, None), (304, [float("nan")] * 8), (305, [None] * 8), (306, []), (None, [1.0] * 8), (307, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, v int")
    levels = topk.levels(table)
    for blocks in ({}, {"candidates": 50, "per_block": 4}):
        out = topk.top_k(levels, levels.where("vec_id % 20 = 0"), 20, **blocks)
        got = {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()}
        want = set()
        all_ = [(i, brute.levels(v)) for i, v in rows if i is not None and brute.levels(v)]
        asked = {}  # of queries that repeat a vec_id the one of the least vector counts
        for i, a in all_:
            if i % 20 == 0:
                asked[i] = min(a, asked.get(i, a))
        for q, a in asked.items():
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in all_ if i != q)
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:20])}
        assert got == want


def test_top_k_stops_early():
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 1, (5000, 4)) * 20).astype(np.int64)
    lists = topk.Lists(np.arange(5000), vectors)
    (_, at, score, seen), = lists.top(np.array([-1]), vectors[:1], 5, np.array([-np.inf]))
    full = vectors @ vectors[0]
    order = np.lexsort((np.arange(5000), -full))[:5]
    assert lists.ids[at].tolist() == order.tolist() and score.tolist() == full[order].tolist() and seen < 5000
    # a floor that the block cannot reach leaves it unread; one that it reaches keeps what is as good
    assert list(lists.top(np.array([-1]), vectors[:1], 5, np.array([1e9]))) == []
    (_, at, score, _), = lists.top(np.array([-1]), vectors[:1], 5, np.array([float(full[order[2]])]))
    assert score.tolist() == [x for x in full[order].tolist() if x >= full[order[2]]]


def test_top_k_large_products_and_empty_vectors(spark):
    rng = np.random.default_rng(11)
    big = [(i, (rng.normal(0, 1, 6) * 10.0 ** (7 if i % 3 else 1)).tolist()) for i in range(90)]  # products beyond 2**53
    huge = [(i, [1e9 + i, i / 3 - 1e9]) for i in range(1, 30) if i != 20] + [(40, [1e9, 1e9]), (60, [1e-3, 2e-3]), (61, [-2e9, -1e9])]  # sums whose products are beyond 2**63
    for rows, blocks in ((big, {}), (big, {"candidates": 25, "per_block": 2}), (huge, {}), ([(0, []), (20, [0.5]), (3, []), (4, [-0.5, 1.0]), (5, [1.0])], {}), ([(0, []), (1, [])], {})):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        levels = topk.levels(table)
        got = {tuple(r) for r in topk.top_k(levels, levels.where("vec_id % 20 = 0"), 20, **blocks).select("query_id", "rank", "vec_id", "score").collect()}
        whole, want = {i: [math.floor(64 * x) for x in v] for i, v in rows}, set()
        for q in whole:
            if q % 20 == 0:
                scores = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
                want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:20])}
        assert got == want


def test_top_k_few_and_none(spark):
    one = spark.createDataFrame([(0, [1, 2]), (5, [3])], "vec_id long, v array<long>")
    assert [tuple(r)[:4] for r in topk.top_k(one, one.where("vec_id = 0"), 20).collect()] == [(0, 1, 5, 3)]
    assert topk.top_k(one.limit(0), one.limit(0), 20).collect() == []


def test_mixing_odd(spark, odd_docs):
    out = mixing.mix(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    sizes = {}
    for r in odd_docs.select("source", "text").collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
    want = brute.targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs).collect()))


def test_mixing_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.col("doc_id") % 4)
    docs = docs.withColumn("source", F.concat(F.lit("s"), F.col("source").cast("string")))
    for inclusion in (None, F.lit(1.0) + (F.col("doc_id") % 3) / 4):
        out = mixing.mix(docs, inclusion=inclusion)
        for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
            assert abs(r["t"] - r["g"]) <= r["m"] / 2


def test_mixing_takes_what_a_plain_version_takes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 5 < 4, F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))))
    docs = docs.withColumn("k", F.col("doc_id") * 2)
    rows = [(r["k"], r["source"], len(brute.WORD.findall(r["text"] or "")), r["u"]) for r in docs.select("k", "source", "text", mixing.draw(17).alias("u")).collect()]
    assert {r["row"]: r["copies"] for r in mixing.mix(docs, key="k").collect()} == brute.mixed(rows)


def test_mixing_takes_rows_as_often_as_their_odds_say(spark):
    """Over many seeds: documents of unequal size of one source are taken about as often as p says."""
    rows = [(i, "w " * (5 + 3 * i), "big") for i in range(60)] + [(100 + i, "w " * 40, "small") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    seeds, taken, odds = 40, {}, {}
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed).where("source = 'big'").select("doc_id", "copies", "p").collect():
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"] / seeds
            odds[r["doc_id"]] = r["p"]
    assert max(odds.values()) > 3 * min(odds.values())
    ids = sorted(odds)
    for part in np.array_split(ids, 3):
        assert np.mean([taken[i] for i in part]) == pytest.approx(np.mean([odds[i] for i in part]), abs=0.08)


def test_mixing_is_settled_by_ids_and_texts(spark):
    """Null and repeated ids with texts of one length: two orders of the rows give each text as many copies."""
    rows = [(None if i % 2 else i % 5, " ".join(f"w{(i * 7 + k) % 10}" for k in range(9)) + " " + "xyz"[i % 3] * 3 + str(100 + i), "a" if i % 3 else "b") for i in range(90)]
    rows += [(None, "same words here", "a")] * 6 + [(i, "w " * 400, "a") for i in range(3)]

    def told(some, parts):
        docs = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(parts).withColumn("k", F.monotonically_increasing_id())
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out = mixing.mix(docs, key="k").select(F.col("row").alias("k"), "copies", "p").join(docs, "k").groupBy("doc_id", "text", "source").agg(F.sum("copies").alias("n"), F.max("p").alias("p"))
        return {(r["doc_id"], r["text"], r["source"]): (r["n"], round(r["p"], 9)) for r in out.collect()}

    first = told(rows, 3)
    assert first == told(rows[::-1], 5) and len({p for _, p in first.values()}) > 3
    assert 0 < sum(n for n, _ in first.values())


def test_mixing_takes_certain_rows(spark):
    """Rows whose odds would be above 1 are certain; the others' odds still add up to the source's rest."""
    rows = [(i, "w " * (4 + i % 5), "a") for i in range(300)] + [(400 + i, "w " * 300, "a") for i in range(4)] + [(500 + i, "w " * 500, "b") for i in range(6)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cycle=(1.0, 1.1)).where("source = 'a'").collect()
    left = out[0]["target"]  # less than the source has, so there are no whole copies
    assert {400, 401, 402, 403} <= {r["doc_id"] for r in out if r["p"] == 1} and sum(r["p"] < 1 for r in out) > 100
    assert all(r["copies"] == 1 for r in out if r["p"] == 1)
    assert sum(r["p"] * r["size"] for r in out) == pytest.approx(left)


def test_mixing_empty_and_capped(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, "w " * 10, "big") for i in range(100)] + [(i, "w " * 10, "tiny") for i in range(100, 102)]
    got = {r["source"]: (r["target"], r["t"]) for r in mixing.mix(spark.createDataFrame(rows, schema)).groupBy("source", "target").agg(F.sum("taken").alias("t")).collect()}
    assert got == {"tiny": (60.0, 60), "big": (960.0, 960)}


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("alpha", "breve", "crate", "delta", "ember") for b in range(40)]
    rows, labels = [], []
    for i in range(1600):
        own = list(rng.choice(words, 40))
        toxic = i % 8 == 0
        if toxic:
            own[5] = "nasty" + str(rng.integers(3))
        rows.append((i, " ".join(own), 1.0))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None, 0.0), (5001, "", 0.0), (None, "x", 0.0)], "doc_id long, text string, score double")
    out = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")))
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [i for i in got if i is not None and i < 1600 and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 8 == 0) for i in held]) > 0.98
    assert got[5000]["score"] == got[5001]["score"] and got[5000]["predicted"] == 0 and not got[None]["held_out"]


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id")
    hit, said, true = out.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    # in some languages the words of toxic documents also turn up in clean ones
    assert hit / said >= 0.75 and hit / true >= 0.9


def test_toxicity_sample_is_bounded_where_ids_repeat(spark):
    rows = [(i % 4, f"text number {i} nasty", 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, toxic int"), positives=2, unlabelled=2)
    assert toxicity.score(docs, model).count() == 400


@pytest.mark.parametrize("k", [0, 5, 700, 9_000, 20_000])
def test_toxicity_sample_is_the_rows_of_lowest_hash(spark, k):
    """The bound on the hash changes nothing but how many rows are sorted."""
    ids = spark.range(0, 60_000, 3).withColumnRenamed("id", "doc_id").cache()
    want = [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(k).collect()]
    for n in (18_500, 20_000, 21_500):  # counts that are a little off
        assert [r[0] for r in toxicity.lowest(ids, n, k, 7).collect()] == want


def test_toxicity_does_not_read_held_out_labels(spark, odd_docs):
    held = odd_docs.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", F.lit(1).alias("toxic"))
    model = toxicity.train(odd_docs, held)
    assert len(model.weights) == 0 and toxicity.score(odd_docs, model).where("predicted = 1").count() == 0
    assert toxicity.score(odd_docs.limit(0), model).collect() == []


def test_nnpu_risk_does_not_fit_all_unlabelled_as_negative():
    rng = np.random.default_rng(1)
    n = 400
    positive = np.arange(n) < 100
    truth = positive | (np.arange(n) % 3 == 0)
    rows, found = [], []
    for i in range(n):
        rows += [i, i]
        found += [0 if truth[i] else 1, int(rng.integers(2, 12))]
    w, b = toxicity.fit_nnpu(np.array(rows), np.array(found), positive, 12, 0.33)
    assert w[0] > w[1] and 1 / (1 + np.exp(-(b + w[0]))) > 0.5 > 1 / (1 + np.exp(-(b + w[1])))


def test_toxicity_scores_of_one_text_do_not_depend_on_the_batch():
    model = toxicity.Model(np.array([], np.uint64), np.array([]), -1.0)
    assert model.score(pa.array(["a", None, ""])).tolist() == [1 / (1 + np.exp(1.0))] * 3


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"),
        ("<ul><li>x<li>y</ul>", " - x\n - y"), ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", " - a\n    - b\n - c"),
        ("<script>var a='</p>'</script>x<style>p{}</style>", "x"), ("<p hidden>a</p>b<span style='display: none'>c</span>", "b"), ("<title>t</title>b", "b"),
        ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"), ("a&amp;b&lt;", "a&b<"), ("<pre>a\n  b</pre>", "a\n  b"),
        ("<a href=\"x>y\">link</a>", "link"), ("<!-- c -->x<!-- open", "x"), ("</div>x</p>y", "x\n\ny"), ("<b>a</b><i>b</i>", "ab"), ("<select><option>a<option>b</select>", "a\nb"),
        ("<table><tr><th>h</th></tr><tbody><tr><td colspan=2>wide</td><td>z</td></tr></table>", "h\nwide | z"), ("x <b>y</b> z", "x y z"), ("<p>a\n\n b</p>", "a b"),
        # text in a table outside its cells goes before it, as browsers show it
        ("<table><tr><td>a</td></tr>foo</table>", "foo\n\na"), ("<table>foo<tr><td>a</table>", "foo\n\na"), ("<table><tr>loose<td>a", "loose\n\na"),
        ("<table><tr><div>in</div><td>a</td></tr></table>z", "in\n\na\n\nz"), ("<table><tr><td>x<table>y<tr><td>z</table></table>", "xy\n\nz"),
        ("<table><tr><td>a<td>b|</table>", "a | b|"), ("<table><tr><td>a<td><tr><td>b<td>c</table>", "a\nb | c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<td>d</table>", "a | b\n  | c | d"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<div style='visibility:hidden'>x<b style='visibility: visible'>y</b>z</div>w", "y\nw"), ("<div style='display:none'>x<b style='visibility:visible'>y</b></div>w", "w"),
        # style sheets: the more specific rule counts, of equal ones the last; an element's own style comes first
        ("<style>.h{display:none}</style><p class='a h'>x</p>y", "y"), ("<style>.h{display:none}p.h{display:block}</style><p class=h>x</p><b class=h>z</b>y", "x\n\ny"),
        ("<style>#i{display:none}.h{display:inline}</style><b id=i class=h>x</b>y", "y"), ("<style>b{display:none}b{display:inline}</style><b>x</b>y", "xy"),
        ("<style>.h{display:none}</style><b class=h style='display:inline'>x</b>y", "xy"), ("<b hidden style='display:inline'>x</b>y", "xy"),
        ("<style>@media print{b{display:none}}/*b{display:none}*/ i, .k {visibility:hidden}</style><b>x</b><i>z</i><u class=k>w</u>y", "xy"),
        ("<style media=print>b{display:none}</style><b>x</b>y", "xy"), ("<style>div b{display:none}b:hover{display:none}b</style><b>x</b>y", "xy"), ("<style>b{display:none", ""),
        ("<style>b{backface-visibility:hidden;x-display:none}</style><b>x</b>y", "xy"),
        ("<details>a<summary>s</summary>b<p>c</p></details>y", "s\ny"), ("<details open><summary>s</summary>b</details>y", "s\nb\ny"), ("<details>a</details>y", "y"),
        ("<table><tr><td>日本<td>a<tr><td>abc<td>b<tr><td>e\u0301<td>c</table>", "日本 | a\nabc  | b\ne\u0301    | c"),
        ("<svg><title>t</title><text>hi</text><desc>no</desc></svg>", "hi"), ("<math><mi>x</mi><annotation>no</annotation></math>", "x"),
    ],
)
def test_layout(html, text):
    assert html_layout.rendered(html) == text


def test_layout_is_not_recursive_and_loses_no_text():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert html_layout.rendered(deep) == "x"
    assert html_layout.rendered("<table>" * 2000 + "x") == "x"


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<table><tr><td>" + "<b>" * n + "<p>x" * n, lambda n: "<div>" * n + "<li>x" * n, lambda n: "<table>" + "<div>x" * n])
def test_layout_takes_no_longer_than_the_page(make):
    """Stray tags look for no element through all open ones: ten times the tags take some ten times as long, not a hundred times."""
    import time

    def seconds(n):
        page = make(n)
        begun = time.process_time()
        html_layout.rendered(page)
        return time.process_time() - begun

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.02)


def test_layout_against_a_plain_tree():
    """Random tags: the tree is that of a builder that looks through all open elements for each rule."""
    import random

    r = random.Random(7)
    tags = "p div b i ul li table tr td th tbody caption dl dt dd select option h1".split()

    def last(opened, wanted):
        return max((k for k, e in enumerate(opened.nodes) if k and e.tag in wanted), default=0)

    for _ in range(300):
        page = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"w{k} "]) for k in range(r.randint(1, 60)))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(html_layout.Open, "last", last)
            plain = html_layout.rendered(page)
        assert html_layout.rendered(page) == plain, page


def test_layout_table(spark, sf):
    """Every word of a page's paragraphs is in its text, no script is."""
    import re
    from html import unescape

    pages_ = spark.read.parquet(f"{sf}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in html_layout.extract(pages_).collect()}
    for r in pages_.collect():
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", r["html"])
        words = unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = texts[r["page_id"]].split()
        missing = set(words) - set(got) - {w for w in words if w in texts[r["page_id"]]}
        assert not missing, (r["page_id"], list(missing)[:5])
        assert "track(" not in texts[r["page_id"]]
    odd = spark.createDataFrame([(1, None, 2), (None, "<p>a", 2), (1, None, 2)], "page_id long, html string, text int")
    same(html_layout.extract(odd), [(1, ""), (None, "a"), (1, "")])


def test_odd_docs_are_read_whole(spark, odd_docs):
    assert max(len(t or "") for _, t in pairs(odd_docs)) == 150_000
