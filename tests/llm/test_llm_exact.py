"""Each operator against a brute-force version, the library it stands for, or a round trip."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from silvergrain.llm import chat, components, html, jaccard, mixing, neardup, pieces, quality, records, registry, sharding, shingles, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHABET = "ab the in on  \n.▁éß漢1-é\t'%𝄞"


@pytest.fixture(scope="module")
def texts(data):
    t = pq.read_table(f"{data}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


# ---------------------------------------------------------------- 1: quality


def slow_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), failed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "\n", "x#", "é", " ", "\v", "%"]), max_size=60))
def test_measures_of_any_text(parts):
    text = " ".join(parts)
    d = quality.Doc(text)
    assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed) == slow_measures(text)


def test_op1(spark, data, texts):
    got = {r.doc_id: r for r in registry.op1_quality_rules(spark, data).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_measures(t)
        assert r.kept == (not r.base_failed and not any(rule.rejects(quality.Doc(t)) for rule in quality.RULES))


def test_cascade_puts_cheap_rejections_first_and_stops(spark):
    calls = []
    never = quality.Rule("never", lambda d: sum(range(20_000)) < 0)
    always = quality.Rule("always", lambda d: True)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert [r.name for r in quality.plan_cascade(docs, (never, always))] == ["always", "never"]
    spy = quality.Rule("spy", lambda d: calls.append(1) or False)
    assert quality.first_rejection(quality.Doc("x"), [always, spy]) == "always" and not calls


def test_clean_labelled_documents_are_kept(spark, data):
    good = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    judged = quality.assess(spark.read.parquet(f"{data}/documents.parquet").join(good, "doc_id", "left_semi"))
    assert judged.where("NOT base_failed AND NOT kept").count() == 0


# ---------------------------------------------------------------- 2 and 10: tokens


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=80) | st.text(max_size=40))
def test_pieces_equal_the_library(text):
    import sentencepiece

    path = registry.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = text.encode("utf-8", "ignore").decode()
    ids = np.frombuffer(pieces.model(path).encode_batch([text])[0], "<i4").tolist()
    assert ids == library.encode(text)
    assert pieces.model(path).decode_batch(pieces._lists(pieces.model(path).encode_batch([text]))).to_pylist() == [library.decode(ids)]


def test_pieces_decode_ids_that_no_text_has():
    import sentencepiece

    path = registry.vocabulary("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    lists = [[rng.randrange(259, 32_000) for _ in range(rng.randrange(12))] for _ in range(300)]
    got = pieces.model(path).decode_batch(pieces._lists([np.array(x, "<i4").tobytes() for x in lists])).to_pylist()
    assert got == [library.decode(x) for x in lists]


def test_op2(spark, data, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in registry.op2_sentencepiece(spark, data).collect()}
    for i, t in texts.items():
        ids = library.encode(t or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET + "'st   \x1c\x85<|endof>", max_size=60) | st.text(max_size=40))
def test_chunks_equal_the_library(text):
    coder = records.tokenizer(registry.vocabulary("byte_bpe_50k.json"))
    text = text.encode("utf-8", "ignore").decode()
    for t in (text, text + "<|endoftext|> " + text):
        assert np.frombuffer(coder.encode_batch([t])[0], coder.kind).tolist() == coder.library.encode(t, add_special_tokens=False).ids


def test_op10(spark, data, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in registry.op10_token_records(spark, data).collect()}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_checksums_and_damage():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (4, 7, 511, 512, 513, 5000)]
    framed = records.frames(parts)
    sizes = [len(f) for f in framed]
    assert records.unframed(b"".join(framed), sizes) == parts
    bad = bytearray(b"".join(framed))
    bad[100] ^= 1
    with pytest.raises(ValueError):
        records.unframed(bytes(bad), sizes)


# ---------------------------------------------------------------- 3, 7, 8: native


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = registry.queries()[name](spark, data)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_tool_calls_link_order_and_validate(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": json.dumps(args)}
    rows = [
        (1, 0, "tool", json.dumps({"content": "late log", "tool_call_id": "c1"})),  # the log has it before its call
        (1, 1, "user", "go"),
        (1, 2, "assistant", json.dumps({"content": None, "tool_calls": [call("c1", "add", {"b": 1, "a": {"z": 1, "y": 2}}), call("c2", "add", {"a": "no"})]})),
        (1, 3, "tool", json.dumps({"content": "r2", "tool_call_id": "c2"})),
        (1, 4, "tool", json.dumps({"content": "lost", "tool_call_id": "nope"})),
        (2, 2, "tool", json.dumps({"content": "other talk", "tool_call_id": "c1"})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = {"add": {"a": ("object", True), "b": ("integer", False)}}
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(chat.parse_messages(df), schemas).collect()}
    assert (got[1, 0].linked, got[1, 0].anchor_turn, got[1, 0].level) == (True, 2, 1)
    assert (got[1, 3].linked, got[1, 3].anchor_turn, got[1, 3].level) == (True, 3, 0)
    assert not got[1, 4].linked and not got[2, 2].linked
    assert got[1, 2].n_calls == 2 and not got[1, 2].valid
    assert '"arguments":"{\\"a\\":{\\"y\\":2,\\"z\\":1},\\"b\\":1}"' in got[1, 2].json
    assert list(json.loads(got[1, 2].json)) == sorted(json.loads(got[1, 2].json))


def test_results_that_call_are_ordered_after_their_calls(spark):
    calls = "array<struct<id:string,name:string,arguments:string>>"
    rows = [(1, 0, "tool", "x", None, "b"), (1, 1, "tool", "y", [("b", "t", "{}")], "a"), (1, 5, "assistant", "z", [("a", "t", "{}")], None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content string, calls {calls}, result_of string")
    got = sorted((r.anchor_turn, r.level, r.content) for r in chat.format_chats(df, {"t": {}}).collect())
    assert [g[2] for g in got] == ["z", "y", "x"]


def test_table_is_filled_by_turns_and_spread_evenly(spark):
    names, size = ["a", "b", "c"], 101
    owner = sharding.fill_table(names, size)
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders.append([(first + k * step) % size for k in range(size)])
    slow, turn = {}, 0
    while len(slow) < size:
        slow[next(s for s in orders[turn % 3] if s not in slow)] = turn % 3
        turn += 1
    assert owner == [slow[s] for s in range(size)]
    counts = Counter(sharding.fill_table(registry.SHARDS))
    assert max(counts.values()) - min(counts.values()) <= 1
    before, after = sharding.fill_table(registry.SHARDS), sharding.fill_table(registry.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != len(registry.SHARDS) - 1)
    assert moved < 0.15 * len(before)
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    placed = sharding.place(rows, "doc_id", names, size).collect()
    assert all(r.shard == names[owner[r.slot]] for r in placed)
    plan = sharding.place(rows, "doc_id", names, size)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], size=100)


def test_mix_hits_its_weights(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"), (F.col("id") % 50 + 1).alias("n_chars"))
    weights = {"hot": 1.0, "s0": 1.0, "s1": 2.0, "s3": 40.0}
    mixed = mixing.replicate(docs, weights, seed=3)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    total = sum(got.values())
    assert got.keys() == weights.keys() and all(abs(got[s] / total - w / 44) < 0.01 for s, w in weights.items())
    again = mixing.replicate(docs.repartition(7), weights, seed=3)
    assert mixed.exceptAll(again).count() == 0
    rates = {r.source: r.rate for r in mixing.rates(docs, weights)[0].collect()}
    per_doc = Counter(r.n for r in mixed.where("source = 's0'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    n = docs.where("source = 's0'").count()
    for k in (1, 2):
        assert abs(per_doc[k] / n - math.exp(-rates["s0"]) * rates["s0"] ** k / math.factorial(k)) < 0.02
    few = spark.createDataFrame([(1, "tiny", 1)] + [(i, "big", 100) for i in range(2, 300)], "doc_id long, source string, n_chars long")
    counted = mixing.replicate(few, seed=1).where("source = 'tiny'").count()
    mean = few.agg(F.sum("n_chars")).head()[0] / 2
    assert abs(counted - mean) < 6 * math.sqrt(mean)  # a mean of thousands, drawn in parts


# ---------------------------------------------------------------- 4 and 6: pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar"><header class="top"><h1>Site</h1><nav><ul>{links}</ul></nav></header>
<div id="cookie-notice">We use cookies, really we do.</div><div class="wrap">{open}<h1>The title &amp; more</h1><p>First&nbsp;paragraph with <a href="#">a link</a> and <b>bold</b> words that go on for a while.<p>Second <i>para</i>graph,
  over lines, long enough to matter in any measure of density.<ul><li>one<li>two</ul><div class="ad">Buy this now</div>{close}<div class="sidebar"><ul>{links}</ul></div></div>
<form><label>Mail</label><input></form><section id="comments"><article class="comment"><p>A reader comments at some length on all of this, as readers do.</p></article></section><footer>&copy; us</footer><script>w("<p>no</p>")</script></body></html>"""


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>")])
def test_page_furniture_goes(wrap):
    page = PAGE.format(links="<li><a href='x'>Menu entry</a></li>" * 12, open=wrap[0], close=wrap[1])
    assert html.extract(page) == "The title & more First paragraph with a link and bold words that go on for a while. Second paragraph, over lines, long enough to matter in any measure of density. one two"


def test_op4_equals_the_article(spark, data):
    rows = registry.op4_html_text(spark, data).join(spark.read.parquet(f"{data}/pages.parquet"), "page_id").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(__import__("html").unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", re.sub(r"<[^>]*$", "", inner)))
        want = " ".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "text ", "&amp;", "<li>", "<td>", "<table>", "</table>", "<!--", "-->", "<script>", "</script>", "<", ">", "<br/>", "<article>", "</article>"]), max_size=40))
def test_any_markup_is_survived(parts):
    assert isinstance(html.extract("".join(parts)), str)


def test_archives_of_both_versions_and_their_damage(spark, tmp_path):
    import io

    for version in (b"1", b"2"):
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\nContent-Length: 2\r\n\r\nhi"
        good = warc.member(warc.arc_version_block(version, "f", "20200102030405")) + warc.member(warc.arc_header(version, "http://x/", "20200102030405", "text/html", len(block)) + block + b"\n")
        (_, header, got), = warc.arc_records(io.BytesIO(good))
        assert got == block and header["url"] == "http://x/" and header["date"] == "20200102030405"
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(warc.member(b"http://x/ 0 0 0 1\n"))))
        short = warc.member(warc.arc_version_block(version, "f", "2020")) + warc.member(warc.arc_header(version, "u", "2020", "t", 99) + b"x")
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(short)))
        with pytest.raises(ValueError):
            list(warc.arc_records(io.BytesIO(good[:-20])))
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z"


def test_payloads_come_back(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    from silvergrain.llm.runtime import new_folder

    warcs = warc.convert(spark, warc.write_arcs(pages, new_folder(spark, "a")), new_folder(spark, "b"))
    got = {r.page_id: bytes(r.payload) for r in warc.read_warcs(spark, warcs).where("record_type = 'response'").collect()}
    assert got and all(got[r.page_id] == r.html.encode() for r in pages.collect() if r.page_id in got)


# ---------------------------------------------------------------- 5 and 9: near duplicates


def slow_components(sets, linked):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def word_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def slow_jaccard(texts):
    sets, by = {i: word_set(t) for i, t in texts.items()}, defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    linked = []
    for i, s in sets.items():
        counts = Counter(j for x in s for j in by[x] if j < i)
        linked += [(i, j) for j, c in counts.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
    return {i: (len(sets[i]), c) for i, c in slow_components(sets, linked).items()}


def planted(seed, base_words=60, groups=6, copies=14):
    """Documents with chains of edits, shared passages and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage, out = [word() for _ in range(40)], {}
    for g in range(groups):
        base = [word() for _ in range(base_words)] + (passage if g % 2 else [])
        for c in range(copies):
            edited = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                edited[rng.randrange(len(edited))] = word()
            if rng.random() < 0.2:
                edited = edited[: rng.randint(3, len(edited))]
            if rng.random() < 0.3:
                base = edited
            out[g * 100 + c] = " ".join(edited)
    return out


@pytest.mark.parametrize("seed,hot", [(1, 50), (2, 3), (3, 5), (4, 2)])
def test_jaccard_join_equals_all_pairs(spark, seed, hot):
    texts = planted(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, hot=hot).collect()}
    assert got == slow_jaccard(texts)


def test_a_short_hot_list_changes_nothing(spark):
    texts = planted(9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, hot=2, most_hot=40).collect()}
    assert got == slow_jaccard(texts)


def test_op5(spark, data, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in registry.op5_jaccard_join(spark, data).collect()} == slow_jaccard(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300))
def test_packing(values):
    a = np.sort(np.array(values, np.uint64))
    assert (np.cumsum(shingles.unpack(shingles.pack(shingles.steps(a))), dtype=np.uint64) == a).all()


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)]
    nodes = {x for link in links for x in link if link[0] != link[1]}
    want = slow_components({i: None for i in nodes}, [x for x in links if x[0] != x[1]])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def vectors_with_copies(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = np.concatenate([base[: n // 4] + s * rng.standard_normal((n // 4, dim)) for s in (0.05, 0.2, 0.3)])
    crowd = base[-1] + 0.05 * rng.standard_normal((150, dim))
    return np.concatenate([base, near, crowd, base[:10]]).astype("float32")


@pytest.mark.parametrize("large", [4096, 20])
def test_near_duplicates_reach_their_recall_and_add_none(spark, large):
    m = vectors_with_copies(1)
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in neardup.near_duplicates(rows, large=large).collect()}
    want = Counter(links.ravel().tolist())
    assert all(got[i].n_links <= want[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(links)
    whole = slow_components({i: None for i in got}, links.tolist())
    assert all(whole[r.component_id] == whole[i] and r.kept == (i == r.component_id) for i, r in got.items())


def test_calibration_keeps_its_promise():
    for n in (500, 50_000, 10**8):
        signs, tables = neardup.calibrate(n)
        assert neardup.tail(tables, neardup.collision_probability(0.9, signs), neardup.LEAST_COUNT) >= neardup.RECALL


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages_by_hand(spark, data, texts):
    import sentencepiece

    t = pq.read_table(f"{data}/documents.parquet").to_pylist()
    kept = [r for r in t if not any(rule.rejects(quality.Doc(r["text"])) for rule in quality.RULES)]
    groups = slow_jaccard({r["doc_id"]: r["text"] for r in kept})
    kept = [r for r in kept if groups[r["doc_id"]][1] == r["doc_id"]]
    size = Counter()
    for r in kept:
        size[r["source"]] += r["n_chars"]
    library = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
    want = Counter()
    for r in kept:
        rate = sum(size.values()) / len(size) / size[r["source"]]
        u = int(hashlib.md5(f"{registry.MIX_SEED}|{r['doc_id']}|1".encode()).hexdigest()[:13], 16) / 16**13
        p = c = math.exp(-rate)
        n = 0
        while u >= c:
            n += 1
            p *= rate / n
            c += p
        want[r["doc_id"], tuple(library.encode(r["text"]))] += n
    got = corpus_pipeline.run(spark, data)
    assert got.where("NOT exact").count() == 0
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == +want


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), data).columns == docs.columns
        assert stage(spark, docs.limit(0), data).count() == 0
