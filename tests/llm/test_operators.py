"""The training-data operators against SQL, brute force, round trips and held-out rows; and their edge cases."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsift.llm import chat, components, decontaminate, dom, exact, htmlmodel, htmlpages, kernels, langid, linedup, minhash, mixing, quality, queries, warc
from loomsift.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, n long, cut string"
ODD = [
    (1, None, None, None, None, 1, 1, 1, "x"),
    (2, "", "en", "a", 0, 1, 1, 1, "x"),
    (3, " \n\t ", "en", "a", 4, 1, 1, 1, None),
    (4, "One two three four five six seven.", "en", "b", 34, 1, 1, 1, "x"),
    (4, "One two three four five six seven.", "en", "b", 34, 1, 1, 1, "x"),
    (5, "ONE two three four five six seven.", "de", None, 34, 1, 1, 1, "x"),
    (6, "word " * 30000, "en", "b", 150000, 1, 1, 1, "x"),
    (7, "été", "fr", "é", 3, 1, 1, 1, "x"),
    (8, "12 34 !!", "fr", "", 8, 1, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents benchmark pages conversations labels".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(queries.SQL[name])
    want = cur.fetchall()
    assert table(df.columns, got) == table([d[0] for d in cur.description], want)


# ---- kernels ----
def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    import pyarrow as pa

    texts = ["The cat  sat\ton", "", None, "a", "the CAT", "x" * 50 + " y z"]
    d, o = kernels.string_buffer(pa.array(texts))
    h, first = kernels.word_hashes(d, o)
    assert [int(x) for x in first] == [0, 4, 4, 4, 5, 7, 10]
    monkeypatch.setattr(kernels, "SEGMENT", 7)
    assert (kernels.word_hashes(d, o)[0] == h).all() and h[0] == h[5]


def test_words_of_few_letters_do_not_collide():
    import itertools

    import pyarrow as pa

    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate({97: 98, 98: 97})
    words = [thue, thue.translate({97: 98, 98: 97}), *("".join(x) for n in range(1, 14) for x in itertools.product("ab", repeat=n)), "ab" * 40 + "c", "ab" * 39 + "cab"]
    h, _ = kernels.word_hashes(*kernels.string_buffer(pa.array([" ".join(words)])))
    assert len(h) == len(words) == len(set(h.tolist()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (60, 60), (70, 71), (70, 71)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[50] == got[45] == got[40] == 40 and got[71] == 70 and 60 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_one_task_and_by_rounds(spark, monkeypatch):
    r = np.random.default_rng(11)
    edges = [(int(a), int(b)) for a, b in r.integers(-40, 140, (110, 2))] + [(i, i + 7) for i in range(1000, 1200, 7)] + [(None, 1), (2, None)]
    want = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            both = want.setdefault(a, {a}) | want.setdefault(b, {b})
            want |= dict.fromkeys(both, both)
    wrote = []
    monkeypatch.setattr(components, "materialize", lambda df, label="table", f=components.materialize, **k: (wrote.append(label), f(df, label, **k))[1])
    docs = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {x.v: x.component for x in connected_components(docs).collect()} == {v: min(x) for v, x in want.items()}
    assert len(wrote) == 2  # each further table is a plan more that the driver keeps
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert {x.v: x.component for x in connected_components(docs).collect()} == {v: min(x) for v, x in want.items()}
    assert len(wrote) > 6


# ---- 1 ----
def test_line_dedup_odd(odd, none):
    assert linedup.dedup_lines(odd).count() == len(ODD) and linedup.drop_repeated_lines(none).count() == 0


# ---- 2 ----
def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://A.example.com/x?y#z", big, 1), (2, "http://a.example.com/x?y", big, 1), (3, None, None, 1), (4, "no url\r\n", "short", 1), (5, "http://b.example.com/", "short", 1), (5, "http://b.example.com/", "short", 1)]
    rows += [(100 + i, f"http://host.example.org/{i % 7}", f"<p>page {i}" * 20, 1) for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    captures, folder = warc.write_archives(pages)
    back = {}
    for r in warc.read_archives(captures, folder).collect():
        back[r.page_id] = r
    assert len(back) == len(rows) - 1 and back[1].record_type == "response" and back[2].refers_to == 1 and back[2].payload_bytes == len(big) and back[2].payload_digest == back[1].payload_digest
    assert back[3].payload_bytes == 0 and back[4].record_type == back[5].record_type == "response" and all(r.intact for r in back.values())
    index = warc.CaptureIndex(captures, folder)
    asked = spark.createDataFrame([(u, p) for p, u, _, _ in rows if p % 20 == 0] + [("http://nowhere.example/", None), ("http://host.example.org/3", None)], "url string, page_id long")
    found = collections.Counter(r.page_id for r in index.lookup(asked).collect())
    assert {p for p, *_ in rows if p % 20 == 0} <= set(found) and sum(1 for p, u, *_ in rows if u == "http://host.example.org/3") <= sum(found.values())
    empty = warc.archive_report(pages.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("revisits", [500_000, 1])
def test_warc_revisits(spark, revisits, monkeypatch):
    monkeypatch.setattr(warc, "REVISITS", revisits)
    big, other = "<p>" + "x" * 200, "<p>é" + "y" * 98
    html = [big, other, None, "", "short"]
    rows = [(i if i % 11 else None, None if i % 13 == 0 else f"http://h{i % 5}.example/{i % 17}", html[i % 5], "p") for i in range(1, 400)] + [(398, "u", big, "p")]
    got = warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.intact for r in got) and all(r.indexed for r in got if r.page_id is not None and r.page_id % 20 == 0)
    least = {}
    for i, _, h, _ in rows:
        if i is not None and h and len(h.encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    import hashlib

    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i is not None and h in least and least[h] < i else "response", str(least[h]) if i is not None and h in least and least[h] < i else "None") for i, _, h, _ in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want


# ---- 3 ----
def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, ~langid.held_out())
    got = langid.identify(docs, model).join(docs, "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() and got.where("rejected").count() <= 0.01 * got.count()
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and rows[6].lang_pred in model.languages and 0 <= rows[7].score <= 1
    assert langid.keep_identified(none).count() == 0 and langid.identify(none, langid.train(none)).count() == 0
    assert langid.keep_identified(odd).columns == odd.columns


def test_language_not_learned_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where("lang <> 'fr'"))
    other, known = (langid.identify(docs.where(x), model).where("lang_pred <> 'und'") for x in ("lang = 'fr'", "lang <> 'fr'"))
    assert other.where("rejected").count() > 0.8 * other.count() and known.where("rejected").count() <= 0.005 * known.count()


def test_every_language_is_learned(spark, monkeypatch):
    """300 invented languages, one of 9,000 rows among languages of 25, each with syllables of its own."""
    monkeypatch.setattr(langid, "SAMPLE", 3000)
    r = random.Random(8)
    words = {f"l{k}": ["".join(chr(0x4E00 + (k * 61 + r.randrange(61))) for _ in range(3)) for _ in range(40)] for k in range(300)}
    rows = [(i, " ".join(r.choices(words[f"l{k}"], k=30)), f"l{k}") for i, k in enumerate(k for k in range(300) for _ in range(2000 if k == 7 else 25))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    assert np.mean([model.predict(t)[0] == lang for _, t, lang in rows[::17]]) > 0.95


def test_a_step_raises_the_right_class():
    at, n = [np.array([1, 5, 9])] * 2, [np.array([2.0, 1.0, 4.0])] * 2
    before = langid.fit(at, n, np.array([0, 0]), ["a", "b"], seed=3, epochs=0)
    after = langid.fit(at[:1], n[:1], np.array([0]), ["a", "b"], seed=3, epochs=1)
    share = n[0] / (n[0].sum() + langid.SHRINK)
    p = [np.exp((share @ m.table[at[0]]) + m.bias) for m in (before, after)]
    assert (p[1] / p[1].sum())[0] > (p[0] / p[0].sum())[0]


def test_language_scores_by_hand():
    """Counts of n-grams taken one by one, and the softmax over them, against the vectorised form."""
    text = "\u00c9t\u00e9, a\u00dfbc 12 a "
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    grams = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for k in (1, 2, 3, 4):
            padded = word if k == 1 else f"\0{word}\0"
            # a border at one end only
            grams += [g for i in range(len(padded) - k + 1) if (g := padded[i : i + k])[0] != "\0" or g[-1] != "\0"]
    want = collections.Counter()
    for g in grams:
        h = 0
        for c in g:
            h = (h * 0x100000001B3 + ord(c) + 1) & mask
        want[mixed((h + ((len(g) - 1) << 40)) & mask) & (langid.BUCKETS - 1)] += 1
    at, n = langid.counts(text)
    assert dict(zip(at.tolist(), n.tolist())) == dict(want)
    r = np.random.default_rng(9)
    model = langid.LanguageModel(["x", "y", "z"], r.normal(size=(langid.BUCKETS, 4)).astype(np.float32), r.normal(size=4), 0.1)
    z = [sum(float(model.table[b, k]) * c for b, c in want.items()) / (sum(want.values()) + langid.SHRINK) + model.bias[k] for k in range(4)]
    p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
    lang, score = model.predict(text)
    assert lang == "xyz"[int(np.argmax(p[:3]))] and math.isclose(score, max(p[:3]), rel_tol=1e-5)


# ---- 4 ----
def test_layouts(spark):
    texts = {
        "messages": '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}], "id": 7}',
        "from_value": '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        "prompt_response": '{"prompt": "q", "response": "a", "score": 0.5}',
        "instruction_input": '{"instruction": "do", "input": "this", "output": "a"}',
        "question_answer": '{"question": "q", "answer": "a"}',
        None: '{"weird": 1}',
        "turns": '{"messages": [{"role": "user", "text": "q", "name": "x", "tools": [{"a": 1}]}, {"role": "assistant", "text": "a"}], "prompt": "p"}',
        "prompt_completion": '{"prompt": "q", "completion": "a", "question": "q"}',
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "want string, json string").withColumn("record", F.parse_json("json"))
    rows = chat.format_records(df).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in rows:
        assert r.layout == r.want and r.back == r.turns
    by = {r.want: r for r in rows}
    assert [(t.role, t.text) for t in by["messages"].turns] == [("user", "q"), ("assistant", "")] and by["instruction_input"].turns[0].text == "do\nthis"
    assert by["from_value"].turns[0].role == "user" and by["from_value"].loss == "a" and by[None].formatted == ""
    assert [(t.role, t.text) for t in by["turns"].turns] == [("user", "q"), ("assistant", "a")] and by["prompt_completion"].turns[1].text == "a"


def test_conversation_rows(spark):
    rows = [(1, 2, "assistant", "same"), (1, 1, None, None), (1, 2, "assistant", "same"), (None, None, "user", "x" * 200000), (2, None, "user", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: r for r in chat.digest(chat.format_records(chat.conversation_records(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 8 and got[None].n_turns == 1 and got[2].loss_chars == 0 and len(got) == 3
    assert chat.digest(chat.format_records(chat.conversation_records(df.limit(0)))).count() == 0


def test_template_round_trip(spark):
    bits = ["<|end|>\n", "</s>", "[INST]", "<\\</s>", "\\", "<", "[/INST]", "<|turn|>", "<|body|>", "<<SYS>>", "\\\\[INST]", "é\U0001f600", "\n", "<|a|", "<\\\\|end|>"]
    r = np.random.default_rng(1)
    texts = ["".join(r.choice(bits, 6)) for _ in range(300)] + bits
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    e = df.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for row in e.collect():
        assert row.u == row.t and not re.search(chat._PLAIN.replace(r"(\\*)", ""), row.e)


# ---- 5 ----
def test_short_items(spark):
    docs = [(1, "Is this the END of it?"), (2, "the end"), (3, "今天天气很好。我们去公园，好吗"), (4, "end the"), (None, "the end"), (5, "")]
    docs = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int")
    items = spark.createDataFrame([(1, "the, end"), (2, "我们去公园 好吗"), (3, ""), (4, None), (5, "one two three four"), (None, "end"), (1, "the end")], "item_id long, text string")
    got = [(r.doc_id, r.item_ids) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, "1"), (2, "1"), (3, "2"), (4, ""), (None, ""), (5, "")], key=str)
    assert sorted(str(r.doc_id) for r in decontaminate.drop_contaminated(docs, items).collect()) == ["4", "5", "None"]


def test_contained_items(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(40))
    cut = " ".join(f"w{i}" for i in range(37))
    half = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "pre " * 500 + item.upper() + " post" * 900), (2, cut), (3, half), (4, None), (5, "too short text"), (6, item.replace(" ", ", "))]
    docs = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, item_id int, n int")
    items = spark.createDataFrame([(1, item, 0), (2, "a b", 0), (3, None, 0), (4, "other words entirely are in this item", 0)], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (True, "1"), 2: (True, "1"), 3: (False, ""), 4: (False, ""), 5: (False, ""), 6: (True, "1")}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.contamination(none, items).count() == 0 and decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0


# ---- 6 ----
def test_exact(spark, odd, none):
    rows = [(i, "Same TEXT" if i % 3 else f"own {i}", 1) for i in range(900)] + [(1000, None, 1), (1001, "", 1), (1002, "x" * 300000, 1), (1003, "X" * 300000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(5)
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect()} == want
    assert exact.exact_duplicates(odd).count() == len(ODD) and exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(odd).columns == odd.columns and exact.drop_exact_duplicates(none).count() == 0


def test_exact_null_ids(spark):
    rows = [(None, "A"), (3, "a"), (1, "a"), (None, "b"), (None, "B"), (4, "c"), (4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (1, 3, 3, False), (None, None, 2, True), (None, None, 2, True), (4, 4, 1, True), (4, 4, 1, True)], key=str)
    assert sorted(str(r.doc_id) for r in exact.drop_exact_duplicates(docs).collect()) == ["3", "4", "4", "None", "None", "None"]


# ---- 7 ----
def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0


def test_quality_features_and_pairs(spark, odd):
    import pyarrow as pa

    x = dict(zip(quality.NAMES, quality.features(pa.array(["Ab c1\nab C1!", ""]))[0]))
    assert x["upper"] == 2 / 12 and x["lower"] == 4 / 12 and x["digit"] == 2 / 12 and x["newline"] == 1 / 12 and x["mark"] == 1 / 12
    assert math.isclose(x["words"], math.log1p(4)) and x["distinct"] == 3 / 4 and x["distinct_pairs"] == 1 and x["upper_of_letters"] == 2 / 6 and x["word_length"] == 9 / 4
    r = np.random.default_rng(1)
    z = r.normal(size=(400, len(quality.NAMES)))
    y = (z[:, 2] + 0.1 * r.normal(size=400) > 0).astype(int)
    s = quality.fit(z, y).score(z)
    assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) > 0.98 and np.mean((s >= 0.3) == (y == 1)) > 0.93
    labels = [(4, 1), (4, 1), (4, 0), (6, 0), (None, 1), (7, None), (8, 5), (99, 1)]
    model = quality.train(odd, spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, text string"))
    assert len(quality.score(odd, model).collect()) == len(ODD)


# ---- 8 ----
def test_near_duplicates_of_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(None, t, 1), (5, t, 1), (7, t + " end", 1), (None, None, 1), (7, t + " end", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 5).collect()), key=str)
    assert got == sorted([(None, None, True), (5, 5, True), (7, 5, False), (7, 5, False), (None, None, True)], key=str)
    assert sorted(str(r.doc_id) for r in minhash.drop_near_duplicates(docs, 5).collect()) == ["5", "None", "None"]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, block, rows_a_band", [(2, 1024, 4), (5, 1024, 4), (5, 4, 4), (2, 4, 1)])
def test_near_duplicates(spark, k, block, rows_a_band, monkeypatch):
    # bands of one row put unlike texts into the same buckets, so that the exact rest has work
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ROWS", rows_a_band)
    monkeypatch.setattr(minhash, "BANDS", 128 // rows_a_band)
    r = np.random.default_rng(3)
    base = [f"w{x}" for x in r.integers(0, 4000, 120)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two")]
    for i in range(5, 160):  # a large group of near copies, some at the threshold's edge, and passages shared by different texts
        w = list(base) if i % 3 else base[:60] + [f"x{x}" for x in r.integers(0, 9000, 40)]
        for j in r.choice(len(w), r.integers(0, 9), replace=False):
            w[j] = f"v{r.integers(0, 9999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, rep int, key int").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, k, 80).collect()}
    assert got == brute_components(rows, k, 80)


@pytest.mark.parametrize("fine_rows", [8, 1])
def test_exact_rest_has_a_row_a_document(spark, fine_rows, monkeypatch):
    """Not one for each place of a document in an open bucket, of which there are up to BANDS or FINE_BANDS."""
    for name, value in (("BLOCK", 4), ("ROWS", 1), ("BANDS", 128), ("FINE_ROWS", fine_rows), ("FINE_BANDS", 32)):
        monkeypatch.setattr(minhash, name, value)
    r = np.random.default_rng(5)
    common = [f"w{x}" for x in range(60)]
    rows = [(i, " ".join([*common, *(f"x{x}" for x in r.integers(0, 90, 40))])) for i in range(90)]
    counts = collections.defaultdict(list)

    def counted(df, label="table", f=minhash.materialize, **k):
        out = f(df, label, **k)
        counts[label].append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)
    assert counts["open"] and max(counts["open"]) > 2 * len(rows)
    assert max(counts["clustered"]) <= len(rows)


def test_near_duplicates_odd(spark, odd, none):
    got = minhash.near_duplicates(odd, 5, 80)
    assert got.count() == len(ODD) and {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(odd).columns == odd.columns


# ---- 9 ----
def test_html(spark):
    model = htmlmodel.trained(200)
    ok = n = 0
    for i in range(5000, 5100):
        t = dom.parse(htmlpages.page(i))
        p = model.marginals(t, htmlmodel.node_features(t))
        for e, _, _ in t.runs:
            ok, n = ok + ((p[e] > 0.5) == (t.keep[e] == "1")), n + 1
    assert ok > 0.98 * n
    page = "<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two <b>three</b>.<br><p>Four five six seven.</p></article><div class='comments'><p>Nice!</p></div><footer>&copy; x</footer><script>var t='</p>';</script>"
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (3, "u", "", 0), (4, "u", "<div>" * 3000 + "deep", 0), (5, "u", "<p", 0)]
    got = {r.page_id: r for r in htmlmodel.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()}
    assert got[1].text == "A & B\n\nOne two three.\n\nFour five six seven." and got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[5].text == ""


def test_marginals_are_those_of_all_states():
    """Sum-product against the sum over all states of small trees."""
    import itertools

    r = np.random.default_rng(7)
    for _ in range(12):
        n = int(r.integers(2, 9))
        t = dom.Tree()
        for i in range(1, n):
            t.parent.append(int(r.integers(0, i)))
            t.tag.append(str(r.choice(["p", "li", "article", "nav", "div"])))
        feats = [[int(x) for x in r.choice(len(htmlmodel.FEATURES), 3, replace=False)] for _ in range(n)]
        m = htmlmodel.TreeModel(r.normal(size=len(htmlmodel.FEATURES)).tolist(), r.normal(size=(htmlmodel.KINDS, 2, 2)).tolist())
        total, one = 0.0, np.zeros(n)
        for state in itertools.product((0, 1), repeat=n):
            e = sum(sum(m.unary[k] for k in feats[i]) * state[i] for i in range(n))
            e += sum(m.pair[htmlmodel._kind(t.tag[i])][state[t.parent[i]]][state[i]] for i in range(1, n))
            total += math.exp(e)
            one += np.array(state) * math.exp(e)
        assert np.allclose(m.marginals(t, feats), one / total)


#: (page, its text), written by hand.
HAND = [
    ("<html><head><title>T</title><meta name=x></head><body><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div class=story><h2>Storm hits the coast</h2><p>Waves of <em>ten</em> metres hit the harbour on Monday night, the port authority said.</p><p>Nobody was hurt.</p></div><div class=comments><p>First!</p><p>I was there and it was loud.</p></div></body></html>",
     "Storm hits the coast\n\nWaves of ten metres hit the harbour on Monday night, the port authority said.\n\nNobody was hurt."),
    ("<body><nav>Menu</nav><main><article><h1>Area of a disc</h1><p>It is <math><mi>&pi;</mi><msup><mi>r</mi><mn>2</mn></msup></math>, as everyone knows.</p><object data=f.swf>A film that shows it.<p>And here the text goes on after it.</p></article></main><footer>&copy; 2020</footer>",
     "Area of a disc\n\nIt is \u03c0r2, as everyone knows.\n\nA film that shows it.\n\nAnd here the text goes on after it."),
    ("<body><div class='cookie-notice'>We use cookies.</div><article><p>One long sentence stands here to be read by all of us today.<svg><text>12</text><p>A second long sentence stands here, behind a broken drawing.</p><ul><li>First point of the list.</li><li>Second point of the list.</li></ul></article><aside>Buy this</aside><form><label>Mail</label><select><option>a<option>b</select></form>",
     "One long sentence stands here to be read by all of us today.\n\nA second long sentence stands here, behind a broken drawing.\n\nFirst point of the list.\n\nSecond point of the list."),
]


@pytest.mark.parametrize("html, text", HAND)
def test_hand_written_pages(html, text):
    assert htmlmodel.trained(400).extract(html) == text


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for html in ("<a " * 100000 + '=">"', "<!" * 100000, "<a b='" * 100000, "<svg>" * 30000, "<template>" * 100000, "<!--" * 100000):
        dom.parse(html)
    assert time.time() - began < 30
    texts = [r[1] for r in dom.parse("<head><title>T</title><p>a<textarea>k</textarea>b<textarea>c</p><noscript><p>d</p><template><p>n</p></template><script>x</script ><select><option>o<p>e<script>f").runs]
    assert texts == ["a b c", "d", "e"]


def test_extract_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, n_chars int")
    assert htmlmodel.extract_text(none).count() == 0 and htmlmodel.extract_text(none).columns == ["page_id", "url", "text", "n_chars"]


# ---- 10 ----
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_mixing(spark, odd, none):
    r = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 5000), ("b", 40), ("c", 300), (None, 200), ("z", 3), ("d", 1000), ("e", 0)):
        rows += [(len(rows) + i, "w " * int(r.integers(1, 60)), s, 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(4)
    got = mixing.mix(docs).collect()
    again = {x.doc_id: x.taken for x in mixing.mix(docs.repartition(7)).collect()}
    other = {x.doc_id: x.taken for x in mixing.mix(docs, seed=12).collect()}
    assert again == {x.doc_id: x.taken for x in got} != other
    sizes, taken, goal = collections.Counter(), collections.Counter(), {}
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        goal[x.source] = x.target
        assert x.taken <= 3 * x.size and x.taken % x.size == 0
    want = brute_targets(sizes)
    assert len(got) == len(rows) and all(math.isclose(goal[s], want[s]) for s in sizes)
    assert all(abs(taken[s] - want[s]) <= max(60, 0.01 * want[s]) for s in sizes)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0 and mixing.take_mixture(none).count() == 0


def test_mixing_draws_rows_that_repeat_an_id_by_themselves(spark):
    rows = [(i % 7 if i % 2 else None, "w " * 50, "a" if i % 3 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(docs).collect()
    taken, goal = collections.Counter(), {}
    for x in got:
        taken[x.source] += x.taken
        goal[x.source] = x.target
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 100 for s in goal)
    mixed = mixing.take_mixture(docs).collect()
    by = collections.Counter()
    for x in mixed:
        by[x.source] += x.taken
        assert x.taken == 50 * x.copies
    assert by == taken and len(mixed) == sum(x.taken > 0 for x in got)


def test_flight_keeps_balance():
    r = random.Random(5)
    size = [r.randint(1, 500) for _ in range(400)]
    p = [r.random() for _ in range(400)]
    q = mixing.flight(p, size, r)
    assert sum(1e-9 < x < 1 - 1e-9 for x in q) <= 2
    assert math.isclose(sum(q), sum(p)) and math.isclose(sum(a * b for a, b in zip(q, size)), sum(a * b for a, b in zip(p, size)))
    assert mixing.flight([0.5] * 9, [7] * 9, r).count(0.5) <= 2 and mixing.flight([], [], r) == []


@pytest.mark.parametrize("last", [False, True])
def test_inclusion_probabilities(last):
    """Over seeds each document is taken as often as its probability says, short or long, and totals stay near."""
    import pandas as pd

    r = np.random.default_rng(6)
    n, seeds = 90, 400
    size = np.sort(r.integers(1, 900, n))
    p = np.tile([0.25, 0.5, 0.8], n // 3)
    rows = pd.DataFrame({"source": "a", "doc_id": range(n), "size": size, "mix": r.permutation(n), "p": p, "source_size": size.sum(), "target": 0.0, "whole": 0, "n_rows": n})
    total, mean = np.zeros(n), p @ size
    for seed in range(seeds):
        got = mixing._level(last, seed)(("a",), rows.assign(mix=np.random.default_rng(seed).permutation(n))).sort_values("doc_id")["p"].to_numpy()
        total += got
        if last:
            assert set(got) <= {0.0, 1.0} and abs(got @ size - mean) <= 2 * size[12]
        else:
            assert math.isclose(got @ size, mean) and math.isclose(got.sum(), p.sum())
    often = total / seeds
    assert (np.abs(often - p) < 4.5 * np.sqrt(p * (1 - p) / seeds)).all()
    for third in np.split(np.arange(n), 3):
        assert abs(often[third].mean() - p[third].mean()) < 0.03
