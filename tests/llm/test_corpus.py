"""Near copies, leaks, mixing, page text and the pipeline against brute force."""

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import decontam, html, langid, mixing, pii, queries, simhash
from siftwork.llm.sql import ORACLE

DATA = Path("/root/testdata/sf0.001")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=4):
    """Component number of each fingerprint, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(prints))]


def test_near_duplicates_of_odd_texts(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    ids = docs.select("doc_id", "text").collect()
    prints = [plain_print(r["text"]) for r in ids]
    groups = plain_components(prints)
    least = {g: min((r["doc_id"] for r, k in zip(ids, groups) if k == g and r["doc_id"] is not None), default=None) for g in groups}
    expected = sorted(((r["doc_id"], f"{p:016x}", least[g]) for r, p, g in zip(ids, prints, groups)), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == expected
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))
    assert simhash.near_duplicates(none).isEmpty() and simhash.one_of_each(none).isEmpty()


@pytest.mark.parametrize("crowd", [1024, 1])
def test_links_keep_all_components(spark, crowd):
    """With ``crowd`` 1 every key goes the way of crowded keys."""
    draw, prints = random.Random(5), set()
    for _ in range(12):
        p = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            prints.add(p)
            for b in draw.sample(range(64), draw.randint(1, 5)):
                p ^= 1 << b
    prints = sorted(int(np.uint64(p).view(np.int64)) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, len(prints), crowd=crowd)).collect()}
    groups = plain_components([p % (1 << 64) for p in prints])
    assert [root.get(p, p) for p in prints] == [prints[g] for g in groups]


ITEM = "Anna Smith buys 12 apples and 7 pears at the market. How many kg of fruit does Anna Smith carry home if each apple weighs 3 kg?"


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short"), (4, "")], "item_id long, text string")
    changed = ITEM.replace("Anna Smith", "Bob Stone").replace("12", "40").replace("7", "9").replace(" 3 ", " 5 ")
    mixed_up = changed.replace("does Bob Stone", "does Carl Young")
    other = "A quiet morning came over the hills and nobody in the village had any fruit to carry home that day."
    rows = [(1, f"Some words first. {ITEM} And then more."), (2, changed), (3, other), (4, None), (5, "long " * 5000 + ITEM), (5, other), (None, changed)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.contaminated(texts, items).collect()}
    assert got == {(1, 1): True, (2, 1): False, (5, 1): True, (None, 1): False}
    aligned = decontam.contaminated(spark.createDataFrame([(1, mixed_up)], "doc_id long, text string"), items).collect()
    assert not aligned or aligned[0]["coverage"] < 1
    assert sorted(r["doc_id"] for r in decontam.without_benchmark(texts, items).collect()) == [3, 4]
    assert decontam.without_benchmark(docs, items).count() == docs.count()
    assert decontam.without_benchmark(docs, items.limit(0)).count() == docs.count()
    assert decontam.contaminated(none, items).isEmpty()


def plain_coverage(pairs, n):
    """Coverage by windows of 8 tokens; ``pairs`` are item and document values by token number."""
    values = {}
    for i, d in pairs.values():
        values.setdefault(i, set()).add(d)
    bad = {at for at, (i, d) in pairs.items() if i != d and len(values[i]) > 1}
    spots = {k + j for k in range(n - 7) if not bad & set(range(k, k + 8)) for j in range(8)}
    return len(spots) / n


def test_a_clash_of_slots_drops_only_its_windows(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]

    def text(values):
        return " ".join(values.get(k, w) for k, w in enumerate(words))

    cases = [
        ({5: "2", 30: "2"}, {5: "2", 30: "3"}),
        ({5: "2", 30: "2"}, {5: "two", 30: "2"}),
        ({5: "2", 30: "2"}, {5: "4", 30: "3"}),
        ({5: "Ben", 30: "Ben"}, {5: "Ben", 30: "Tom"}),
        ({5: "12", 7: "7"}, {5: "8", 7: "8"}),
        ({5: "2", 12: "2", 19: "2", 26: "2", 33: "2"}, {5: "3", 12: "4", 19: "5", 26: "6", 33: "7"}),
    ]
    for item, doc in cases:
        items = spark.createDataFrame([(1, text(item))], "item_id long, text string")
        docs = spark.createDataFrame([(1, text(doc))], "doc_id long, text string")
        want = plain_coverage({k: (item[k].lower(), doc[k].lower()) for k in item}, len(words))
        got = decontam.contaminated(docs, items).collect()
        assert [r["coverage"] for r in got] == ([want] if want >= decontam.COVERAGE else []), (item, doc)
        assert not any(r["exact"] for r in got)


def test_items_that_share_passages_equal_all_pairs(spark):
    """Items of shared and own passages, texts of runs of them: one window is in nearly every item."""
    draw = random.Random(11)
    passages = [[f"p{chr(97 + p)}{chr(97 + k)}" for k in range(draw.randint(9, 14))] for p in range(6)]
    for k, p in enumerate(passages):
        passages[k] = ["".join(c for c in w if c.isalpha()) for w in p]
    items = [[w for p in [0, 0, *draw.sample(range(6), 2)][: draw.randint(2, 4)] for w in passages[p]] for _ in range(12)]
    texts = []
    for _ in range(30):
        own = [w for p in draw.choices(range(6), k=draw.randint(1, 4)) for w in passages[p][draw.randint(0, 3) :] + ["gap"]]
        texts.append(own)
    texts += items[:2] + [["gap"] * 20]

    def coverage(text, item):
        grams = {tuple(text[k : k + 8]) for k in range(len(text) - 7)}
        return len({k + j for k in range(len(item) - 7) if tuple(item[k : k + 8]) in grams for j in range(8)}) / len(item)

    want = {(d, i): c for d, t in enumerate(texts) for i, x in enumerate(items) if (c := coverage(t, x)) >= decontam.COVERAGE}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contaminated(docs, table).collect()}
    assert got == pytest.approx(want) and want


def test_short_items_match_whole_texts_only(spark):
    items = spark.createDataFrame([(1, "forty two"), (2, "Blue 7"), (3, "the red fox")], "item_id long, text string")
    texts = ["Forty two!", "forty two apples", "blue 7", "blue 8", "The red fox.", "see the red fox", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()} == {(0, 1), (2, 2), (4, 3)}


def test_texts_of_one_id_or_none_are_not_mixed(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    changed = ITEM.replace("Anna Smith", "Bob Stone").replace("12", "40")
    half = len(ITEM) // 2
    clean = "A quiet morning came over the hills and nobody carried anything home."
    rows = [(None, ITEM), (None, changed), (None, clean), ("x", ITEM), ("x", clean), ("y", ITEM[:half]), ("y", ITEM[half:]), ("z", clean)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    alone = [decontam.contaminated(spark.createDataFrame([r], docs.schema), items).count() > 0 for r in rows]
    assert alone[:5] == [True, True, False, True, False]
    got = sorted(map(tuple, decontam.without_benchmark(docs, items).collect()), key=str)
    out = {r[0] for r, leaks in zip(rows, alone) if leaks} - {None}
    assert got == sorted((r for r, leaks in zip(rows, alone) if r[0] not in out and not leaks), key=str)
    assert (None, clean) in got and (None, ITEM) not in got
    ids = {r["doc_id"]: r["exact"] for r in decontam.contaminated(docs, items).collect()}
    assert {None: True, "x": True}.items() <= ids.items() and "z" not in ids
    large = spark.createDataFrame([(2**60 + 1, ITEM), (None, clean)], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in decontam.contaminated(large, items).collect()] == [2**60 + 1]


def water_level(sizes, weights, most=3):
    """Targets by resharing what is above a source's limit until none is."""
    total, target, stopped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in stopped]
        left = total - sum(most * sizes[k] for k in stopped)
        for k in free:
            target[k] = left * weights[k] / sum(weights[j] for j in free)
        over = {k for k in free if target[k] > most * sizes[k]}
        for k in over:
            target[k] = most * sizes[k]
        if not over:
            return target
        stopped |= over


def test_mixing_targets_and_copies(spark, docs, none):
    sizes = {"a": 900, "b": 30, "c": 40, "d": 300, None: 10}
    rows = [(f"{s}", i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)]
    table = spark.createDataFrame([(k, t, s) for k, (_, _, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(table).join(table.select("doc_id", "source"), "doc_id").collect()
    order = sorted((s for s in sizes if s), key=str) + [None]
    expected = dict(zip(order, water_level([sizes[s] for s in order], [1 + k % 3 for k in range(5)])))
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(expected[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - expected[s]) <= 10 and all(r["taken"] <= 3 * r["size"] for r in own)
        assert len({r["copies"] for r in own}) <= 2
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    odd = mixing.mix(docs).collect()
    assert len(odd) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in odd)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy_"] and out.count() == sum(r["copies"] for r in odd)
    assert mixing.mix(none).isEmpty() and mixing.mixed(none).isEmpty()


def test_a_stopped_source_spreads_over_all_bins(spark):
    rows = [(i, "w w w", "a" if i < 9000 else "b") for i in range(9200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix(docs).join(docs, "doc_id").collect():
        got.setdefault(r["source"], []).append(r["copies"])
    assert set(got["b"]) == {3}
    u = docs.select("source", F.floor(mixing._uniform(F.col("doc_id"), mixing.SEED) * mixing.BINS).alias("bin"))
    assert u.filter("source = 'b'").distinct().count() > 150


def test_repeated_rows_are_dealt_alike_in_every_run(spark):
    rows = [(1, "one two three", "a", k % 5) for k in range(10)] + [(k, "w w w w w w", "b", k) for k in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    runs = [sorted(tuple(r) for r in mixing.mixed(docs.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_mixing_equals_its_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = "doc_id, size, source_size, target, copies, taken"
    assert sorted(c.sql(f"SELECT {names} FROM ({ORACLE['op8_mixing']})").fetchall()) == sorted(
        tuple(r) for r in queries.op8_mixing(spark, str(DATA)).select(*names.split(", ")).collect()
    )


def page(body, head="<title>t</title>", menu="<nav><a href=/>Home</a></nav>"):
    return f"<html><head>{head}<style>p{{}}</style></head><body>{menu}<div class='content'>{body}</div><div id=sidebar>Side</div><footer>Foot</footer><script>var x='<p>no</p>'</script></body></html>"


def test_page_text(spark):
    rows = [
        (1, "http://a.example/1", page("<h1>Head &amp; line</h1><p>First   para\nhas <b>bold</b> words.</p><p>Second.")),
        (2, "http://a.example/2", page("<p>Other text here</p><div class=comments><p>Nice!</p></div>")),
        (3, None, None),
        (4, "http://a.example/4", ""),
        (5, "nonsense", "plain <i>text</i> only &eacute;"),
        (5, "nonsense", "plain <i>text</i> only &eacute;"),
        (6, "http://b.example/", "<article><p>" + "long words " * 50_000 + "</p></article><aside>no</aside>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))
    got = [tuple(r) for r in html.extract(pages).orderBy("page_id").collect()]
    long = ("long words " * 50_000).strip()
    texts = ["Head & line\nFirst para has bold words.\nSecond.", "Other text here", "", "", "plain text only é", "plain text only é", long]
    assert got == [(i, u, t, len(t)) for (i, u, _), t in zip(rows, texts)]
    assert html.extract(pages.limit(0)).isEmpty()


def host_pages(n, menu="Home Shop Help", foot="All rights kept by the house", copies=1):
    """Pages of one host without a telling tag, class or link, and their main texts."""
    rows, texts = [], []
    for i in range(n):
        paragraphs = [f"story {i} part {k} has words of its own" for k in range(1 + i % 3)]
        extra = f"<div><p>See story {i + 1}</p></div>" if i % 4 == 0 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html_ = f"<body><div>{''.join(f'<p>{m}</p>' for m in menu.split())}</div><div><h2>Story {i}</h2>{body}</div>{extra}<div><p>{foot}</p></div></body>"
        rows += [html_] * copies
        texts += ["\n".join([f"Story {i}", *paragraphs] + ([f"See story {i + 1}"] if extra else []))] * copies
    return rows, texts


def extracted(spark, hosts):
    rows = [(f"http://{h}.example/{k}", t) for h, pages in hosts.items() for k, t in enumerate(pages)]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract(df).orderBy("page_id").collect()], df


def test_the_wrapper_decides_where_pages_tell_nothing(spark):
    one, want_one = host_pages(9)
    two, want_two = host_pages(5, menu="Start Ende", foot="Impressum des Hauses", copies=3)
    got, df = extracted(spark, {"a": one, "b": two, "c": one[:1]})
    assert got[: len(one) + len(two)] == want_one + want_two
    # nothing to compare the only page of a host with
    assert got[-1].startswith("Home\nShop\nHelp\nStory 0")
    spread = html.extract(df.repartition(7)).orderBy("page_id").collect()
    assert [r["text"] for r in spread] == got
    made = {r["host"]: r for r in html.wrappers(df).collect()}
    assert html.expression(made["b.example"].asDict(recursive=True)) == "(<p>=TEXT)+ <h2>#TEXT (<p>#TEXT)+ (<p>#TEXT)? <p>=TEXT"
    large, html.BROADCAST_CHARS = html.BROADCAST_CHARS, 0
    try:
        assert [r["text"] for r in html.extract(df).orderBy("page_id").collect()] == got
    finally:
        html.BROADCAST_CHARS = large


def nodes(*paths_and_texts):
    return [
        {"path": p, "repeats": False, "pages": 1, "marks": 0, "low": t, "high": t, "chars": 9, "links": 0} for p, t in paths_and_texts
    ]


def test_wrapper_has_optional_and_template_parts(monkeypatch):
    pages = [
        nodes(("/menu", 9), ("/h1", 1), ("/p", 2), ("/foot", 9)),
        nodes(("/menu", 9), ("/h1", 4), ("/ad", 5), ("/p", 6), ("/foot", 9)),
        nodes(("/menu", 9), ("/h1", 7), ("/p", 8), ("/foot", 9)),
    ]
    one = html.merged([{"total": 1, "nodes": p} for p in pages])
    assert html.expression(one) == "<menu>=TEXT <h1>#TEXT (<ad>=TEXT)? <p>#TEXT <foot>=TEXT"
    assert html.inside(one) == [False, True, True, True, False]
    monkeypatch.setattr(html, "walk", lambda a, b: [*((k, None) for k in range(len(a.paths))), *((None, k) for k in range(len(b.paths)))])
    apart = html.merged([{"total": 1, "nodes": p} for p in pages])
    assert all(html.inside(apart))


def test_alignment_keeps_order_and_loses_nothing():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 9))] for _ in range(2))
        texts = [[draw.choice([None, 1, 2, 3]) for _ in side] for side in (a, b)]
        pairs = list(html.walk(html.Sequence(a, texts[0]), html.Sequence(b, texts[1])))
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
        assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)


def test_stages_take_odd_tables(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.count()
        assert stage(spark, none, str(tmp_path)).isEmpty(), name


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs, ~queries.held_out())
    seen = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    known = sorted(i for i in rows if seen[i]["lang_pred"] != "und" and seen[i]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE)
    groups = plain_components([plain_print(rows[i]["text"]) for i in known])
    single = [i for k, i in enumerate(known) if groups[k] == k]
    held = {r["doc_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    clean = [i for i in single if i not in held]
    out = corpus_pipeline.run(spark, str(DATA)).collect()
    assert {r["doc_id"] for r in out} <= set(clean)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert all(r["text"] == masked[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    table = docs.filter(F.col("doc_id").isin(clean)).drop("text", "n_chars").join(
        spark.createDataFrame([(i, masked[i]) for i in clean], "doc_id long, text string"), "doc_id"
    )
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(table).collect() if r["copies"]}
    counted = {}
    for r in out:
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    assert counted == copies
