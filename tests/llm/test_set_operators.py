"""Line dedup, Jaccard join, extraction, search and the pipeline."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weirflow.llm import html_blocks, html_extraction, jaccard_join, line_dedup, va_search
from weirflow.llm.components import connected_components
from weirflow.llm.html_blocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute_links(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    label, links = list(range(len(sets))), [0] * len(sets)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))], links


@pytest.mark.parametrize("n, percent, how", [(4, 85, {}), (5, 80, {}), (4, 85, {"block_sets": 3}), (5, 80, {"block_sets": 1, "most_blocks": 4}), (4, 85, {"block_shingles": 300}), (3, 60, {}), (2, 35, {"block_sets": 2})])
def test_jaccard_join(spark, n, percent, how):
    rng = random.Random(n * percent)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " ", "one", "One", "two words", "x y z", "x y z", "Long " * 3000]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((5, 9, 30, 120, 400)))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 2, 8))):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    for size in (20, 60, 90):  # one inside another, two size bands apart
        base = [rng.choice(vocabulary) for _ in range(160)]
        texts += [" ".join(base[:size]), " ".join(base[: int(size * 1.6)])]
    texts += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(80))]) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)] + [(None, "one two", "c", 0)], "doc_id long, text string, comp string, n long")
    rows = rows.union(rows.where("doc_id in (5, 6, 12, 15)"))  # repeated rows change nothing
    got = jaccard_join.ngram_jaccard_join(rows.repartition(3), n, percent, **how).collect()
    size, label, links = brute_links(texts, n, percent)
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts) + 5 and by_id.pop(None)["component_id"] is None
    assert [by_id[i]["n_shingles"] for i in range(len(texts))] == size
    assert [by_id[i]["component_id"] for i in range(len(texts))] == label
    assert [by_id[i]["n_links"] for i in range(len(texts))] == links


def test_jaccard_join_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.ngram_jaccard_join(rows).count() == 0


def test_signatures_miss_no_pair():
    rng = np.random.default_rng(2)
    table = jaccard_join.bands(85, 5000)
    for size in [*range(1, 60), 100, 333, 1000]:
        x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        changed = int(len(x) * 15 / 185)  # replaced on both sides: the most that still links
        y = np.unique(np.concatenate([x[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)]))
        grown = np.unique(np.concatenate([x, rng.integers(0, 2**63, int(len(x) * 15 / 85)).astype(np.uint64)]))
        for other in (y, grown):
            common = len(np.intersect1d(x, other))
            if 100 * common >= 85 * (len(x) + len(other) - common):
                assert np.isin(jaccard_join.signatures(x, 85, table)[0], jaccard_join.signatures(other, 85, table)[0]).any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(5, 5), (None, 3), (7, 6)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    label = {n: n for e in edges for n in e if n is not None}
    for _ in range(len(label)):
        for u, v in edges:
            if u is not None and v is not None:
                label[u] = label[v] = min(label[u], label[v])
    alone = {n for n in label if not any(n in e and e[0] != e[1] and None not in e for e in edges)}
    assert got == {n: c for n, c in label.items() if n not in alone}


def brute_lines(rows, min_docs, min_chars):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(list)
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append((r, i))
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for x in lines:
            h = holders.get(key(x), [])
            last = max((j for _, j in h if j is not None), default=None)
            if len(h) < min_docs or i == last:
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(2)
    shared = [f"Shared line number {i} that is longer than forty code points é" for i in range(6)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (None, "\n".join(shared)), (None, shared[0])]
    for i in range(3, 40):
        lines = [rng.choice([x, x.upper().replace("É", "é"), f"  {x}\t", "short"]) for x in rng.sample(shared, rng.randint(0, 4))]
        rows.append((i, "\n".join([*lines, f"A line of document {i} alone, long enough to count as one"] * rng.randint(1, 2))))
    rows += [(39, rows[-1][1])]
    frame = spark.createDataFrame([(i, t, "k", 9) for i, t in rows], "doc_id long, text string, key string, n_lines long")
    got = line_dedup.dedup_lines(frame, 5, 40, batches=4, fanout=2)
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=order) == sorted(brute_lines(rows, 5, 40), key=order)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_runs_know_what_is_new(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    frame = lambda keys, d: spark.createDataFrame([(k, d) for k in keys], "key string, doc_id long")
    fresh = lambda run: {r["key"] for r in run.frame.where("fresh").collect()}
    assert fresh(store.ingest(frame("abc", 1))) == set("abc")
    store.ingest(frame("bcd", 2))
    assert [len(level) for level in store.levels] == [0, 1] and fresh(store.runs()[0]) == set("abcd")  # compacted
    run = store.ingest(frame("dex", 3))
    assert fresh(run) == set("ex") and {tuple(r) for r in run.frame.where("not fresh").collect()} == {("d", 1, 3, False)}
    run = store.ingest(frame("xad", 0))
    assert [len(level) for level in store.levels] == [0, 0, 1] and fresh(store.runs()[0]) == set("abcdex")
    assert {tuple(r) for r in store.totals().collect()} == {("a", 2, 1), ("b", 2, 2), ("c", 2, 2), ("d", 3, 3), ("e", 1, 3), ("x", 2, 3)}
    store.forget()


def test_runs_merge_without_a_shuffle(spark):
    store = line_dedup.LineRuns(spark, fanout=9)
    for k in range(3):
        own = store.ingest(spark.range(100 * k, 300 * k + 100).select(F.col("id").cast("string").alias("key"), F.lit(k).cast("long").alias("doc_id")))
    with line_dedup._sorted_buckets(spark):
        told = store.told_apart(own.frame.drop("fresh"), store.runs())
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert plan.count("LeftAnti") == 3 and plan.count("SortMergeJoin") == 4 and "Exchange" not in plan and "Sort [" not in plan
        assert "Exchange" not in store.totals()._jdf.queryExecution().executedPlan().toString()
    store.forget()


def test_extraction(spark):
    model = html_extraction.fit_extractor(html_extraction.training_pages())
    wrong = total = 0
    for page in html_extraction.training_pages(100, seed=99):
        found = blocks(page)
        wrong += sum(a != b.main for a, b in zip(model.labels(found), found))
        total += len(found)
    assert wrong / total < 0.02
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p><b>First  line.<br><p>Second&nbsp;one with words enough.</p></article><div class='comments'><p>I disagree with all of it.</p></div><script>var a='</p>'</script><footer>&copy; x</footer>"
    assert model.text(page) == "A & B First line. Second one with words enough."
    odd = [None, "", "<", "<p", "<!--", "<script>x", "<div>" * 2000 + "x", "<a ='" * 3000, "&#0;&bogus;"]
    rows = spark.createDataFrame([(i, h, "t", 1) for i, h in enumerate([*odd, page, page])], "page_id long, html string, text string, url int")
    got = html_extraction.extract_main_text(rows, model, keep=("url",)).collect()
    assert len(got) == len(odd) + 2 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == len(odd)] == ["A & B First line. Second one with words enough."]
    assert html_extraction.extract_main_text(rows.limit(0), model).count() == 0


def test_labels_and_gradients_by_enumeration():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 8):
        emissions, moves, y = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, n)
        paths = list(itertools.product((0, 1), repeat=n))
        score = lambda p: sum(emissions[i, a] for i, a in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        total = math.log(sum(math.exp(score(p)) for p in paths))
        loss, by_block, by_move = html_extraction.loss_and_gradients(emissions, moves, y)
        assert math.isclose(loss, total - score(y))
        for target, gradient in ((emissions, by_block), (moves, by_move)):
            for at in np.ndindex(*target.shape):
                target[at] += 1e-5
                up = html_extraction.loss_and_gradients(emissions, moves, y)[0]
                target[at] -= 2e-5
                down = html_extraction.loss_and_gradients(emissions, moves, y)[0]
                target[at] += 1e-5
                assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5
        # the decoder on blocks whose only weighted features are their innermost names
        html = "".join(f"<p><b{i}x>t {i}</b{i}x></p>" for i in range(n)).replace("<p>", "<div>").replace("</p>", "</div>")
        found = blocks(re.sub(r"</?b(\d)x>", "", html).replace("<div>", "<div class='zq'>"))
        weights = {f: tuple(rng.normal(size=2)) for own in html_blocks.features(found) for f in own}
        model = html_extraction.Extractor(weights, moves.tolist())
        emissions = np.array([np.sum([weights[f] for f in own], axis=0) for own in html_blocks.features(found)])
        assert math.isclose(score(model.labels(found)), max(map(score, paths)))


def test_extraction_at_any_depth_and_with_many_names():
    model = html_extraction.fit_extractor(html_extraction.training_pages())
    prose = "This is a sentence of the article, long enough to be told from a menu. "
    for depth in (0, 1, 25, 45, 120, 500):
        for names in (1, 9, 40):
            wrappers = "".join("<div class='" + " ".join(f"u{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghijklmnopqrstuvwxyz'[i // 26]}" for k in range(names)) + "'>" for i in range(depth))
            page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>{wrappers}<article><h1>A title</h1><p>{prose * 3}</p><p>{prose * 2}</p></article>{'</div>' * depth}<footer>&copy; 2020 Someone</footer></body></html>"
            assert model.text(page) == f"A title {(prose * 3).strip()} {(prose * 2).strip()}", (depth, names)


def test_extraction_on_pages_of_another_kind():
    """English pages in mark-up that the training pages don't use."""
    rng = random.Random(12)
    model = html_extraction.fit_extractor(html_extraction.training_pages())
    lexicon = "the of market and report river a in new said year people city after more over water when two from light which house long other into only time could world".split()
    sentence = lambda: " ".join(rng.choices(lexicon, k=rng.randint(7, 22))).capitalize() + "."
    right = total = 0
    for _ in range(60):
        paragraphs = [" ".join(sentence() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(2, 8))]
        links = lambda n: "".join(f'<li class="nav-item"><a class="nav-link" href="#{k}">{rng.choice(lexicon).title()}</a></li>' for k in range(n))
        body = "".join(f'\n  <p class="lead-{k}">{p}</p>' for k, p in enumerate(paragraphs))
        page = f"""<!doctype html><html><head><title>x</title></head><body class="page home">
        <header id="top"><div class="container"><a href="/">Daily {rng.choice(lexicon)}</a><nav><ul class="navbar-nav">{links(6)}</ul></nav></div></header>
        <div class="container"><div class="row"><main class="col-md-8"><article class="post"><h1>{sentence()[:-1]}</h1>{body}</article></main>
        <aside class="col-md-4"><h4>Related</h4><ul>{links(5)}</ul></aside></div></div>
        <footer class="footer"><p>&copy; 2021 Daily. All rights reserved.</p><ul>{links(3)}</ul></footer></body></html>"""
        text = model.text(page)
        total += len(paragraphs)
        right += sum(p in text for p in paragraphs)
        assert "Related" not in text and "rights reserved" not in text
    assert right >= 0.98 * total


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(1)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, rows[1][1]), (450, [1.0, 2.0]), (500, [0.0] * 8)]
    frame = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, va_search.exact_topk(frame, lambda c: c % 50 == 0, 5, block=37, chunk=3).collect()))
    ints = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in ints if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert got == want
    assert va_search.exact_topk(frame.limit(0), lambda c: c % 50 == 0).count() == 0


def test_search_reads_few_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[2000:2600] = x[0]  # a group of copies, which each block reads once
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = va_search.found_in_blocks(frame, lambda c: c % 50 == 0, block=500).agg({"read": "sum"}).first()[0]
    assert got < 0.05 * 80 * 4000
    ints = np.floor(256 * x).astype(np.int64)
    row = dict(zip([c.split()[0] for c in va_search._FILE.split(", ")], va_search.ApproximationFile.row(0, np.arange(4000), ints, 6)))
    assert len(row["cells"]) * 8 <= 6 * row["n"] * 32 + 64 and len(row["cells"]) < len(row["vectors"]) / 2 and row["n"] == 3400
    file = va_search.ApproximationFile.read(row, 6)
    middle, reach = file.bounds(ints[:40].astype(np.float64))
    exact = ints[:40] @ file.vectors.T.astype(np.int64)
    assert (np.abs(middle - exact) <= reach[:, None]).all() and reach.max() < 0.2 * 256**2


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count()
        if name == "near_duplicates":
            groups = jaccard_join.ngram_jaccard_join(docs, 5, 80)
            assert kept.count() == groups.select("component_id").distinct().count()
            assert kept.join(groups.where("doc_id = component_id"), "doc_id", "left_anti").count() == 0
        path = f"{tmp_path}/{name}"
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_keeps_columns_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    own = {"score": F.lit(-7), "lang_pred": F.lit("mine"), "n_lines": F.lit(-3), "n_dropped": F.lit(-4), "component_id": F.lit(-5), "text_2": F.lit(None).cast("string")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns(own)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    some = docs.where("doc_id % 7 = 0").limit(3)
    docs = docs.union(some).union(some.withColumn("doc_id", F.lit(None).cast("long")))  # repeated rows, and null ids
    docs = docs.union(some.withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0, name
        assert out.where("score <> -7 or lang_pred <> 'mine' or n_lines <> -3 or n_dropped <> -4 or component_id <> -5 or text_2 is not null").isEmpty(), name
        if name == "language":
            assert out.where("lang is null or text is null").isEmpty() and out.where("doc_id is null").count() > 0
        empty = stage(spark, docs.limit(0), SF)
        assert empty.columns == docs.columns and empty.count() == 0
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    counts = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1")
    assert counts.where("count <> 2").isEmpty()
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs, SF).where("start = 0").count() == docs.count() and pack(spark, docs.limit(0), SF).count() == 0


def test_pipeline_without_languages_keeps_all(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, docs, SF).count() == docs.count()


def test_pipeline_rejects_texts_in_no_learned_language(spark):
    import corpus_pipeline

    rng = random.Random(6)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60, 200, 1000)]
    odd += ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше в лес.", "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie dalej do lasu, gdzie mieszka. Jesienią liście spadają z drzew, wieczory są coraz dłuższe, a dzieci wracają do szkoły pełne wrażeń. Wszyscy cieszą się, że zbliżają się święta i można spędzić czas z rodziną."]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.limit(1).collect()[0].asDict()
    added = spark.createDataFrame([tuple((base | {"doc_id": -1 - i, "text": t, "lang": None})[c] for c in docs.columns) for i, t in enumerate(odd)], docs.schema)
    noisy = docs.withColumn("doc_id", F.col("doc_id") + 1000000).withColumn("text", F.regexp_replace("text", " ", "~~^^|^~| "))
    assert corpus_pipeline.language(spark, docs.union(noisy.where("doc_id % 10 = 0")), SF).where("doc_id >= 1000000").count() == docs.where("doc_id % 10 = 0").count()
    kept = corpus_pipeline.language(spark, docs.union(added), SF)
    assert kept.where("doc_id < 0").count() == 0 and kept.count() == docs.count()


def test_registered(spark):
    names = entry.queries()
    assert sum(bool(re.match(r"op\d+_", n)) for n in names) == 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("op2_line_dedup", "op8_ngram_jaccard_join", "op10_exact_topk"):
        want = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        got = entry.queries()[name](spark, SF).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_digest_of_kept_text(spark):
    row = entry.queries()["op2_line_dedup"](spark, SF).where("n_dropped = 0").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").first()
    assert row["kept_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()
