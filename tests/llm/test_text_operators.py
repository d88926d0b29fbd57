"""Quality, language, fingerprints, tokenizers, language model: against brute force, round trips or held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import byte_bpe, imatch, maxent_lm, packing, ppm_language, quality, textvec
from weirflow.llm.chunked_bpe import Tokenizer, WordEncoder
from weirflow.llm.textvec import text_words

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "A", "é ÉÀ", "x" * 5000, "the cat sat on the mat " * 2000, "… — !", "\x00\x1c"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def docs(spark, texts, first=0):
    """With a repeated row, an extra column and columns whose names operators use for results."""
    rows = [(first + i, t, "x", 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[-1:]], "doc_id long, text string, source string, score double")


def made(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def test_word_and_shingle_hashes():
    texts = [t for t in ODD]
    arr = pa.array(texts)
    assert [len(s) for s in textvec.shingle_sets(arr, 4)] == [len({tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))}) if w else 0 for w in map(words, texts)]
    sliced = pa.array(["zz zz", *texts, None])[1:-1]
    assert [s.tolist() for s in textvec.shingle_sets(sliced, 4)] == [s.tolist() for s in textvec.shingle_sets(arr, 4)]
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    index = textvec.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def test_quality(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    good = [made(rng, 40, vocabulary) for _ in range(60)]
    bad = [made(rng, 40, vocabulary).upper().replace(" ", "!! ") for _ in range(60)]
    every = docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(0, 120, 2)] + [(5, None, 1)], "doc_id long, quality int, source string")
    model = quality.fit_quality(every, labels)
    got = quality.score_quality(every, model)
    assert got.columns == ["doc_id", "text", "source", "score"] and got.count() == every.count()
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert all(0 <= s <= 1 for s in score.values())
    assert min(score[i] for i in range(1, 60, 2)) > max(score[i] for i in range(61, 120, 2))
    assert quality.score_quality(every.limit(0), model).count() == 0
    for part in (labels.limit(0), labels.where("quality = 1")):  # nothing to learn from: a constant
        alone = quality.quality_scores(every, part)
        assert alone.select("score").distinct().count() == 1


def test_log_count_ratios():
    rows, good = [np.array([0, 2]), np.array([0]), np.array([2, 3]), np.array([], int)], np.array([True, True, False, False])
    got = quality.log_count_ratios(rows, good, 2, 1.0)
    for feature in range(4):
        share = [(1 + sum(feature in r for r, g in zip(rows, good) if g == label)) / (4 + sum(len(r) for r, g in zip(rows, good) if g == label)) for label in (True, False)]
        assert math.isclose(got[feature], math.log(share[0] / share[1]))


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(30)]
    y, ratio, cost = np.where(rng.random(30) < 0.4, 1, -1), rng.normal(size=40), 0.7
    x = np.zeros((30, 41))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(len(r))
    x[:, 40] = 1  # the bias
    upper = cost * np.array([30 / (2 * (y == s).sum()) for s in y])
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, rate = np.zeros(30), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(100_000):  # the same dual by projected gradient
        alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, upper)
    want = (alpha * y) @ x
    w, bias = quality._descend(rows, y, ratio, cost, 3000)
    assert np.allclose(np.r_[w, bias], want, atol=5e-3)


def test_fits_are_bounded_by_rows(spark, monkeypatch):
    rows = spark.range(0, 400).selectExpr("if(id < 300, 7, id) as doc_id", "concat('text ', id) as text", "if(id % 2 = 0, 'a', 'b') as lang").repartition(9)
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda r, good, bits: seen.append(len(r)))
    quality.fit_quality(rows, rows.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality").distinct(), max_rows=50)
    assert seen == [50]
    sample = ppm_language._sample(rows, 20, "doc_id", "text", "lang")
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"a": 20, "b": 20}
    assert "Coalesce" not in sample._jdf.queryExecution().executedPlan().toString()


def test_ppm_code_lengths():
    texts = {"a": [b"abcabc", b"abx"], "b": [b"zzz", b"abq"]}

    def counted(ts, g):
        c = collections.Counter(int.from_bytes(x[i : i + g], "big") for x in ts for i in range(len(x) - g + 1))
        k = np.array(sorted(c), np.uint64)
        return k, np.array([c[int(i)] for i in k])

    def cost(ts, context, byte):
        seen = collections.Counter(x[i + len(context)] for x in ts for i in range(len(x) - len(context)) if x[i : i + len(context)] == context)
        n, d = sum(seen.values()), len(seen)
        if byte in seen:
            return math.log2((n + d) / seen[byte])
        return (math.log2((n + d) / d) if n else 0) + (cost(ts, context[1:], byte) if context else 8)

    model = ppm_language.build({lang: [counted(ts, g) for g in (1, 2, 3, 4)] for lang, ts in texts.items()}, 3)
    for s in ["abcx", "zzqabc", "", "q", "ABC", "abcabcabc"]:
        low = s.lower().encode()
        want = [sum(cost(ts, low[max(0, i - 3) : i], low[i]) for i in range(len(low))) for ts in texts.values()]
        assert np.allclose(model.code_lengths(pa.array(["zz", s, None]))[1], want, atol=1e-4)


def test_languages(spark):
    rng = random.Random(4)
    kinds = {"aa": "ka lo mi neru tus".split(), "bb": "schtz ung keit ver ein".split()}
    texts = [(made(rng, 20, kinds[k]), k) for k in kinds for _ in range(40)]
    rows = spark.createDataFrame([(i, t, k, "x") for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string")
    model = ppm_language.fit_languages(rows.where("doc_id % 2 = 0"))
    got = ppm_language.identify_languages(rows, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and got.where("lang <> lang_pred").count() == 0
    odd = ppm_language.language_predictions(docs(spark, ODD + ["123 !?"]), rows.limit(0).union(rows))
    pred = {r["doc_id"]: r["lang_pred"] for r in odd.collect()}
    assert [pred[i] == "und" for i in (0, 1, 2, 8, 9, 10)] == [True] * 6 and pred[3] != "und"
    nothing = ppm_language.language_predictions(docs(spark, ["abc"]), rows.limit(0))
    assert {tuple(r) for r in nothing.collect()} == {(0, "und", 0.0)}
    assert ppm_language.language_predictions(docs(spark, ["abc"]).limit(0), rows).count() == 0


def test_language_limits_take_all_rows(spark):
    rng = random.Random(17)
    kinds = {"aa": "ka lo mi neru tus".split(), "bb": "schtz ung keit ver ein".split()}
    # 1 of 30 texts is unlike the others; more than 400 of a language in each half
    texts = [(made(rng, rng.randint(5, 30), kinds[k]) if i % 30 else "".join(chr(rng.randint(97, 122)) for _ in range(60)), k) for k in kinds for i in range(1500)]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)] + [(None, "zzz", "aa"), (9, None, "bb"), (10, "zzz", None)], "doc_id long, text string, lang string")
    half = {r["doc_id"]: r["h"] for r in rows.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) as h").collect()}
    held = [[(t, k) for i, (t, k) in enumerate(texts) if half[i] == h] for h in (0, 1)]
    counted = {}
    for k in kinds:
        grams = [collections.Counter(t.encode()[i : i + g] for t, own in held[0] if own == k for i in range(len(t) - g + 1)) for g in (1, 2, 3, 4)]
        counted[k] = [(np.array(keys := sorted(int.from_bytes(x) for x in c), np.uint64), np.array([c[x.to_bytes(g + 1)] for x in keys])) for g, c in enumerate(grams)]
    want = ppm_language.build(counted, 3)
    model = ppm_language.fit_languages(rows.where("pmod(xxhash64(doc_id), 2) = 0"), max_rows=None)
    assert model.languages == want.languages
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for x, y in ((model.costs, want.costs), (model.escapes, want.escapes)) for a, b in zip(x, y))
    bits = want.code_lengths(pa.array([t for t, _ in held[1]])).min(axis=1) / [len(t) for t, _ in held[1]]
    limits = ppm_language.code_limits(rows)
    for k in kinds:
        own = np.array([b for b, (_, lang) in zip(bits, held[1]) if lang == k])
        assert len(own) > 500 and abs(limits[k] - min(8.0, 2 * np.quantile(np.minimum(own, 4.0), 0.99))) <= 2 / ppm_language.STEPS


def test_fingerprints(spark):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(3000)]
    texts = [made(rng, rng.randint(1, 120), vocabulary) for _ in range(60)]
    every = docs(spark, ODD + texts + [texts[0]], first=-5).where("source = 'x'")
    got = sorted(imatch.edited_fingerprints(every).collect(), key=lambda r: (-r["doc_id"], r["n_chars"]))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in every.collect()), key=lambda r: (-r[0], r[1]))
    assert len(got) == len(rows)
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(rows, rows[1:] + rows[:1])]
    assert [r["edited_sha256"] for r in got] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert [r["n_chars"] for r in got] == [len(t) for _, t in rows]
    by_text = collections.defaultdict(set)
    for (_, t), r in zip(rows, got):
        by_text[t].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for (_, t), r in zip(rows, got) if t in texts and len(t) > 200]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long])
    assert imatch.likeness([got[0]["fingerprint"]], [got[0]["fingerprint"]]).tolist() == [1.0]
    assert imatch.edited_fingerprints(every.limit(0)).count() == 0
    alone = imatch.edited_fingerprints(every.where("doc_id = 20")).first()
    assert alone["near_next"] == 1.0


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(15)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = [made(rng, rng.randint(1, 90), vocabulary) for _ in range(120)] + ODD + ["the only rare words here", "the", "the the the"]
    rows = docs(spark, [("the " + t if t and k % 2 else t) for k, t in enumerate(texts)])
    lexicon = imatch.Lexicon.fit(rows.select(F.coalesce("text", F.lit("")).alias("text")), max_share=0.2, min_docs=3)
    of = {r["doc_id"]: sorted(set(words(r["text"]))) for r in rows.collect()}
    held = collections.Counter(w for own in of.values() for w in own)
    band = {w for w, n in held.items() if 3 <= n <= 0.2 * len(of)}
    every = list(held)
    hashes = [int(h) for _, _, w, _ in text_words(pa.array([" ".join(every)])) for h in w]
    number = dict(zip(every, hashes))
    inside = lexicon.holds(np.array(hashes, np.uint64))
    assert {w for w, x in zip(every, inside) if x} == band and {"the", "only"} & band == set()

    def mixed(x):
        x ^= x >> 33
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = x * m % 2**64
            x ^= x >> 33
        return x

    def subset(terms):
        total = sum(terms) % 2**64
        return f"{max(mixed(total) >> 48, 1) if total else 0:04x}"

    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_documents(rows, lexicon).collect()}
    for i, own in of.items():
        terms = [number[w] for w in own if w in band] or [number[w] for w in own]
        want = subset([mixed(t) for t in terms])
        for seed in map(int, lexicon.seeds[: lexicon.draws]):
            drawn = [mixed(t ^ seed) for t in terms]
            for level in range(1, lexicon.levels + 1):
                want += subset([mixed((x + seed) % 2**64) for x in drawn if x >> 64 - level == 0])
        assert prints[i] == want, i


def test_lexicon_larger_than_its_marks_is_whole(spark):
    rng = random.Random(16)
    vocabulary = [f"t{i}" for i in range(900)]
    texts = [made(rng, rng.randint(1, 60), vocabulary) for _ in range(150)] + ODD
    rows = docs(spark, [("the " + t if t and k % 2 else t) for k, t in enumerate(texts)]).withColumn("doc_id", F.expr("nullif(doc_id, 7)"))
    of = [set(words(r["text"])) for r in rows.collect()]
    held = collections.Counter(w for own in of for w in own)
    band = {w for w, n in held.items() if 2 <= n <= 0.2 * len(of)}
    hashes = [int(h) for _, _, w, _ in text_words(pa.array([" ".join(held)])) for h in w]
    plain = rows.select(F.coalesce("text", F.lit("")).alias("text"))
    lexicon, larger = imatch.Lexicon.fit(plain, 0.2, 2, marks=100), imatch.Lexicon.fit(plain, 0.2, 2)
    marked = {w for w, x in zip(held, lexicon.holds(np.array(hashes, np.uint64))) if x}
    rest = {h for r in lexicon.rest.collect() for h in np.frombuffer(r["keys"], np.uint64).tolist()}
    assert 0 < len(marked) <= 100 < len(band) and marked | {w for w, h in zip(held, hashes) if h in rest} == band and larger.rest is None
    for marks in (0, 100):
        got, want = (imatch.edited_fingerprints(rows, marks=m).collect() for m in (marks, None))
        assert len(got) == len(of) and sorted(got, key=str) == sorted(want, key=str)
    got, want = (imatch.fingerprint_documents(rows, x).collect() for x in (lexicon, larger))
    assert len(got) == len(of) and sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_tell_edited_texts_from_others(spark):
    got = imatch.edited_fingerprints(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert got.where("near_edited > near_next").count() >= 0.9 * got.count()


def test_ranges_keep_the_order(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-500, 500), 300) + [7, 7, None]
    frame = spark.createDataFrame([(i, "x" * rng.choice((0, 5, 4000))) for i in ids], "doc_id long, text string").repartition(5)
    parts = imatch._with_next(frame, 6).withColumn("at", F.spark_partition_id()).collect()
    assert len({r["at"] for r in parts}) == 6
    follows = {}
    for a, b in zip(parts, parts[1:]):
        if a["at"] == b["at"] and a["range"] == b["range"] and not a["tail"]:
            follows.setdefault(a["doc_id"], []).append(b["doc_id"])
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    want = {}
    for a, b in zip(order, order[1:] + order[:1]):
        want.setdefault(a, []).append(b)
    assert follows == want


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    alphabet = "ab  \n\t\r\x0b\x1c\x85\xa0 é漢字🙂é'sS'lL019!?.,<|endoftext|>​\x00Σ_-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(3000)] + [t for t in ODD if t]
    codec = byte_bpe.ByteCodec(byte_bpe.tokenizer_json(ranks, P.PATTERN))
    ids, cuts = codec.encode(texts)
    parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    assert [p.tolist() for p in parts] == [other.encode_ordinary(t) for t in texts]
    assert [codec.decode(p) for p in parts] == texts
    assert codec.bytes_of == [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
    _, first, ends = codec.encode_with_offsets("a 🙂b")  # an emoji of several tokens has one span
    assert (first[0], ends[0], first[-1], ends[-1]) == (0, 1, 3, 4) and len(set(zip(first[1:-1], ends[1:-1]))) <= 2
    for t in texts[:400]:
        own, first, ends = codec.encode_with_offsets(t)
        assert own == other.encode_ordinary(t) and first == sorted(first) and all(0 <= a < b <= len(t) for a, b in zip(first, ends))
        assert set(range(len(t))) == {k for a, b in zip(first, ends) for k in range(a, b)}
        assert all(codec.bytes_of[i] == t[a:b].encode() for i, a, b in zip(own, first, ends) if len(codec.bytes_of[i]) == len(t[a:b].encode()))
    frame = docs(spark, ODD)
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(frame, path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        own = np.array(other.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(own) and got[i]["ids_sha256"] == hashlib.sha256(own.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    spans = {r["doc_id"]: r for r in byte_bpe.encode_documents(frame, path, P.PATTERN).collect()}
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == got[i]["n_tokens"] for i, r in spans.items())
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(frame, path, P.PATTERN), path, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert byte_bpe.round_trip(frame.limit(0), path, P.PATTERN).count() == 0


def test_packing(spark):
    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)  # as it is: special tokens in a text are found
    rng = random.Random(7)
    alphabet = [*"ab  \n\x1c\x85\xa0é漢字🙂'sS019!?.,̧́ΣσÅİ<|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|endoftext", "word's"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    odd += ["it's <|endoftext|> ok", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "'<|ENDOFTEXT|>", "", "a" * 5000]
    ids, cuts = WordEncoder(Tokenizer.from_file(path), "</w>").encode_batch(pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [e.ids for e in plain.encode_batch(odd, add_special_tokens=False)]
    texts = ODD + [made(rng, rng.randint(1, 300), ["alpha", "beta,", "gamma", "<|endoftext|>"]) for _ in range(150)]
    frame = docs(spark, texts)
    got = packing.pack_documents(frame, path, capacity=256, block=64).collect()
    of = collections.defaultdict(list)
    for r in got:
        own = np.array([*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["start"] == 256 * r["piece"]
        assert r["length"] == min(256, len(own) - r["start"])
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in of.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    lengths = np.array([r["length"] for r in got])
    assert len(of) <= packing.least_bins(lengths, 256) * 1.02 + 1
    assert packing.pack_documents(frame.limit(0), path).count() == 0


def test_words_are_known_without_their_signs():
    path = P.path("word_bpe_49k.json")
    encoder, plain = WordEncoder(Tokenizer.from_file(path), "</w>"), Tokenizer.from_file(path)
    texts = ["alpha$$$ beta,*** gamma. Alpha### it's' it's. ''. $$$ a_ x1!! é.! b.é. c!" + "?" * 9, "", "$", "a$", "d" + "\u0301..", "-a- --a--", "A\u0301B!!"]
    ids, cuts = encoder.encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"alpha", "beta", "gamma", "$$$", ",***", "###", "_"} <= set(encoder.numbers) and not {"alpha$$$", "alpha###", "beta,***"} & set(encoder.numbers)


def test_genetic_operators():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 100, 300).astype(np.int32)
    a, b = packing.evolve(sizes, 100, [], 1, generations=1), packing.evolve(sizes, 100, [], 2, generations=1)
    child = packing.crossover(a, b, rng)
    packing.mutate(child, rng)
    for g in (a, b, child):
        held = sorted(i for items in g.bins.values() for i in items)
        assert held == list(range(300)) and all(sizes[items].sum() + g.room[k] == 100 for k, items in g.bins.items())
    better = packing.evolve(sizes, 100, [[list(x) for x in a.bins.values()], [list(x) for x in b.bins.values()]], 3, generations=10)
    assert better.fitness() >= max(a.fitness(), b.fitness())


def test_language_model(spark):
    rng = random.Random(9)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    texts = [made(rng, rng.randint(1, 60), kinds[i % 3]) for i in range(300)] + ODD
    frame = docs(spark, texts).where("doc_id is not null")
    held = F.col("doc_id") % 5 == 0
    got = maxent_lm.score_texts(frame, held, table_size=64, grouped=32, n_classes=12).collect()
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    count = collections.Counter(w for i, t in rows if i % 5 for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        own = [*words(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(count[w] > 0 for w in own), n, r["doc_id"] % 5 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-6)
        assert r["score"] < 0
    out = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    nothing = maxent_lm.score_texts(frame.limit(3), F.lit(True)).collect()
    assert len(nothing) == 3 and all(r["n_known"] == r["train_tokens"] == 0 for r in nothing)
    assert maxent_lm.score_texts(frame.limit(0), held).count() == 0


def test_language_model_sums_to_one():
    keys = np.arange(10, 20, dtype=np.uint64)
    counts = np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5])
    words_ = maxent_lm.Vocabulary.build(keys, counts, 200, 25, np.array([0, 1, 0, 1]), 6)
    # the tail: 15 words of 15 counts in all, and the unknown one
    assert math.isclose((15 + 0.1 * 15 + 0.1) / words_.tail_mass, 1)
    tables = maxent_lm.Tables.of(25, 14, 21)
    assert maxent_lm.Tables.of(10**6, 14, 21).rows > maxent_lm.Tables.of(10**4, 14, 21).rows > tables.rows
    rng = np.random.default_rng(1)
    z = maxent_lm._log_softmax(np.zeros(6, np.float32), rng.normal(size=(tables.rows, 6)).astype(np.float32), rng.integers(0, tables.rows, (4, 50)))
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-5)


def test_language_model_tells_words_of_a_class_apart(spark):
    rng = random.Random(3)
    chain = [f"w{i}" for i in range(40)]  # the word before says which word follows; all are one class
    texts = []
    for _ in range(300):
        first = rng.randrange(40)
        texts.append(" ".join(chain[(first + 7 * k) % 40] for k in range(60)))
    got = maxent_lm.score_texts(docs(spark, texts), F.col("doc_id") % 5 == 0, n_classes=2).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


@pytest.mark.parametrize("depth", [0, 1, 8])
def test_word_shares_within_classes_sum_to_one(depth):
    keys, counts = np.arange(10, 20, dtype=np.uint64), np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5])
    words_ = maxent_lm.Vocabulary.build(keys, counts, 200, 25, np.array([0, 1, 0, 1]), 3, depth)
    rng = np.random.default_rng(1)
    context = rng.integers(0, 1 << 32, (4, 1), dtype=np.uint32).repeat(11, axis=1)
    found = np.r_[np.arange(10), -1]
    plain = words_.forks.log_share(np.zeros(1 << 12, np.float32), found, context, 12)
    by_counts = np.log10((counts + 0.1) / np.bincount(words_.classes, weights=counts + 0.1)[words_.classes])
    assert np.allclose(plain, np.r_[by_counts, 0], atol=1e-5)
    learned = words_.forks.log_share(rng.normal(size=1 << 12).astype(np.float32), found, context, 12)
    assert np.allclose(np.bincount(words_.classes, weights=10 ** learned[:10]), 1, atol=1e-5) and np.allclose(learned, plain) == (depth == 0)


def test_gradient_steps_follow_the_loss():
    rng = np.random.default_rng(2)
    tables = maxent_lm.Tables((8, 4, 4, 8), 12)
    weights, bias = rng.normal(size=(24, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32)
    rows = np.stack([rng.integers(a, b, 30) for a, b in ((0, 8), (8, 12), (12, 16), (16, 24))]).astype(np.uint16)
    y = rng.integers(0, 5, 30)
    loss = lambda w: -float(maxent_lm._log_softmax(bias.astype(np.float64), w, rows)[np.arange(30), y].sum())
    after, squares = weights.copy(), np.ones_like(weights)
    maxent_lm._step(bias, after, squares, rows, y, 1e-3)
    moved = (after - weights) * -1e3  # gradient over the root of 1 and its square; the features' rows lie apart
    for r, c in [(0, 0), (3, 4), (9, 1), (13, 2), (20, 3)]:
        w = weights.astype(np.float64)
        w[r, c] += 1e-4
        up = loss(w)
        w[r, c] -= 2e-4
        slope = (up - loss(w)) / 2e-4
        assert abs(moved[r, c] - slope / math.sqrt(1 + slope * slope)) < 5e-3
    assert tables.rows == 24


def test_arrays_add_up_in_steps(spark):
    frame = spark.range(0, 100, numPartitions=10)

    def per_task(batches):
        total = np.zeros(1 << 19, np.float32)
        for b in batches:
            total[:100] += np.bincount(b.column(0).to_numpy(), minlength=100)
        return total

    got = maxent_lm._add_arrays(frame, 10, per_task, 1 << 19, fan_in=2)
    assert got[:100].tolist() == [1.0] * 100 and not got[100:].any()
