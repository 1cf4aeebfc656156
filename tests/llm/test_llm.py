"""The operators against brute force, and their defined cases: nulls, empty and long texts, repeats, empty tables, odd columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sessiondeck.llm import bpe, common, decontaminate, graph, language_id, line_dedup, pitman_yor, queries, simhash, spotsigs, token_counts, toxicity, url_filters, vec

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "the", "a b", "it's  a\ttest x", "Ünï çödé 日本語 🙂", "x" * 3000, "word " * 2000, "one\ntwo\nONE \n", "<|endoftext|> and <|endoftext|>", "12.5 km and 3,000 kg", "\x00\x1f odd", "the"]


def docs_of(spark, texts, **more):
    """doc_id, text, and columns whose names an operator might want for itself."""
    rows = [(i, x, "en", "s", 0, i) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


# --- token hashes -----------------------------------------------------------


def test_spans_and_hashes_follow_the_words():
    texts = [x or "" for x in ODD]
    data, offsets = vec.buffers(pa.array(ODD, pa.string()))
    starts, ends = vec.spans(data, offsets, ~vec.SPACE)
    want = [w for x in texts for w in x.encode().lower().split()]
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == want
    h = vec.hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(want))
    assert h.tolist() == vec.hash_of([w.decode() for w in want]).tolist()
    sliced = pa.array([*ODD, *ODD], pa.string()).slice(3, 5)
    assert vec.buffers(sliced, lower=False)[0].tobytes() == "".join(x or "" for x in [*ODD, *ODD][3:8]).encode()


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(ODD, pa.string())})
    assert [x for p in vec.slices(batch, size=50) for x in p.column("text").to_pylist()] == ODD


# --- 1 toxicity -------------------------------------------------------------


def maximal(scores):
    """All maximal-scoring segments, by their definition: split at the best one, and again on both sides."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (found is None or total > found[0] + 1e-12):
                    found = (total, i, j)
        return found

    def split(lo, hi):
        found = best(lo, hi)
        return [] if found is None else [*split(lo, found[1]), (found[1], found[2], round(found[0], 9)), *split(found[2] + 1, hi)]

    return split(0, len(scores))


def test_segments_are_the_maximal_ones():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice([-0.5, -0.5, -0.5, rng.uniform(0.1, 3)]) for _ in range(rng.randint(0, 25))]
        hits = [i for i, s in enumerate(scores) if s > 0]
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.segments(hits, [scores[i] for i in hits], 0.5)]
        assert got == maximal(scores)


def test_decay_solves_its_equation():
    rates, scores = np.array([0.01, 0.02, 0.97]), np.array([3.0, 1.0, -0.5])
    assert (rates * np.exp(toxicity.decay(rates, scores) * scores)).sum() == pytest.approx(1)


def toxic_corpus(spark, n=400):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        bad = i % 4 == 0
        for _ in range(4 * bad):
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "awful", "nasty"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_are_told_and_their_passages_found(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.97
    passage = next(p for i in held if got[i]["passages"] for p in got[i]["passages"])
    of = next(got[i]["text"] for i in held if got[i]["passages"])
    assert any(w in of[passage["start"] : passage["end"]] for w in ("vile", "awful", "nasty"))


def test_toxicity_defined_cases(spark):
    docs, labels = toxic_corpus(spark, 200)
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs_of(spark, ODD), None).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), model).count() == 0
    assert toxicity.fit(docs, labels.select("doc_id", F.lit(None).cast("int").alias("toxic")), F.lit(True)) is None


def test_many_segments_take_linear_time():
    """Sparse hits leave as many segments as hits; each hit looks at few of them."""

    class Counted(float):
        looks = 0

        def __ge__(self, other):
            Counted.looks += 1
            return float(self) >= float(other)

    for n in (2000, 8000):
        Counted.looks = 0
        assert len(toxicity.segments(list(range(0, 10 * n, 10)), [Counted(1.0)] * n, Counted(0.5))) == n
        assert Counted.looks <= 8 * n


def plain_toxicity(model, text):
    """score, by plain words and dictionaries: the log-odds of each word, all maximal segments, bits and the logistic."""
    import re

    known = dict(zip(model.tokens.tolist(), model.scores.tolist()))
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    scores = [known.get(int(vec.hash_of([w])[0]), -toxicity.DRIFT) for w in words]
    while scores and scores[-1] < 0:
        scores.pop()
    bits = [model.lam * s - math.log(model.k * max(len(words), 1)) + math.log(toxicity.SIGNIFICANT) for _, _, s in maximal(scores)]
    x = [1.0, min(max(max(bits, default=-20), -20), 40), math.log1p(sum(b for b in bits if b > 0))]
    return 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(x, model.weights))))))


def test_scores_against_brute_force(spark):
    docs, labels = toxic_corpus(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    rows = [*[r["text"] for r in docs.limit(60).collect()], *[x for x in ODD if len(x or "") < 2000]]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs_of(spark, rows), model).collect()}
    assert got == pytest.approx({i: plain_toxicity(model, x) for i, x in enumerate(rows)}, rel=1e-9)


def test_op1_accuracy_and_shape(spark):
    got = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.1")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id", "left").collect()
    assert len({r["doc_id"] for r in rows}) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], r["toxic"]) for r in rows if r["held_out"] and r["toxic"] is not None]
    assert np.mean([a == b for a, b in held]) > 0.97 and np.mean([a for a, b in held if b]) > 0.85 and np.mean([a for a, b in held if not b]) < 0.01


# --- 2 byte-level BPE ---------------------------------------------------------


def test_tokens_are_the_librarys_and_decode_to_the_text(spark, texts):
    want = bpe.encoding(bpe.RANKS)
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_bpe"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, x in texts.items():
        ids = want.encode_ordinary(x)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()


ALPHABET = ["a", "é", "1", " ", "  ", "\n", "'", "'s", "!", "日", " ", "bcd", "\t"]


def test_stitched_pieces_are_the_whole_texts_pretokens():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices(ALPHABET, weights=[rng.random() + 0.01 for _ in ALPHABET], k=rng.randint(0, 120)))
        size = rng.randint(4, 20)
        overlap = rng.randint(2, size)
        parts = bpe.chunks(text, size, overlap)
        cuts = bpe.stitches([bpe.edges(s, p, size, overlap) for s, p in parts])
        found = bpe.pieces(parts, cuts)
        assert "".join(found) == text
        assert [m for p in found for m in bpe.pattern().findall(p)] == bpe.pattern().findall(text)


def test_long_texts_and_defined_cases(spark):
    rng = random.Random(4)
    odd = [*ODD, "".join(rng.choices(ALPHABET, k=2000)), "z" * 500 + " " + "y" * 700, " " * 400]
    got = {r["doc_id"]: r for r in bpe.encode(docs_of(spark, odd), chunk_chars=64, overlap=16).collect()}
    for i, x in enumerate(odd):
        assert got[i]["ids"] == bpe.encoding(bpe.RANKS).encode_ordinary(x or ""), i
        assert got[i]["score"] == i and got[i]["lang"] == "en"
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(docs_of(spark, odd))).collect()}
    assert back == {i: (x or "").encode() for i, x in enumerate(odd)}
    twice = docs_of(spark, ["b c " * 60]).unionAll(docs_of(spark, ["b c " * 60]))
    assert bpe.encode(twice, chunk_chars=64, overlap=16).count() == 2
    assert bpe.digests(docs_of(spark, [])).count() == 0


# --- 3 token counts ----------------------------------------------------------


def library_count(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(x.ids) for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(spark, texts, tmp_path):
    odd = [*ODD, *list(texts.values())[:60]]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs_of(spark, odd), f"file://{tmp_path}/cache").collect()}
    assert [got[i]["n_tokens"] for i in range(len(odd))] == library_count(odd)
    assert all(got[i]["n_bytes"] == len((x or "").encode()) and got[i]["over_limit"] == (got[i]["n_tokens"] > 1024) for i, x in enumerate(odd))


def test_cache_gets_each_distinct_miss_once(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = lambda: sorted((r["digest"], r["n_tokens"]) for r in spark.read.parquet(cache).collect())
    token_counts.count_tokens(docs_of(spark, ["a", "a", "b", None, ""]), cache).count()
    assert len(rows()) == 3
    token_counts.count_tokens(docs_of(spark, ["a", "c"]), cache).count()
    assert len(rows()) == 4
    # a stored count is what is given, so nothing that hits is encoded again
    spark.createDataFrame([(token_counts.tokenizer_digest(token_counts.TOKENIZER), hashlib.sha256(b"stored").hexdigest(), 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(docs_of(spark, ["stored"]), cache).first()["n_tokens"] == 77
    assert token_counts.count_tokens(docs_of(spark, []), cache).count() == 0


def test_full_caches_move_no_texts(spark, tmp_path):
    """Few misses are broadcast, many joined by shuffle: equal counts; and what is stored isn't encoded again."""
    rows = [x for i in range(40) for x in (f"text number {i}", "a copy")] + ODD
    docs = docs_of(spark, rows)
    want = None
    for few in (0, 1000):
        cache = f"file://{tmp_path}/{few}"
        token_counts.fill_cache(docs, cache, few=few)
        stored = {(r["digest"], r["n_tokens"]) for r in spark.read.parquet(cache).collect()}
        want = want or stored
        assert stored == want and len(stored) == len({x or "" for x in rows}) == spark.read.parquet(cache).count()
        token_counts.fill_cache(docs, cache, few=few)
        assert spark.read.parquet(cache).count() == len(stored)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_by_their_library(spark, tmp_path, name):
    got = token_counts.count_tokens(docs_of(spark, ["Hello there", ""]), f"file://{tmp_path}/cache", tokenizer=name).orderBy("doc_id").collect()
    assert got[0]["n_tokens"] >= 2 and got[1]["n_tokens"] == 0
    assert name == "piece_bpe_32k.model" or token_counts._as_ranks(__import__("json").load(open(public_tokenizers.path(name)))) is None


# --- 4 URL filters -----------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://a.com/en/1", "HTTP://A.COM/en/1", "https://example.com/en/7", "https://x.example.com/en/70?q=1", "https://notexample.com/en/7", "https://example.com/EN/7", "http://net/de/", "http://a.net/de", "https://example.net/de/8#x",
    "https://com/en/", "https://xcom/en/a", "ftp://a.org/es/?u=http://b.com/en/", "http://h?x=://com/en/", "http://a.com:80/en/1", "://b.com/en/x", "http://a.com/en/1", "http://Ä.org/es/x",
]


def judged(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = sorted((-len(r.host + r.path), r.host + r.path, r.verdict) for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path))
    return (host, path, fits[0][1] if fits else None, fits[0][2] if fits else default)


@pytest.mark.parametrize("bound", [0, 10_000])
def test_urls_against_all_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit(1))
    rules = [*url_filters.RULES, url_filters.Rule("block", "org", "/"), url_filters.Rule("allow", "a.com", "")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect()}
    assert got == {i: judged(u, rules, "allow") for i, u in enumerate(URLS)}


def test_hosts_may_hold_line_feeds(spark):
    urls = ["http://a\nb.com/en/x", "http://com\n/en/x", "http://x.com/\n/en/", "http://a.com\n.net/de/8", "x\n://example.com/en/7\n?q", "http://ncom/en/"]
    got = [(r["host"], r["rule"], r["verdict"]) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filters.RULES).orderBy("page_id").collect()]
    assert got == [("a\nb.com", "com/en/", "block"), ("com\n", None, "allow"), ("x.com", None, "allow"), ("a.com\n.net", "net/de/", "allow"), ("example.com", "example.com/en/7", "allow"), ("ncom", None, "allow")]


def test_url_filter_defined_cases(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (1, "http://a.com/en/1")], "page_id long, url string")
    assert [r["verdict"] for r in url_filters.judge(pages).collect()] == ["block", "block"]
    assert [r["verdict"] for r in url_filters.judge(pages, [], "block").collect()] == ["block", "block"]


def test_tokens_are_whole_in_every_fitting_url():
    assert url_filters.literal_tokens(url_filters.Rule("allow", "example.com", "/en/7")) == ["h:com", "h:example", "p:en"]


# --- 5 decontamination --------------------------------------------------------


def test_reparameterised_questions_are_found(spark):
    item = "A train leaves the station with Alice and travels 120 km in 3 hours before Alice meets Bob at the bridge near town."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "12 14 16"), (5, "short one")], "item_id long, text string")
    cases = [
        ("verbatim", f"intro text. {item} more text"),
        ("verbatim", f"x {item.upper()} y"),
        ("reparameterised", "Well: A train leaves the station with Carol and travels 95.5 miles in 7 hours before Carol meets Dave at the bridge near town. ok"),
        (None, "A train leaves the station with Carol and travels 95 miles in 7 hours before Erin meets Dave at the bridge near town."),
        (None, "A train leaves the station and that is all there is to say about it today in this town."),
        ("raw", "we had 12 14 16 then"), (None, "we had 12 15 16 then"), (None, None), (None, ""), ("short", "this short one fits"),
    ]
    got = collections.defaultdict(set)
    for r in decontaminate.leaks(docs_of(spark, [x for _, x in cases]), bench).collect():
        got[r["doc_id"]].add((r["item_id"], r["kind"]))
    want = {"verbatim": {(1, "verbatim")}, "reparameterised": {(1, "reparameterised")}, "raw": {(4, "verbatim")}, "short": {(5, "verbatim")}, None: set()}
    assert {i: got[i] for i in range(len(cases))} == {i: want[k] for i, (k, _) in enumerate(cases)}


def test_names_that_begin_sentences_are_slots(spark):
    items = [
        "Tom has 3 red apples. Anna has 5 green pears. How many pieces of fruit do Tom and Anna have together?",
        "three trains leave the old station and each of the trains carries twenty-five red boxes to the port",
        "На станции Борис купил 3 билета до города, а потом Борис отдал Ольге 2 билета и пошёл домой пешком",
    ]
    cases = [
        "Max has 7 red apples. Lena has 9 green pears. How many pieces of fruit do Max and Lena have together?",
        "7 trains leave the old station and each of the trains carries one hundred red boxes to the port",
        "На станции Иван купил 8 билета до города, а потом Иван отдал Марии 4 билета и пошёл домой пешком",
        "Max has 7 red apples. Lena has 9 green pears. How many pieces of fruit do Paul and Nina have together?",
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaks(docs_of(spark, cases), bench).collect()}
    assert got == {(i, i, "reparameterised") for i in range(3)}
    assert [r["doc_id"] for r in decontaminate.clean(docs_of(spark, cases), bench).collect()] == [3]


def test_numbers_may_coincide_and_vary(spark):
    item = "in the old shop a boy buys 3 apples and 5 pears and a girl at the door gets 3 apples from the boy for 2 euros"
    names = "we know Tom is here, and Tom has it, and Tom got it, when Tom ran off, so Tom met Anna"
    cases = [
        ("reparameterised", 0, "in the old shop a boy buys 4 apples and 4 pears and a girl at the door gets 4 apples from the boy for 4 dollars"),
        ("altered", 0, "in the old shop a boy buys 3 apples and 5 pears and a girl at the door gets 8 apples from the boy for 2 euros"),
        ("altered", 1, "we know Max is here, and Max has it, and Max got it, when Paul ran off, so Max met Lena"),
        (None, 1, "we know Max is here, and Paul has it, and Max got it, when Paul ran off, so Karl met Lena"),
        (None, 1, "we know Max is here, and Max has it, and Paul got it, when Paul ran off, so Paul met Max"),
    ]
    bench = spark.createDataFrame([(0, item), (1, names)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaks(docs_of(spark, [x for *_, x in cases]), bench).collect()}
    assert got == {(i, item, kind) for i, (kind, item, _) in enumerate(cases) if kind}


def brute_leaks(docs, items):
    """By words: the share of an item's windows of five that a text holds."""
    import re

    words = lambda x: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", x.lower())
    out = set()
    for i, item in items.items():
        w = words(item)
        own = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        for d, x in docs.items():
            t = words(x)
            if own and len(own & {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))}) >= 0.8 * len(own):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark, texts):
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op5_decontamination"](spark, SF).collect()}
    want = brute_leaks(texts, items)
    assert want and want <= got and all(x in want for x in got)
    tables = [common.table(spark, SF, x) for x in ("documents", "benchmark")]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(*tables, shuffled=True).collect()} == got
    for shuffled in (False, True):
        kept = decontaminate.clean(*tables, shuffled=shuffled)
        assert {r["doc_id"] for r in kept.collect()} == set(texts) - {d for d, _ in got} and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


FRAMES = [
    "{a} has {n} red apples and {b} has {m} green pears, so how many pieces of fruit do {a} and {b} have together after lunch?",
    "A train leaves the old station with {a} and travels {n} km in {m} hours before {a} meets {b} at the bridge near the town.",
    "In the shop {a} buys {n} books for {m} dollars each. {b} pays half of what {a} pays. How much does {b} pay in the end?",
    "Every day {a} walks {n} miles to school while {b} rides {m} miles on a bike, and at night {a} asks {b} who is faster.",
    "The garden of {a} is {n} meters long and {m} meters wide; {b} wants to build a fence around it for {a} next spring.",
]
PEOPLE = "Tom Anna Max Lena Paul Nina Otto Ida Łukasz Émile Борис Ольга Karim Zoë Bo Weng".split()


def question(rng, frame):
    a, b = rng.sample(PEOPLE, 2)
    return FRAMES[frame].format(a=a, b=b, n=rng.randint(2, 99), m=rng.randint(2, 99))


def test_recall_of_reparameterised_questions(spark):
    """Of 200 questions with other names and numbers, all are found; of texts that share only the topic, or whose names don't agree, none."""
    rng = random.Random(12)
    bench = spark.createDataFrame([(k, question(rng, k)) for k in range(len(FRAMES))], "item_id long, text string")
    filler = lambda: " ".join(rng.choice("some plain words that fill a text on quite another thing".split()) for _ in range(30))
    planted = [(i, f"{filler()}. {question(rng, i % len(FRAMES))} {filler()}") for i in range(200)]
    other = [(1000 + i, f"{filler()} {rng.choice(PEOPLE)} has {rng.randint(2, 99)} red apples and walks {rng.randint(2, 9)} miles to the old station.") for i in range(100)]
    mixed = [(2000 + i, FRAMES[0].replace("{a}", "%s").replace("{b}", "%s").format(n=4, m=5) % tuple(rng.sample(PEOPLE, 4))) for i in range(50)]
    docs = spark.createDataFrame([*planted, *other, *mixed], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i % len(FRAMES)) for i in range(200)}


def plain_template(text, anywhere):
    """(code, kind, filler) of a text of Latin letters, digits and plain punctuation, by the rules as the module states them."""
    import re

    out, last = [], None
    for m in re.finditer(r"[0-9]+(?:[.,:][0-9]+)*|[A-Za-z]+", text):
        raw, word = m[0], m[0].lower()
        between = text[last[0] : m.start()] if last else None
        before = out[-1][1] if out else ""
        if raw[0].isdigit() or word in decontaminate.NUMBERS:
            kind = "number"
            if before == "number" and word in decontaminate.NUMBERS and between in (" ", "-"):
                out[-1] = ("number", "number", out[-1][2] + between + word)
                last = (m.end(),)
                continue
        elif word in decontaminate.UNITS and before == "number" and len(between) <= 1:
            kind = "unit"
        elif raw[0].isupper() and raw[1:2].islower() and (anywhere or between in (" ", ", ")):
            kind = "name"
            if before == "name" and between == " ":
                out[-1] = ("name", "name", out[-1][2] + " " + word)
                last = (m.end(),)
                continue
        else:
            kind = ""
        out.append((kind or word, kind, word))
        last = (m.end(),)
    return out


def test_templates_against_brute_force(spark):
    """Shares of windows by template, computed plainly, over mutated questions."""
    rng = random.Random(5)
    items = [question(random.Random(k), k) for k in range(len(FRAMES))]
    items = ["".join(c if c.isascii() else "x" for c in x) for x in items]
    docs = []
    for i in range(150):
        words = "".join(c if c.isascii() else "x" for c in question(rng, i % len(FRAMES))).split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["and", "Tom", "7", "seven", "km", "house", "of"])
        docs.append(" ".join(words))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, docs), bench).collect()}
    able = set()
    for anywhere in (False, True):
        grams = lambda t: {tuple(x[0] for x in t[k : k + 5]) for k in range(len(t) - 4)}
        for j, item in enumerate(items):
            own = plain_template(item, anywhere)
            for i, x in enumerate(docs):
                theirs = grams(plain_template(x, anywhere))
                n = sum(tuple(y[0] for y in own[k : k + 5]) in theirs for k in range(len(own) - 4))
                if n >= 0.8 * (len(own) - 4):
                    able.add((i, j))
    assert got <= able and len(got) >= 0.9 * len(able) > 9  # what is missing has slots that don't agree


def test_repeated_rows_and_items_are_reported_each(spark):
    text = "one two cats sit on the old wall near the sea"
    bench = spark.createDataFrame([(1, text), (1, text), (2, text)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, f"{text} {text}")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    assert got == {(1, 1): 4, (1, 2): 2, **{(i, j): 3 - j for i in (2, 3, None) for j in (1, 2)}}
    assert decontaminate.clean(docs, bench).count() == 0


def test_other_columns_of_any_name(spark):
    """Names that the operators use for themselves do no harm."""
    text = "one two cats sit on the old wall near the sea"
    names = ["_leak", "hash", "form", "size", "at", "slots", "text_hash", "item_id", "similarity", "fp", "row", "root", "least", "fingerprint", "component_id", "a", "b", "block", "kind", "shard", "body", "held_out", "score", "p", "guest", "deal"]
    docs = spark.createDataFrame([(1, text), (2, f"{text} {text}"), (3, "quite another thing")], "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in names])
    bench = spark.createDataFrame([(1, text)], "item_id long, text string").withColumn("hash", F.lit("x"))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 1)}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [3]
    near = simhash.near_duplicates(docs)
    assert near.columns == [c for c in docs.columns if c not in ("text", "fingerprint", "component_id")] + ["fingerprint", "component_id"]
    assert {r["doc_id"]: (r["component_id"], r["fp"], r["row"]) for r in near.collect()} == {1: (1, 7, 7), 2: ({r["doc_id"]: r["component_id"] for r in near.collect()}[2], 7, 7), 3: (3, 7, 7)}
    assert pitman_yor.score(docs, F.lit(False), burn_in=0, samples=1).count() == 3
    assert spotsigs.against_edits(docs).count() == 3


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs_of(spark, ODD), bench).count() == 0
    assert decontaminate.clean(docs_of(spark, ODD), bench).count() == len(ODD)
    assert decontaminate.leaks(docs_of(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# --- 6 language ID ------------------------------------------------------------


def test_kernel_counts_shared_ngrams():
    bits, known = language_id.presence(["abc", "abd", "", None, "123", "ABC"])
    assert known.tolist() == [True, True, False, False, False, True] and (bits[0] == bits[5]).all()
    k = language_id.kernel(bits[:2], bits[:2])
    assert k[0, 0] == pytest.approx(1) and k[0, 1] == pytest.approx((bits[0] & bits[1]).sum() / math.sqrt(bits[0].sum() * bits[1].sum()))


def test_languages_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang").collect()}
    got = queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(got) == len(rows)
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held]) > 0.97


def test_predictions_against_plain_kernels(spark, documents, texts):
    """Landmark kernels, weights and scores again, with sets of n-grams as strings."""
    model = language_id.fit(documents, ~language_id.held_out())
    grams_of = {int(g): [] for g in model.grams}
    for i, g in enumerate(model.grams.tolist()):
        grams_of[g] = model.holders[model.starts[i] : model.starts[i + 1]].tolist()

    def grams(text):
        import re

        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        letters = re.sub(" +", " ", letters).lstrip(" ")
        out = set()
        for n in (1, 2, 3):
            for k in range(len(letters) - n + 1):
                code = 0
                for c in letters[k : k + n]:
                    code = code << 21 | ord(c)
                out.add(code)
        return out

    got = {r["doc_id"]: r for r in language_id.predict(documents.select("doc_id", "text"), model).collect()}
    for i, x in list(texts.items())[:60]:
        own = grams(x)
        if not own:
            assert got[i]["lang_pred"] == "und"
            continue
        shared = np.zeros(len(model.norms))
        for g in own:
            for m in grams_of.get(g, ()):
                shared[m] += 1
        raw = (shared / model.norms / math.sqrt(len(own))) @ model.weights[:-1] + model.weights[-1]
        assert got[i]["lang_pred"] == model.languages[int(raw.argmax())]
        assert got[i]["score"] == pytest.approx((min(max(raw.max(), -1), 1) + 1) / 2, abs=1e-3)


def test_language_defined_cases(spark, documents):
    model = language_id.fit(documents, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.predict(docs_of(spark, ODD), model).collect()}
    for i, x in enumerate(ODD):
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in x or "")), x
        assert 0 <= got[i]["score"] <= 1 and got[i]["text"] == x
    assert language_id.fit(documents.where("lang is null"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs_of(spark, ODD), None).collect()} == {"und"}
    assert language_id.predict(docs_of(spark, []), model).count() == 0
    alone = language_id.fit(documents.where("lang = 'de'").limit(3), F.lit(True))
    assert alone.languages == ["de"]


def test_copies_are_learned_from(spark):
    """A language of many rows and few texts is among the model's; texts of a large script are told apart."""
    from sessiondeck.llm.language_id import kernel, presence

    rows = [(i, f"word{chr(97 + i % 26)} text{chr(97 + i // 26)}", "en") for i in range(400)] + [(1000 + i, ["ein Satz", "noch ein Satz"][i % 2], "de") for i in range(20000)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.languages == ["de", "en"]
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, start + rng.integers(0, 3000, 60000))) for start in (0x4E00, 0x4E00, 0xAC00)]
    k = kernel(*[presence(texts)[0]] * 2)
    assert k[0, 1] > 2 * k[0, 2] and k[0, 2] < 0.01 and np.allclose(np.diag(k), 1)
    grams = language_id.ngrams(texts)[0]
    assert np.allclose(language_id.against(grams, *language_id.index(grams)), k, atol=1e-6)


# --- 7 SpotSigs ---------------------------------------------------------------


def spots(text):
    """The signatures as words, one by one."""
    import re

    t = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    common_words = set(spotsigs.ANCHORS)
    out = set()
    for i in range(-1, len(t)):
        if i < 0 or t[i] in common_words:
            chain = [w for w in t[i + 1 :] if w not in common_words][: spotsigs.CHAIN]
            if chain:
                out.add((t[i] if i >= 0 else None, *chain))
    return out


def test_signatures_are_chains_after_anchors(texts):
    sample = [*[x or "" for x in ODD], *list(texts.values())[:80]]
    got = spotsigs.signatures(pa.array(sample, pa.string()))
    want = [spots(x) for x in sample]
    for x, a, b in zip(sample, got, want):
        assert len(a) == (len(b) or int(bool(x))), x
    for i in range(0, len(sample) - 1):
        if want[i] and want[i + 1]:
            assert spotsigs.likeness(got[i], got[i + 1]) == pytest.approx(len(want[i] & want[i + 1]) / len(want[i] | want[i + 1]))


def check_edits(rows, got):
    rows = sorted(rows, key=lambda r: r[0])
    sigs = {x: spotsigs.signatures(pa.array([x]))[0] for _, x in rows}
    for (i, x), (_, y) in zip(rows, rows[1:] + rows[:1]):
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == spotsigs.told(sigs[x]) and r["edited_fingerprint"] == spotsigs.told(spotsigs.signatures(pa.array([edited]))[0])
        assert r["near_next"] == pytest.approx(spotsigs.likeness(sigs[x], sigs[y])) and 0 <= r["near_edited"] <= 1


def test_edits_take_the_next_document(spark, texts):
    check_edits(list(texts.items()), {r["doc_id"]: r for r in queries.QUERIES["op7_spotsigs"](spark, SF).collect()})
    odd = [(i * 7 - 20, x or "") for i, x in enumerate(ODD)]
    check_edits(odd, {r["doc_id"]: r for r in spotsigs.against_edits(spark.createDataFrame(odd, "doc_id long, text string").repartition(3)).collect()})
    one = spotsigs.against_edits(docs_of(spark, ["the cat sat"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert spotsigs.against_edits(docs_of(spark, [])).count() == 0
    same = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the dog")], "doc_id long, text string")
    assert spotsigs.against_edits(same).count() == 3
    big = [(2**60 + i, f"the cat {i} sat on the mat of house {i}") for i in range(40)] + [(None, "the dog")]
    got = spotsigs.against_edits(spark.createDataFrame(big, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == 41 and {r["doc_id"] for r in got} == {i for i, _ in big}
    names = [(f"é{i:02d}", f"the cat {i} sat on the mat of house {i}") for i in range(30)]
    check_edits(names, {r["doc_id"]: r for r in spotsigs.against_edits(spark.createDataFrame(names, "doc_id string, text string").repartition(4)).collect()})


def test_likeness_follows_from_fingerprints():
    a, b = spotsigs.signatures(pa.array(["the old cat sat on the red mat", "the old cat sat on the blue mat"]))
    assert spotsigs.untold(spotsigs.told(a)).tolist() == a.tolist()
    groups = [{f[k : k + 16] for k in range(0, len(f), 16)} for f in map(spotsigs.told, (a, b))]
    assert spotsigs.likeness(a, b) == len(groups[0] & groups[1]) / len(groups[0] | groups[1])


def test_near_duplicate_classes_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(["the", "of", rng.choice(words), rng.choice(words)]) for _ in range(rng.randint(20, 90))) for _ in range(25)]
    rows = list(base)
    for x in base[:12]:
        for _ in range(3):
            t = x.split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += ["", "", base[0], None]
    sigs = spotsigs.signatures(pa.array([x or "" for x in rows]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if spotsigs.likeness(sigs[i], sigs[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in spotsigs.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: root(i) for i in range(len(rows))} and len(set(got.values())) < len(rows)


# --- 8 SimHash ------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_components(spark, texts):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_simhash"](spark, SF).collect()}
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in fps]
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in root]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize(("threshold", "shard_rows"), [(3, 4096), (3, 60), (1, 50), (6, 80)])
def test_links_lose_no_pair(spark, threshold, shard_rows):
    rng = random.Random(threshold * 10 + shard_rows)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({c ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) for c in centres for _ in range(25)} | {0, (1 << 64) - 1, 1 << 63})
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes, threshold, shard_rows)).collect()}
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= threshold)
    got = [roots.get(signed(v), signed(v)) for v in values]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("half", [0, 1])
def test_trees_prune_and_lose_no_pair(half):
    """Every pair within the half's reach meets in a leaf; the comparisons stay far below all pairs, and grow as N ** 1.23, not N ** 2."""
    mask, reach = simhash.halves(3)[half]
    work = []
    for n in (4000, 16000):
        fp = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(half)
        fp[: n // 20] = fp[n // 20 : n // 20 * 2] ^ (np.uint64(1) << np.arange(n // 20, dtype=np.uint64) % np.uint64(64))  # near pairs
        fp = np.unique(fp)
        leaf, own = simhash.leaves(fp, mask, reach)
        sizes = np.bincount(leaf)
        assert sizes.max() <= simhash.LEAF_ROWS
        work.append(int((sizes * (sizes - 1) // 2).sum()))
        if n == 4000:
            met = set()
            for x in np.split(own, np.cumsum(sizes)[:-1]):
                met |= {(int(a), int(b)) for a in x for b in x if a < b}
            near = [(int(a), int(b)) for k, a in enumerate(fp) for b in fp[k + 1 :][np.bitwise_count((fp[k + 1 :] ^ a) & np.uint64(mask)) <= reach]]
            assert near and all(x in met for x in near)
    assert work[1] < 16000 * 15999 / 2 / 20 and work[1] < 6.5 * work[0]


def test_upper_levels_and_shards_of_a_sample():
    fp = np.random.default_rng(3).integers(0, 1 << 63, 20000, dtype=np.uint64)
    mask, reach = simhash.halves(3)[0]
    tree = simhash.build(fp[::10], mask, reach, 100)  # a tenth: shards of about a thousand
    at, shard = simhash.shards_of(tree, fp)
    sizes = np.bincount(shard)
    assert set(at.tolist()) == set(range(len(fp))) and sizes.max() < 2000 and len(sizes) == 1 + len(tree.point)
    lone = simhash.build(np.zeros(500, np.uint64), mask, reach, 10)  # nothing divides them
    assert not len(lone.point) and simhash.shards_of(lone, fp[:5])[1].tolist() == [0] * 5


def test_leaves_of_many_near_fingerprints_stay_linear():
    fp = np.array(sorted({1 << a | 1 << b for a in range(64) for b in range(64)}), np.uint64)
    a, b = simhash.leaf_edges(np.zeros(len(fp), np.int64), fp, 3)
    assert len(a) == len(fp) - 1 and len(set(b.tolist())) == 1


def test_simhash_defined_cases(spark):
    got = simhash.near_duplicates(docs_of(spark, [*ODD, *ODD])).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 2 * len(ODD) and by[0]["fingerprint"] == "0" * 16 == by[1]["fingerprint"] and by[0]["component_id"] == by[1]["component_id"] == 0
    assert all(by[i]["component_id"] <= i and by[i]["component_id"] == by[i + len(ODD)]["component_id"] for i in range(len(ODD)))
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    null_ids = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "quite other words here")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in simhash.near_duplicates(null_ids).collect()) == ["5", "5", "None"]


def test_components_of_chains(spark):
    n = 60
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(100, 101), (102, 102)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100}


# --- 9 Pitman-Yor ----------------------------------------------------------------


def lm_tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.mark.parametrize("block", [1 << 21, 500])
def test_base_score_and_counts(spark, documents, texts, block):
    got = {r["doc_id"]: r for r in pitman_yor.score(documents, pitman_yor.held_out(), block_tokens=block, burn_in=0, samples=1).collect()}
    counts = collections.Counter()
    for i, x in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(lm_tokens(x))
    n, v = sum(counts.values()), len(counts)
    for i, x in texts.items():
        t = lm_tokens(x)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(counts[w] > 0 for w in t), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    total = lambda f, c: sum(r[c] for r in got.values() if r["held_out"] == f)
    assert total(True, "score") > total(True, "base_score") and total(False, "score") > total(False, "base_score")


def stirling(n, discount):
    """Generalised Stirling numbers S(m, t) for m up to n, by their recurrence."""
    s = np.zeros((n + 1, n + 2))
    s[1, 1] = 1
    for m in range(1, n):
        for t in range(1, m + 2):
            s[m + 1, t] = s[m, t - 1] + (m - discount * t) * s[m, t] * (m >= t)
    return s


@pytest.mark.parametrize("n", [2, 3, 7, 20])
@pytest.mark.parametrize("a", [0.01, 0.4, 3.0, 50.0])
def test_draws_of_tables_have_stirling_odds(n, a):
    odds = stirling(n, 0.5)[n, 1 : n + 1] * a ** np.arange(1, n + 1)
    m = 40_000
    u = (np.arange(m) + 0.5) / m  # every quantile: shares come out exactly
    got = pitman_yor.draw_tables(np.full(m, n), np.full(m, a), u)
    assert np.bincount(got, minlength=n + 1)[1:] / m == pytest.approx(odds / odds.sum(), abs=n / m)


def test_draws_of_many_customers_follow_poisson():
    """With far more customers than tables, tables beyond the first are Poisson of 2a."""
    got = pitman_yor.draw_tables(np.full(2000, 10**8), np.full(2000, 40.0), (np.arange(2000) + 0.5) / 2000)
    assert got.mean() == pytest.approx(81, rel=0.01) and got.var() == pytest.approx(80, rel=0.03)


@pytest.mark.parametrize("shape", [0.3, 1.0, 2.5, 400.0])
def test_gamma_variates(shape):
    x = pitman_yor.gamma(np.full(50_000, shape), vec.mix(np.arange(50_000, dtype=np.uint64)), 3)
    assert x.mean() == pytest.approx(shape, rel=0.03) and x.var() == pytest.approx(shape, rel=0.06)


def test_gibbs_means_equal_enumeration():
    """Two contexts and three words: the chain's mean tables against the sum over all seatings."""
    word, context = np.array([0, 1, 2, 0, 1]), np.array([0, 0, 0, 1, 1])
    n = np.array([4, 2, 1, 3, 5])
    d, theta, place = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.PLACE
    s = stirling(5, d)
    total, mean = 0.0, np.zeros(5)
    for t in itertools.product(*(range(1, x + 1) for x in n)):
        t = np.array(t)
        p = np.prod([s[x, y] for x, y in zip(n, t)])
        for c in range(2):
            p *= np.prod([theta + d * i for i in range(t[context == c].sum())])
        customers = np.bincount(word, t, 3)
        p *= math.exp(sum(math.lgamma(place + x) for x in customers) - math.lgamma(4 * place + customers.sum()))
        total, mean = total + p, mean + p * t
    mean /= total
    words, contexts = pitman_yor.vec.hash_of(["a", "b", "c"]), pitman_yor.vec.hash_of(["x", "y"])
    t, sums, sweeps = np.ones(5, np.int64), np.zeros(5), 6000
    for k in range(sweeps):
        y = pitman_yor.weights(np.bincount(word, t, 3), words, k)
        t = pitman_yor.seat(word, context, n, words, contexts, y / (y.sum() + pitman_yor.unseen_weight(k)), np.bincount(context, t, 2), k)
        sums += t
    assert sums / sweeps == pytest.approx(mean, abs=0.05)


def plain_scores(rows, learned):
    """log10 probabilities of all texts, with dictionaries over the whole corpus in one place. rows: id to text."""
    h = lambda w: vec.hash_of([w.decode()])[0] if w is not None else pitman_yor.END
    chains = {i: [pitman_yor.START, *(h(w) for w in lm_tokens(x))] for i, x in rows.items()}
    count = collections.Counter(p for i in learned for p in zip(chains[i], chains[i][1:]))
    pairs = sorted(count, key=lambda p: (p[1], p[0]))
    contexts, words = sorted({c for c, _ in pairs}), sorted({w for _, w in pairs})
    c_at, w_at = ({h: k for k, h in enumerate(x)} for x in (contexts, words))
    context, word, n = np.array([c_at[c] for c, _ in pairs]), np.array([w_at[w] for _, w in pairs]), np.array([count[p] for p in pairs])
    customers_of = collections.Counter()
    for (c, _), k in count.items():
        customers_of[c] += k
    t, out, v = np.ones(len(n), np.int64), collections.Counter(), len(words)
    w_arr, c_arr = np.array(words, np.uint64), np.array(contexts, np.uint64)
    probability = collections.Counter()
    asked = {p for x in chains.values() for p in zip(x, x[1:])}
    place = pitman_yor.PLACE
    for k in range(pitman_yor.BURN_IN + pitman_yor.SAMPLES):
        y = pitman_yor.weights(np.bincount(word, t, v), w_arr, k)
        t = pitman_yor.seat(word, context, n, w_arr, c_arr, y / (int(y.sum()) + pitman_yor.unseen_weight(k)), np.bincount(context, t, len(contexts)), k)
        if k >= pitman_yor.BURN_IN:
            root, of_context = np.bincount(word, t, v), np.bincount(context, t, len(contexts))
            own = {p: x for p, x in zip(pairs, t)}
            for c, w in asked:
                below = (root[w_at[w]] if w in w_at else 0) + place
                back = below / (root.sum() + place * (v + 1))
                tables = of_context[c_at[c]] if c in c_at else 0
                p = (count[c, w] - pitman_yor.DISCOUNT * own.get((c, w), 0) + (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * tables) * back) / (pitman_yor.STRENGTH + customers_of[c])
                probability[c, w] += p / pitman_yor.SAMPLES
    for i, x in chains.items():
        out[i] = sum(math.log10(probability[p]) for p in zip(x, x[1:]))
    return out


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    rows = {i: " ".join(words[i * 20 : i * 20 + rng.randint(0, 40)]) for i in range(180)} | {180: "all new words here", 181: ""}
    learned = [i for i in rows if i % 7 != 2 and i < 180]
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    want = plain_scores(rows, learned)
    held = (F.col("doc_id") % 7 == 2) | (F.col("doc_id") >= 180)
    for shards, block in ((1, 1 << 21), (7, 300)):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, held, shards=shards, block_tokens=block).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_held_out_loss_beats_the_unigram_model(spark):
    """On sf0.01: 11.7 bits a token against 13.5 of the base score."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    held = pitman_yor.score(docs, pitman_yor.held_out()).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    loss = lambda x: -held[x] / held["n"] * math.log2(10)
    assert loss("s") < 11.9 and loss("b") > 13.4


def test_word_sequences_of_training_are_told(spark):
    """The same words in two orders: the preceding words differ, their last two bytes don't."""
    rng = random.Random(9)
    first, second = [f"a{i}xx" for i in range(40)], [f"b{i}yy" for i in range(40)]
    learned = [" ".join(f"{x} {y}" for x, y in rng.sample(list(zip(first, second)), 20)) for _ in range(60)]
    known = " ".join(f"{x} {y}" for x, y in zip(first, second))
    mixed = " ".join(f"{x} {y}" for x, y in zip(first, second[7:] + second[:7]))
    docs = docs_of(spark, [*learned, known, mixed])
    for shards, block in ((1, 1 << 21), (7, 200)):
        got = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") >= len(learned), block_tokens=block, shards=shards, burn_in=1, samples=1).collect()}
        known_row, mixed_row = got[len(learned)], got[len(learned) + 1]
        assert known_row["base_score"] == pytest.approx(mixed_row["base_score"])
        assert known_row["score"] > mixed_row["score"] + 20


@pytest.mark.parametrize("shards", [1, 5])
def test_word_contexts_sum_to_one(spark, shards):
    """From scores of texts of up to two words, over the vocabulary and an unseen word: what follows the beginning sums to 1.

    With p[w] = P(w | start), s(wx) / s(x) = P(x | w) p[w] / p[x], and each context w sums to 1: a linear system for p.
    """
    learned = ["a b", "a c", "b", "c a b a", "d d d", "a b a b a c"]
    words = ["a", "b", "c", "d", "unseen"]
    docs = docs_of(spark, [*learned, "", *words, *(f"{w} {x}" for w in words for x in words)])
    got = {r["doc_id"] - len(learned): 10 ** r["score"] for r in pitman_yor.score(docs, F.col("doc_id") >= len(learned), shards=shards, burn_in=0, samples=2).collect()}
    n = len(words)
    one = np.array([got[1 + i] for i in range(n)])
    two = np.array([[got[1 + n + i * n + j] for j in range(n)] for i in range(n)])
    p = np.linalg.solve(np.eye(n) - two / one, one)
    assert (p > 0).all() and p.sum() + got[0] == pytest.approx(1, abs=1e-4)


def test_scores_do_not_follow_the_shards(spark):
    """Neither how the pairs are dealt nor a hot token changes a score."""
    docs = docs_of(spark, [f"hot{' hot' * 40} w{i % 50} v{i}" for i in range(400)])
    one, many = ({r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id") % 7 == 2, shards=k, burn_in=1, samples=1).collect()} for k in (2, 16))
    assert many == pytest.approx(one, rel=1e-12)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame([(1, "a b", 3), (2, "a b c", 4)], "doc_id long, text string, score long").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = pitman_yor.score(docs, F.lit(False), burn_in=0, samples=1)
    assert dict(got.dtypes)["doc_id"] == kind and sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2"]


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint64) << 40, np.zeros(0, np.uint8), np.array([1.5, -2], np.float32), np.array([True, False])]
    for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_pitman_yor_defined_cases(spark):
    got = {r["doc_id"]: r for r in pitman_yor.score(docs_of(spark, ODD), F.lit(False), burn_in=0, samples=1).collect()}
    assert len(got) == len(ODD) and got[0]["n_tokens"] == got[1]["n_tokens"] == 1 and got[0]["score"] == got[1]["score"]
    none = pitman_yor.score(docs_of(spark, ODD), F.lit(True), burn_in=0, samples=1).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert pitman_yor.score(docs_of(spark, []), F.lit(False), burn_in=0, samples=1).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in pitman_yor.score(nulls, common.fold("doc_id", 7) == 2).collect()) == ["1", "1", "None"]


# --- 10 line dedup ------------------------------------------------------------------


def slow_lines(rows, at_least, chars=1):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = collections.Counter(k for x in rows for k in {key(y) for y in (x or "").split("\n")})
    bad = {k for k, c in n.items() if c >= at_least and len(k) >= chars}
    out = []
    for x in rows:
        lines = (x or "").split("\n")
        kept = [y for y in lines if key(y) not in bad]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(6)
    lines = ["Common", " common\t", "COMMON", "", "  ", "é", "É", "rare", "x ", "a  b", "\x0b"]
    rows = [None, "", "\n", "only", *["\n".join(rng.choices([*lines, f"own{i}"], k=rng.randint(0, 30))) for i in range(60)], "\n".join(f"l{i}" for i in range(3000)) + "\ncommon\nlast"]
    for at_least, chars in ((5, 1), (2, 1), (5, 3)):
        got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(docs_of(spark, rows), at_least, chars).collect()}
        for i, want in enumerate(slow_lines(rows, at_least, chars)):
            assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["text"] or "") == want, (i, at_least)
            assert got[i]["score"] == i


def test_line_defined_cases(spark):
    assert line_dedup.drop_common_lines(docs_of(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "a\nb")] * 3 + [(None, "a\nc"), (2, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in line_dedup.drop_common_lines(twice, 4).collect())
    assert got == [("1", "b", 1)] * 3 + [("2", None, 0), ("None", "c", 1)] or got == sorted([("1", "b", 1)] * 3 + [("2", None, 0), ("None", "c", 1)], key=str)


def test_lines_of_a_repeated_row_count_once(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a\nown")] * 10 + [(None, "b")] * 10 + [(2 + i, f"c\nx{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    dropped = lambda out: {(r["doc_id"], r["n_dropped"]) for r in out.collect()}
    assert dropped(queries.QUERIES["op10_line_dedup"](spark, str(tmp_path))) == {(1, 0), (None, 0), *((2 + i, 1) for i in range(10))}
    assert {r["text"] for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()} == {"a\nown", "b", *(f"x{i}" for i in range(10))}


def test_line_dedup_runs_no_python(spark):
    plan = queries.QUERIES["op10_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- all ----------------------------------------------------------------------------


def test_fold_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", common.fold("id", 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 7 for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.project(", ".join(cols)).fetchall()))


def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    docs, before = documents, documents.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        assert docs.count() <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
        before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontamination", "bpe"]
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in docs.collect()} and whole


def test_pipeline_against_the_operators(spark, documents, texts):
    import corpus_pipeline

    odd = docs_of(spark, [*ODD, "The same words here today", "the SAME words here today", "12 34"]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.identify(spark, odd, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in enumerate([*ODD, "a", "a", ""]) if any(ch.isalpha() for ch in x or "")}
    copies = corpus_pipeline.drop_near_copies(spark, odd.unionAll(odd), SF).collect()
    fps = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert sorted(r["doc_id"] for r in copies) == sorted(set(fps.values()))
    assert corpus_pipeline.drop_lines(spark, odd, SF).where("n_chars != char_length(text)").count() == 0
    assert corpus_pipeline.drop_leaks(spark, documents, SF).count() < len(texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).count() == 0


def test_near_copies_of_a_repeated_id(spark):
    """One row of each group, also where a doc_id has several texts."""
    import corpus_pipeline

    sky, soup = "the wide blue sky over the quiet northern hills at noon", "boil water and add salt onions carrots beans then wait an hour"
    rows = [(1, sky), (1, sky), (1, soup), (1, sky.upper()), (2, soup), (3, "zebras run fast across dry yellow plains chasing distant rain clouds"), (2, "quick engines hum below grey harbour cranes lifting rusty containers")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    got = sorted((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == sorted([(1, sky), (1, soup), (3, rows[5][1]), (2, rows[6][1])])
