"""The operators on a few hard rows: nulls, empty, short, long and repeated texts, null ids, columns with names that operators use themselves."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash

import public_tokenizers
from heapsift.llm import bpe, decontaminate, licenses, lines, neighbours, quality, simhash, substrings, toxicity, warc

ALNUM, SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w int, score double, count int, gone string, fp long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make_rows():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "Ço", "di", "fu", "gé", "ho") for b in ("ra", "s", "to", "um", "ve", "xi", "日本")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, item = text(70), "Seven plus five gives twelve and nine less four is five"
    long = text(60_000)
    near = text(300).split()
    other = list(near)
    other[150] = "changed"
    texts = [
        None, "", " \t\n ", "one", "one", "two words", text(80) + " " + passage + " " + text(40), text(30) + "\n" + passage + ".\n" + passage + " " + text(9), long, long,
        text(40) + " " + item.upper() + ", " + text(30), "you are an idiot and a MIT license holder. Apache  License", "First line here it is\n\nSecond line here it is\nFirst line here it is",
        "First line here it is!\nanother line of text", " ".join(near), " ".join(other), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met",
        "don't \x00stop now  <|endoftext|> 👍🏽 ǅ１２",
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), 1, 0.5, 2, "x", 3) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "one", None, None, 3, 1, None, 2, None, 3)], item


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def documents(spark, rows):
    return spark.createDataFrame(rows[0], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def windows(tokens, n):
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    return spark.createDataFrame([(7, rows[1], 1), (10, "two  WORDS", 1), (9, None, 1), (8, "", 1), (10, "two words", 1), (None, "idiot and", 1)], "item_id long, text string, k int")


def test_decontaminate(rows, documents, benchmark):
    items = [(r["item_id"], re.findall(ALNUM, lower(r["text"]))) for r in benchmark.collect()]
    expected = {}
    for doc, text, *_ in rows[0]:
        tokens, hit, ids = re.findall(ALNUM, lower(text)), set(), set()
        for item, t in items:
            k = min(10, len(t))
            for win in windows(t, k) if k else ():
                for i, x in enumerate(windows(tokens, k)):
                    if x == win:
                        hit |= set(range(i, i + k))
                        ids |= set() if item is None else {str(item)}
        expected[doc, len(tokens), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] = 1
    got = [tuple(r) for r in decontaminate.report(documents, benchmark).collect()]
    assert len(got) == len(set(got)) and set(got) == set(expected)
    kept = decontaminate.clean_documents(documents, benchmark)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {None, *range(18)} - {5, 10, 11}


def test_clean_documents_judges_each_row(spark, rows, benchmark):
    hit = f"before it {rows[1]} after it"
    docs = spark.createDataFrame([(None, hit), (None, "a clean text"), (None, None), (1, hit), (1, "another clean text"), (1, hit), (2, "clean")], "doc_id long, text string")
    kept = [tuple(r) for r in decontaminate.clean_documents(docs, benchmark).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a clean text"), (None, None), (1, "another clean text"), (2, "clean")], key=str)


def test_bpe(rows, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(open(path, "rb").read()))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc, text, *_ in rows[0]:
        ids = reference.encode_ordinary(text or "")
        want.append((doc, ids, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [(r["doc_id"], list(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(documents, path, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(bpe.PerfectHash([b"a", b"b", b"ab"]).get(t) == i for i, t in enumerate((b"a", b"b", b"ab"))) and bpe.PerfectHash([]).get(b"a") is None


def brute_fingerprint(text):
    t = re.findall(SPACE, lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in (windows(t, 3) or ([tuple(t)] if t else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(rows, documents):
    prints = [(doc, brute_fingerprint(text)) for doc, text, *_ in rows[0]]
    group = {f: {f} for _, f in prints}
    for a, b in itertools.combinations(list(group), 2):
        if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
            group[a] |= group[b]
            for f in group[b]:
                group[f] = group[a]
    want = [(doc, f"{f:016x}", min((d for d, g in prints if g in group[f] and d is not None), default=None)) for doc, f in prints]
    got = [tuple(r) for r in simhash.report(documents).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [r["doc_id"] for r in simhash.keep_one(documents).collect()]
    assert sorted(d for d in kept if d is not None) == sorted({c for _, _, c in want}) and kept.count(None) == 1


def test_links_connect_like_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64)) for _ in range(60)]))
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {int(f): int(f) for f in fps}
    for a, b in simhash.spanning_links(fps):
        root[find(b)] = find(a)
    brute = {int(f): int(f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(map(int, fps), 2):
            if (a ^ b).bit_count() <= 3 and brute[a] != brute[b]:
                brute[a] = brute[b] = min(brute[a], brute[b])
                changed = True
    assert len(pairs) and len({find(int(f)) for f in fps}) == len(set(brute.values()))


@pytest.mark.parametrize("in_memory", [substrings.IN_MEMORY, 3])
def test_substrings(rows, documents, monkeypatch, in_memory):
    monkeypatch.setattr(substrings, "IN_MEMORY", in_memory)
    least = {}
    for doc, text, *_ in sorted((r for r in rows[0] if r[0] is not None), key=lambda r: r[0]):
        for x in windows(re.findall(SPACE, text or ""), 50):
            least.setdefault(x, doc)
    want = []
    for doc, text, *_ in rows[0]:
        tokens = re.findall(SPACE, text or "")
        gone = [False] * len(tokens)
        for i, x in enumerate(windows(tokens, 50)):
            if doc is not None and least[x] < doc:
                gone[i : i + 50] = [True] * 50
        want.append((doc, len(tokens), sum(gone), hashlib.sha256(" ".join(t for t, g in zip(tokens, gone) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substrings.report(documents).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(g[2] for g in got) > 60_000


def test_lines(rows, documents):
    distinct = list(dict.fromkeys(x for r in rows[0] if r[0] is not None and r[1] is not None for x in r[1].split("\n") if x.strip(" ")))
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} for x in distinct]
    root = list(range(len(distinct)))
    for i, j in itertools.combinations(range(len(distinct)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    of, keeper = {x: root[i] for i, x in enumerate(distinct)}, {}
    for doc, text, *_ in rows[0]:
        for x in (text or "").split("\n") if doc is not None else ():
            if x.strip(" "):
                keeper[of[x]] = min(doc, keeper.get(of[x], doc))
    want = []
    for doc, text, *_ in rows[0]:
        kept, seen = [], set()
        for x in (text or "").split("\n"):
            if doc is None or not x.strip(" ") or (keeper[of[x]] == doc and of[x] not in seen):
                kept.append(x)
                seen.add(of.get(x))
        want.append((doc, None if text is None else "\n".join(kept)))
    out = lines.deduplicated(documents)
    assert out.columns == documents.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk", [lines.CHUNK, 1000])
def test_lines_of_one_template(spark, monkeypatch, chunk):
    """Hundreds of lines of one template, too far apart to be similar, and a twin of some of them: each link is between two lines of one large bucket."""
    monkeypatch.setattr(lines, "CHUNK", chunk)
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    template = own(80)
    texts = [template + own(24) for _ in range(400)]
    texts += [t[:-3] + own(3) for t in texts[:100]]
    sets = [{t[i : i + 10] for i in range(len(t) - 9)} for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    assert 300 < len(set(root)) <= 400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in lines.deduplicated(docs).collect() if r["text"]}
    assert kept == set(root)


def test_licenses(rows, documents):
    want = set()
    for doc, text, *_ in rows[0]:
        t = re.findall(ALNUM, lower(text))
        found = sorted((i, label) for p, label in licenses.PHRASES.items() for i, x in enumerate(windows(t, len(p.split()))) if list(x) == p.split())
        want.add((doc, len(t), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))))
    got = licenses.report(documents).collect()
    assert {tuple(r)[:6] for r in got} == want and all(0 <= r["score"] <= 1 for r in got)
    assert {r["labels"] for r in got if r["doc_id"] == 16} == {"bsd"} and {r["labels"] for r in got if r["doc_id"] == 11} == {"apache,mit"}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = [v.astype(np.float32).tolist() for v in x]
    vectors[1:41] = [vectors[0]] * 40  # a group of copies, larger than what is returned
    vectors[50:56] = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in enumerate(vectors)] + [(None, vectors[0], 1.0, 2), (700, vectors[700], 1.0, 2)], "vec_id long, embedding array<float>, score double, bucket int")
    good = {i: np.array(v, dtype=float) for i, v in enumerate(vectors) if i not in range(50, 56)}
    found: dict[int, list] = {}
    for r in neighbours.report(df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        assert all(abs(s - good[q] @ good[v]) < 1e-12 and v != q for v, s in rows) and len(rows) == 20
        assert [v for v, _ in rows] == [v for v, _ in sorted(rows, key=lambda t: (-t[1], t[0]))]
        best = sorted((i for i in good if i != q), key=lambda i: (-float(neighbours.exact(good[q][None], good[i][None])[0]), i))[:20]
        hits += len(set(best) & {v for v, _ in rows})
    assert hits / (20 * len(found)) >= 0.9
    assert [v for v, _ in found[0]] == list(range(1, 21))


@pytest.mark.parametrize("module,label,word", [(toxicity, "toxic", "idiot"), (quality, "quality", "fine")])
def test_classifiers(spark, module, label, word):
    rng = random.Random(4)
    body = lambda i: " ".join(rng.choice(("la", "mo", "ni", "pu")) + str(i % 7) for _ in range(20)) + (f" {word}" if i % 3 == 0 else "")
    docs = spark.createDataFrame([(i, body(i), "en", f"s{i % 3}", 50, 0.1) for i in range(600)] + [(None, None, None, None, None, 0.1), (5, "", None, None, None, 0.1)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)] + [(None, 1), (3, None), (7, 0)], f"doc_id long, {label} int")
    rows = module.report(docs, marks).collect()
    assert len(rows) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] != 5]
    assert len(unseen) > 80 and np.mean([r["predicted"] == int(r["doc_id"] % 3 == 0) for r in unseen]) > 0.95
    assert module.report(docs, marks.limit(0)).select("score").distinct().count() == 1


def test_quality_learns_from_all_unlabelled(spark):
    """Each unlabelled document has a word of its own, which only pseudo-labels can teach: with a small sample of labels all of them count still."""
    rng = random.Random(6)
    body = lambda i: " ".join(rng.choice(("la", "mo", "ni", "pu")) for _ in range(20)) + (" fine" if i % 2 else " poor") + (f" own{i}" if i >= 300 else "")
    docs = spark.createDataFrame([(i, body(i), "en", f"s{i % 2}", 50) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.train(docs, marks, sample=150)
    assert all(model.text[0][quality.bucket(f"w own{i}", quality.TEXT)] != 0 for i in range(300, 900))


def test_warc(spark):
    rows = [
        (1, "HTTP://A.example:80/x?b=2&utm_source=q&a=1#f", 10, "response", 200, {"etag": '"1"', "content-length": "5", "date": "d1"}),
        (2, "https://a.example/x?a=1&b=2", 200_000, "response", 200, {"etag": '"2"', "content-length": "6"}),
        (3, "http://a.example/x?b=2&a=1", 20, "revisit", 304, {"etag": 'W/"1"', "content-length": "0", "date": "d2"}),
        (4, "http://a.example/x?b=2&a=1", 900_000, "revisit", 304, {"etag": '"1"'}),
        (5, "http://a.example/x?b=2&a=1", 10, "revisit", 304, {"etag": '"1"'}),
        (6, None, 900_000, "revisit", 304, {}),
        (7, "http://a.example/x?b=2&a=1", 200_001, "revisit", 304, None),
        (8, "http://a.example/x?b=2&a=1", 300_000, "response", 404, {"etag": '"1"'}),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, ts long, kind string, http_status int, headers map<string,string>, status string")
    got = {r["record_id"]: (r["status"], r["response_id"], r["merged_headers"]) for r in warc.resolve_revisits(df).collect()}
    assert got == {
        3: ("resolved", 1, {"etag": 'W/"1"', "content-length": "5", "date": "d2"}), 4: ("validator_mismatch", 2, None), 5: ("no_earlier", None, None), 6: ("no_earlier", None, None), 7: ("no_validator", 2, None),
    }


def test_lines_of_one_large_bucket(spark):
    """800 lines that share a head of 200 characters: pairs that differ in their last character are similar, others aren't."""
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = own(200)
    texts = [x for _ in range(400) for a in [head + own(60)] for x in (a, a[:-1] + "-")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = lines.line_groups(lines.split_lines(docs))
    assert groups.select("root").distinct().count() == 400 and groups.count() == 800


def test_lines_are_worked_on_once(spark):
    """A line is encoded once for its signature and once for each pair's side, and the members of buckets are counted once."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1, "a line of text")], "h long, line string")
    assert plan(lines.signatures(rows)).count("UTF-32") == 1
    pairs = lines.candidates(lines.bucketed(spark.createDataFrame([(1, 1), (1, 2)], "key long, h long")))
    assert plan(pairs).count("count(1) windowspec") == 1
    compared = plan(lines.similar(pairs, rows))
    assert compared.count("UTF-32") == 2 and "regexp" not in compared


def test_lines_of_repeats_and_rare_characters(spark):
    """Shingles count once however often they stand in a line, and are of characters, not of their units."""
    tail = "".join(chr(0x1F300 + i) for i in range(120))
    groups = [
        ["ab" * 30, "ab" * 45, "ab" * 45 + "a"], ["👍" * 12, "👍" * 400], [tail, tail[:-9], tail + "é"],
        [tail[::-1]], ["abcdefghij"], ["👍👍👍👍👍👍"], ["x" * 9], ["x" * 9 + "y"],
    ]
    texts = [x for g in groups for x in g]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in lines.deduplicated(docs).collect() if r["text"]}
    assert kept == {texts.index(g[0]) for g in groups}


def test_columns_of_the_operators_own_names(spark, rows, benchmark):
    docs = spark.createDataFrame([(1, f"x {rows[1]}", 1, 2, 3, 4, 5, 6, 7), (2, "a line that is here twice\nb", 1, 2, 3, 4, 5, 6, 7), (3, "a line that is here twice", 1, 2, 3, 4, 5, 6, 7)], "doc_id long, text string, _doc int, _id int, _tid int, _cut int, _gone int, _chars int, _rank int")
    assert [tuple(r) for r in decontaminate.clean_documents(docs, benchmark).orderBy("doc_id").collect()] == [tuple(r) for r in docs.where("doc_id > 1").orderBy("doc_id").collect()]
    assert [tuple(r)[1:] for r in lines.deduplicated(docs).orderBy("doc_id").collect()] == [(f"x {rows[1]}", 1, 2, 3, 4, 5, 6, 7), ("a line that is here twice\nb", 1, 2, 3, 4, 5, 6, 7), ("", 1, 2, 3, 4, 5, 6, 7)]
    assert simhash.keep_one(docs).columns == docs.columns
    records = spark.createDataFrame([(1, "http://a/", 10, "response", 200, {"etag": "1"}, "k", 1, 2, 3, 4), (2, "http://a/", 20, "revisit", 304, {"etag": "1"}, "k", 1, 2, 3, 4)], "record_id long, url string, ts long, kind string, http_status int, headers map<string,string>, _key string, _block int, _id int, _response int, _stored int")
    got = warc.resolve_revisits(records).collect()
    assert [tuple(r) for r in got] == [(2, "http://a/", 20, "revisit", 304, {"etag": "1"}, "k", 1, 2, 3, 4, "resolved", 1, {"etag": "1"})]


def test_keep_one_of_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "b c d"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_one(docs).collect()} <= {(1, "a b c"), (2, "a b c")}


def test_scan_without_broadcast(documents, benchmark):
    key = lambda r: str(tuple(r))
    assert sorted(decontaminate.scan(documents, benchmark, broadcast_bytes=0).collect(), key=key) == sorted(decontaminate.scan(documents, benchmark).collect(), key=key)


def test_license_spans(spark):
    docs = spark.createDataFrame([(1, "under the general public license here")], "doc_id long, text string")
    (span,) = licenses.scan(docs).first()["spans"]
    assert (span["label"], span["start"], span["len"]) == ("gpl", 2, 3)


def test_label_model_sees_no_labels():
    """Voters of different accuracy, one of them twice: the posteriors find the hidden kind of nearly all rows from the votes alone."""
    rng = np.random.default_rng(3)
    hidden = rng.random(4000) < 0.15
    votes = np.column_stack([np.where(hidden, rng.random(4000) < hit, rng.random(4000) < 0.02) for hit in (0.8, 0.7, 0.6, 0.6, 0.5)])
    votes = np.column_stack([votes, votes[:, 4]])
    post, accuracies, discounts = toxicity.label_model(votes)
    assert np.mean((post > 0.5) == hidden) > 0.95 and abs(accuracies[0, 0] - 0.8) < 0.1
    assert discounts[5] < 0.8 and discounts[0] > discounts[5]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (
        decontaminate.report(empty, items), bpe.report(empty, path, public_tokenizers.PATTERN), simhash.report(empty), substrings.report(empty), lines.report(empty), licenses.report(empty),
        toxicity.report(empty, labels), quality.report(empty, labels), neighbours.report(spark.createDataFrame([], "vec_id long, embedding array<float>")), warc.report(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0
