"""The pipeline's stages, each on what its predecessor kept, against brute force at the smallest scale."""

import itertools
import re

import numpy as np
import tiktoken
import xxhash

import corpus_pipeline
import public_tokenizers
from heapsift.llm import bpe, toxicity
from heapsift.llm.common import table

SF = "/root/testdata/sf0.001"
ALNUM, SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def windows(tokens, n):
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def fingerprint(text):
    t = re.findall(SPACE, lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in (windows(t, 3) or ([tuple(t)] if t else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def connected(n, linked):
    root = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if root[i] != root[j] and linked(i, j):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def without_lines(rows):
    distinct = list(dict.fromkeys(x for t in rows.values() for x in t.split("\n") if x.strip(" ")))
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} for x in distinct]
    size = [len(s) for s in sets]
    near = lambda i, j: size[i] and size[j] and 0.8 * max(size[i], size[j]) <= min(size[i], size[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = dict(zip(distinct, connected(len(distinct), near)))
    seen, out = set(), {}
    for doc in sorted(rows):
        kept = []
        for x in rows[doc].split("\n"):
            if x.strip(" ") and root[x] in seen:
                continue
            seen.add(root.get(x))
            kept.append(x)
        out[doc] = "\n".join(kept)
    return out


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity.report(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    items = [re.findall(ALNUM, lower(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 0:
            kept = {d: t for d, t in kept.items() if d not in bad}
        elif k == 1:
            kept = without_lines(kept)
        elif k == 2:
            ids = sorted(kept)
            prints = [fingerprint(kept[d]) for d in ids]
            root = connected(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
            kept = {d: kept[d] for i, d in enumerate(ids) if root[i] == i}
        elif k == 3:
            grams = {w for t in items if t for w in windows(t, min(10, len(t)))}
            sizes = {len(w) for w in grams}
            kept = {d: t for d, t in kept.items() if not any(w in grams for n in sizes for w in windows(re.findall(ALNUM, lower(t)), n))}
        if k < 4:
            assert docs.columns == columns
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert got == kept and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(open(path, "rb").read()))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: list(r["ids"]) for r in docs.collect()} == {d: reference.encode_ordinary(t) for d, t in kept.items()}
    assert np.all([r["n_tokens"] == len(r["ids"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept)
