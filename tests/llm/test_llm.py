"""Each operator against a plain version, on rows with every oddity."""

import collections
import hashlib
import math
import re
import zlib
from array import array

import numpy as np
import pytest
from oddities import odd_rows
from pyspark.sql import functions as F

W = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
ROWS = odd_rows()


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def test_grace_dedup(odd, empty):
    from gridloom.llm.op4_grace_dedup import dedup

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ROWS]
    want = []
    for (i, *_), t in zip(ROWS, norm, strict=True):
        ids = [a[0] for a, b in zip(ROWS, norm, strict=True) if b == t]
        want.append((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    for options in ({}, {"bucket_bytes": 600, "fan_bits": 1}, {"bucket_bytes": 150, "fan_bits": 20}):
        got = dedup(odd, **options).collect()
        assert multiset((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == multiset(want)
        stays = [r for r in got if r["kept"]]
        assert len(stays) == len(set(norm))
        assert all(r["doc_id"] == r["keep_id"] for r in stays)
    assert dedup(empty).count() == 0


def test_open_table_compares_contents():
    from gridloom.llm.op4_grace_dedup import OpenTable

    contents = [b"a", b"b", b"a", b"c", b"b"]
    assert OpenTable(5).find(np.zeros(5, np.int64), contents.__getitem__).tolist() == [0, 1, 0, 3, 1]


def _fingerprint(t, k=3):
    import xxhash

    w = W.findall(lower(t or ""))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_simhash(odd, empty, bucket_rows):
    from gridloom.llm.op5_simhash import near_duplicates

    fp = [_fingerprint(t) for _, t, *_ in ROWS]
    group = list(range(len(fp)))
    for _ in range(len(fp)):
        group = [min(group[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 2) for i in range(len(fp))]
    least = {g: min((ROWS[j][0] for j in range(len(fp)) if group[j] == g and ROWS[j][0] is not None), default=None) for g in set(group)}
    want = [(r[0], f"{f:016x}", least[g]) for r, f, g in zip(ROWS, fp, group, strict=True)]
    got = near_duplicates(odd, bucket_rows=bucket_rows).collect()
    assert multiset((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == multiset(want)
    assert sum(r["kept"] for r in got) == len(set(group))
    assert near_duplicates(empty).count() == 0


def test_spanning_links_join_what_brute_force_joins():
    from gridloom.llm.op5_simhash import _pivots, spanning_links

    r = np.random.default_rng(0)
    base = r.integers(0, 2**64, 6, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 6).astype(np.uint64)) for _ in range(30)])[:, None]
    links = spanning_links(fps, _pivots(16, 1), 2)
    label = list(range(len(fps)))
    for i, j, d in links:
        assert np.bitwise_count(fps[i] ^ fps[j]).sum() == d <= 2
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    for i in range(len(fps)):
        for j in range(i):
            if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 2:
                assert label[i] == label[j]


@pytest.mark.parametrize("hot_records", [1024, 1])
def test_substrings(odd, empty, hot_records):
    from gridloom.llm.op6_superkmers import dedup_substrings

    words = [W.findall(t or "") for _, t, *_ in ROWS]
    ids = [math.inf if r[0] is None else r[0] for r in ROWS]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - 49):
            x = tuple(w[k : k + 50])
            first[x] = min(first.get(x, math.inf), i)
    want = []
    for (d, *_), i, w in zip(ROWS, ids, words, strict=True):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert sum(x[2] for x in want) > 500
    got = dedup_substrings(odd, hot_records=hot_records).collect()
    assert multiset((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in got) == multiset(want)
    assert all(sum(b - a for a, b in r["removed"]) == r["n_removed"] for r in got)
    assert dedup_substrings(empty).count() == 0


def test_equal_hashes_do_not_make_windows_equal(monkeypatch):
    from gridloom.llm import op6_superkmers as m

    monkeypatch.setattr(m, "_runs", lambda h, n: np.zeros(len(h) - n + 1, np.uint64))
    a, b = [bytes([97 + i % 5]) for i in range(6)], [b"z"] * 6
    got, bounds = m.first_documents([b" ".join(a), b" ".join(b), b" ".join(a)], np.array([7, 1, 3]), 5)
    assert (got.tolist(), bounds.tolist()) == ([3, 3, 1, 1, 3, 3], [0, 2, 4, 6])


def test_token_counts(odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from gridloom.llm.op7_fst_tokens import count_tokens

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS]
    assert multiset((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(odd).collect()) == multiset(want)
    assert count_tokens(empty).count() == 0


def test_transducer_on_odd_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from gridloom.llm.op7_fst_tokens import Transducer

    path = public_tokenizers.path("word_bpe_49k.json")
    r, letters = random.Random(1), "aeiou thnrsTXQz'9½ éèßΣς़ñ中文.,!#$|<>\n\t漢​̈ İ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(1500)] + ["x" * 2000 + " y", "", "a" * 700 + "'s" + "b" * 700, "ab" * 5000, "中文" * 900, "<|endoftext|>a<|startoftext|>", "''s it''s 's's"]
    lib, fst = Tokenizer.from_file(path), Transducer(path)
    assert fst.counts(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    fst.forget()
    assert fst.counts(texts[:9]).tolist() == [len(e.ids) for e in lib.encode_batch(texts[:9], add_special_tokens=False)]


def test_mixing(odd, empty):
    from gridloom.llm.op8_mixing import mix

    size = [len(W.findall(t or "")) for _, t, *_ in ROWS]
    by = collections.Counter()
    for r, s in zip(ROWS, size, strict=True):
        by[r[3]] += s
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(size), set(order)
    while True:
        left = total - sum(target[s] for s in order if s not in open_)
        for s in open_:
            target[s] = left * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if target[s] > 2 * by[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * by[s]
        open_ -= over
    got = mix(odd, chunk_docs=5, fan_in=2).collect()
    assert multiset((r["doc_id"], r["size"], r["source_size"]) for r in got) == multiset((r[0], s, by[r[3]]) for r, s in zip(ROWS, size, strict=True))
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = mix(odd.repartition(7), chunk_docs=5, fan_in=2).collect()
    assert multiset((r["doc_id"], r["taken"]) for r in again) == multiset((r["doc_id"], r["taken"]) for r in got)
    assert mix(empty).count() == 0


def test_pivots_keep_expected_copies_and_words():
    from gridloom.llm.op8_mixing import pivot

    r = np.random.default_rng(1)
    size = r.integers(1, 50, 40).astype(float)
    runs = np.array([pivot(np.full(40, 0.3), size, r.random(40)) for _ in range(4000)])
    assert np.abs(runs @ size - 0.3 * size.sum()).max() < 1e-6
    assert np.abs(runs.mean(0) - 0.3).max() < 0.05
    assert ((runs > 0) & (runs < 1)).sum(1).max() <= 1


def test_sentencepiece(odd, empty):
    import public_tokenizers
    import sentencepiece

    from gridloom.llm.op9_sentencepiece import encode_decode

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t, *_ in ROWS:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, tuple(ids), sp.decode(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest()))
    got = encode_decode(odd, outputs=("ids", "decoded", "ids_sha256"), table_chars=50).collect()
    assert multiset((r["doc_id"], tuple(r["ids"]), r["decoded"], r["ids_sha256"]) for r in got) == multiset(want)
    assert encode_decode(empty).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "▁", "▁▁x", "a\n\n b", "\x00", "漢字 かな", "a" * 300, "  \t  x   y  "])
def test_chunk_table(text):
    import public_tokenizers
    import sentencepiece

    from gridloom.llm.op9_sentencepiece import ChunkTable

    path = public_tokenizers.path("piece_bpe_32k.model")
    t, sp = ChunkTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    keys = t.keys(text)
    t.learn(set(keys))
    ids = sp.encode(text, add_bos=True, add_eos=True)
    assert array("I", t.encode(keys)).tolist() == ids
    assert t.decode(keys) == sp.decode(ids)


def test_quality_statistics(odd, empty):
    from gridloom.llm.op10_mcd_quality import judge

    want = []
    for i, t, *_ in ROWS:
        t = t or ""
        w = W.findall(t)
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if W.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = judge(odd).collect()
    assert multiset((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == multiset(want)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert judge(empty).count() == 0


def test_outliers_are_rejected_and_the_rest_kept(spark):
    import random

    from gridloom.llm.op10_mcd_quality import judge

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 300))), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s") for i in range(20)]
    rows += [(2000 + i, " ".join(word() * 5 for _ in range(100)), "en", "s") for i in range(20)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {i for i, *_ in rows if i >= 1000}


def test_url_filter(spark):
    from gridloom.llm.op2_url_filter import RULES, judge, listed

    urls = [None, "", "nohost", "http://", "https://Example.ORG/es/x?q#f", "http://a.example.org/en/12", "http://example.org", "http://org/", "http://xorg/", "ftp://x.com/de/1?utm_source=a&b=1#t", "http://www.x.com/fr/", "http://spam.net/a/", "http://spam.net/a?ref=2", "http://spam.net/b", "http://spam.net/a?x=1"]
    pages = spark.createDataFrame([(i % 9, u, "clash") for i, u in enumerate(urls)] * 2, "page_id int, url string, verdict string")
    block = spark.createDataFrame([("http://spam.net/a",), (None,), ("http://x.org/b",)], "url string")
    keys = listed(spark.createDataFrame(list(RULES), "rule string, verdict string"), block)
    got = collections.Counter((r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, keys).collect())
    want = []
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [(r, v) for r, v in RULES for h in [r.split("/")[0]] if (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        best = max(fit, key=lambda x: len(x[0]), default=(None, None))
        want.append((host, path, best[0], best[1] or ("block" if u in ("http://spam.net/a/", "http://spam.net/a?ref=2") else "allow")))
    assert got == collections.Counter(want * 2)
    assert judge(pages.limit(0), keys).count() == 0
    assert {r["verdict"] for r in judge(pages, keys.limit(0)).collect()} == {"allow"}


def test_blocked_bloom_has_no_false_negatives(spark):
    from functools import reduce

    from gridloom.llm.op2_url_filter import _bits, bloom

    keys = spark.range(3000).select(F.concat(F.lit("u:"), F.col("id").cast("string")).alias("key"))
    filters = bloom(keys, 97)
    asked = spark.range(6000).select("id", *_bits(F.concat(F.lit("u:"), F.col("id").cast("string")), 97))
    hit = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}") for i in range(8)))
    found = {r["id"] for r in asked.join(filters, "block").where(hit).select("id").collect()}
    assert found >= set(range(3000))
    assert len(found) < 3600


def test_toxicity(spark, odd, empty):
    import random

    from gridloom.llm.op3_toxicity import classify, fit, sample

    r = random.Random(1)
    plain = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(3000)]
    rude = ["worthless", "stupidity", "disgusting", "pathetic"]
    def make(bad):
        w = [r.choice(plain) for _ in range(r.randint(40, 200))]
        for _ in range(4 * bad):
            w.insert(r.randrange(len(w)), r.choice(rude))
        return " ".join(w)
    rows = [(i, make(i % 4 == 0)) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    texts, toxic, share = sample(docs, labels)
    assert abs(share - np.mean(toxic)) < 1e-9
    assert len(texts) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(600))
    model = fit(texts, toxic, share)
    rare = fit([t for t, y in zip(texts, toxic, strict=True) if y] + [t for t, y in zip(texts, toxic, strict=True) if not y][:40], [1] * sum(toxic) + [0] * 40, share)
    assert abs(np.mean([x["score"] for x in classify(docs, rare).collect()]) - share) < 0.15
    held = [x for x in classify(docs, model, 0.5).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert np.mean([x["predicted"] == (x["doc_id"] % 4 == 0) for x in held]) > 0.95
    got = classify(odd, model).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= x["score"] <= 1 for x in got)
    assert classify(empty, model).count() == 0
    assert 0 <= classify(odd, fit([], [])).first()["score"] <= 1


@pytest.mark.parametrize("depth", [3, 5])
def test_context_tree_weighting(odd, empty, depth):
    from gridloom.llm.op1_ctw import language_scores, words_of

    texts = [b" ".join(words_of(t)) + b"\n" for _, t, *_ in ROWS]
    out = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, *_ in ROWS]
    count, below = collections.Counter(), collections.defaultdict(set)
    steps = lambda b: [(b[p - depth : p], (256 | b[p]) >> (8 - k), b[p] >> (7 - k) & 1) for p in range(depth, len(b)) for k in range(8)]
    for t, h in zip(texts, out, strict=True):
        if not h:
            for c, u, bit in steps(b"\n" * depth + t):
                for d in range(depth + 1):
                    count[c[depth - d :], u, bit] += 1
                    if d:
                        below[c[depth - d + 1 :], u].add(c[depth - d :])
    log, known = {}, lambda c, u: count[c, u, 0] + count[c, u, 1]
    kt = lambda c, u: math.lgamma(count[c, u, 0] + 0.5) + math.lgamma(count[c, u, 1] + 0.5) - math.log(math.pi) - math.lgamma(known(c, u) + 1)
    def weighted(c, u):
        if (c, u) not in log:
            log[c, u] = kt(c, u) if len(c) == depth else np.logaddexp(kt(c, u), sum(weighted(x, u) for x in below[c, u])) - math.log(2)
        return log[c, u]
    def chance(c, u, bit, d=0):
        own = c[depth - d :]
        p = (count[own, u, bit] + 0.5) / (known(own, u) + 1)
        if d == depth:
            return p
        if not known(own, u):
            return 0.5
        stop = math.exp(kt(own, u) - math.log(2) - weighted(own, u))
        return stop * p + (1 - stop) * chance(c, u, bit, d + 1)
    vocabulary = collections.Counter(w for (_, t, *_), h in zip(ROWS, out, strict=True) if not h for w in [*W.findall(lower(t or "")), "\n"])
    total, distinct = sum(vocabulary.values()), len(vocabulary)
    want = collections.defaultdict(list)
    for (i, t, *_), h, b in zip(ROWS, out, texts, strict=True):
        w = [*W.findall(lower(t or "")), "\n"]
        base = sum(math.log10((vocabulary[x] + 1) / (total + distinct + 1)) for x in w)
        score = sum(math.log10(chance(c, u, bit)) for c, u, bit in steps(b"\n" * depth + b)) if len(b) < 700 else None
        want[i, len(w)].append((h, sum(vocabulary[x] > 0 for x in w), base, score))
    for options in ({}, {"top_words": 5, "shard_bytes": 20_000 if depth == 3 else 400_000}):
        got = language_scores(odd, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2, depth=depth, **options).collect()
        assert len(got) == len(ROWS)
        for r in got:
            h, n, base, score = want[r["doc_id"], r["n_tokens"]][0]
            assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, n, total)
            assert abs(r["base_score"] - base) < 1e-6
            assert score is None or abs(r["score"] - score) < 1e-4 * abs(score) + 1e-6
    assert language_scores(empty, F.lit(False)).count() == 0
    unlearned = language_scores(odd, F.lit(True), depth=depth).where("n_tokens = 1").first()
    assert abs(unlearned["score"] - 8 * math.log10(0.5)) < 1e-6


def test_moderate_junk_is_rejected(spark):
    import random

    from gridloom.llm.op10_mcd_quality import CUTOFF, judge

    assert abs(math.exp(-CUTOFF / 2) * (1 + CUTOFF / 2) - 0.001) < 1e-6
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(60, 300))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + ("#" if k % 8 == 0 else "") for k in range(200)), "en", "s") for i in range(10)]  # 12.5 symbols in 100 words
    line = "a line of six plain words"
    rows += [(2000 + i, "\n".join(x for k in range(20) for x in (" ".join(word() for _ in range(14)), line if k % 2 else word())), "en", "s") for i in range(10)]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} >= {i for i, *_ in rows if i >= 1000}
    assert sum(not r["kept"] for r in got if r["doc_id"] < 1000) <= 2


def test_row_numbers_outlive_another_split_of_files(spark, tmp_path):
    import corpus_pipeline
    from gridloom.llm import common

    texts = [f"text number {i} " + "x" * (i % 50) for i in range(300)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + texts[:100])], schema).repartition(9).write.parquet(path)
    keys = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1k"}
    out = corpus_pipeline.exact_dedup(spark, spark.read.parquet(path), None)
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        assert sorted(r["text"] for r in out.collect()) == sorted(texts)
        spool, calls = common.spool, []

        def turning(*a, **k):  # every second spool scans by other splits
            calls.append(1)
            for c, v in (keys if len(calls) % 2 else was).items():
                spark.conf.set(c, v)
            return spool(*a, **k)

        from gridloom.llm.op1_ctw import language_scores

        docs = spark.read.parquet(path)
        want = sorted((r["doc_id"], round(r["score"], 6)) for r in language_scores(docs, F.col("doc_id") % 7 == 2).collect())
        common.spool = turning
        try:
            got = sorted((r["doc_id"], round(r["score"], 6)) for r in language_scores(docs, F.col("doc_id") % 7 == 2).collect())
        finally:
            common.spool = spool
        assert got == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("most", [32, 1])
def test_state_maps_compose(monkeypatch, most):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from gridloom.llm import op7_fst_tokens as m

    monkeypatch.setattr(m, "MAP_STATES", most)
    monkeypatch.setattr(m, "CHUNK", 16)
    monkeypatch.setattr(m, "SEGMENT", 500 if most == 1 else 1 << 20)
    monkeypatch.setattr(m, "MAX_STATES", 50 if most == 1 else 100_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(5)
    texts = ["a" * 1000, "ab" * 700 + " c", "hello" * 300, "x" * 90 + " " + "lorem ipsum " * 9 + "z" * 200, "".join(r.choice("aeinrst") for _ in range(3000)), "é漢" * 300, "", "b" * 17]
    lib, fst = Tokenizer.from_file(path), m.Transducer(path)
    assert fst.counts(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def _fast_mcd(x, share, floor, consistency, starts=60, seed=0):
    """Plain FAST-MCD: concentration steps from many small random subsets, each to its end; the least determinant."""
    r, n, h = np.random.default_rng(seed), len(x), math.ceil(share * len(x))
    best = (math.inf, None, None)
    for _ in range(starts):
        pick = r.choice(n, 6, replace=False)
        was = math.inf
        for _ in range(100):
            mean, cov = x[pick].mean(0), np.cov(x[pick].T, bias=True) + np.diag(floor)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            pick = np.argsort(d, kind="stable")[:h]
            now = np.linalg.det(np.cov(x[pick].T, bias=True) + np.diag(floor))
            if now >= was * (1 - 1e-9):
                break
            was = now
        if was < best[0]:
            best = (was, x[pick].mean(0), consistency * np.cov(x[pick].T, bias=True) + np.diag(floor))
    return best[1], best[2]


def test_mcd_is_near_a_fit_of_many_starts(spark):
    from gridloom.llm import op10_mcd_quality as m

    r = np.random.default_rng(3)
    mix = np.array([[0.5, 0, 0, 0], [0.3, 0.6, 0, 0], [0.1, 0.2, 0.4, 0], [0, 0.3, 0.1, 0.7]])
    x = np.r_[r.normal(size=(900, 4)) @ mix.T + [6, 1, 1, 2], r.normal(size=(150, 4)) * 0.3 + [9, 5, 4, 6]]
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, x1 double, x2 double, x3 double, x4 double")
    mean, cov = _fast_mcd(x, m.SUBSET, np.array(m.FLOOR), m.CONSISTENCY)
    want = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    far = m._distance(rows, m.estimates(rows)).select("x1", "d2").collect()
    got = dict((round(v["x1"], 9), v["d2"]) for v in far)
    d2 = np.array([got[round(float(v[0]), 9)] for v in x])
    assert np.mean((d2 > m.CUTOFF) == (want > m.CUTOFF)) > 0.995
    assert np.corrcoef(np.sqrt(d2), np.sqrt(want))[0, 1] > 0.99
    assert (d2[900:] > m.CUTOFF).all()


def test_hosts_of_many_labels_have_few_candidates(spark):
    from gridloom.llm.op2_url_filter import RULES, candidates, host, judge, listed, path

    long = "http://" + "a." * 20_000 + "example.org/es/" + "x" * 50_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "b" * 100_000 + ".com/de/")], "page_id long, url string")
    urls = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    assert candidates(urls, [1, 4, 5], 2).where("url like 'http://a%'").count() == 7
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(pages, listed(spark.createDataFrame(list(RULES), "rule string, verdict string"))).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: ("com/de/", "block")}


def test_mixing_deals_equal_rows_to_chunks(spark):
    from gridloom.llm import op8_mixing as m

    rows = [(7, "one two three", "a")] * 60 + [(i, " ".join(["w"] * (i % 9)), "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    ranks = m._twins_apart(docs.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64("doc_id", "text").alias("_rank")), 5).groupBy("_rank").count()
    assert ranks.agg(F.max("count")).first()[0] <= 5
    seen = []
    for n in (2, 7):
        got = m.mix(docs.repartition(n), chunk_docs=5, fan_in=2).collect()
        assert len(got) == len(rows)
        for s in "ab":
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 8
        seen.append(multiset((r["doc_id"], r["taken"]) for r in got))
    assert seen[0] == seen[1]
