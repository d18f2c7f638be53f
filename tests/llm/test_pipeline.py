import pytest
from oracle import SF, same

import corpus_pipeline
from gridloom import llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same(spark, llm.queries()[name], SQL[name], SF)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF).toPandas()
        assert 0 < len(out)
        if name != "sentencepiece":
            assert list(out.columns) == columns
            docs = spark.createDataFrame(out, docs.schema)
        if name == "exact_dedup":
            assert out.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True).nunique() == len(out)
        if name.endswith("dedup") or name == "toxicity":
            assert len(out) <= before
    rows = corpus_pipeline.run(spark, SF).count()
    assert rows == len(out)


def _sets(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup_equals_brute_force(spark):
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(30))  # a common passage
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for k in range(60):
        base = [word() for _ in range(r.randint(40, 300))]
        texts.append(" ".join(base) + " " + line)
        for _ in range(r.randint(1, 3)):  # changed words: similarities of about 0.6 to 0.95
            copy = list(base)
            for _ in range(max(1, int(len(copy) * r.uniform(0.005, 0.05)))):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + line if k % 2 else ""))
    group = [word() for _ in range(80)]
    for _ in range(60):
        copy = list(group)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    sets = [_sets(t) for t in texts]
    label = list(range(len(sets)))
    near = 0
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                near += 0.8 <= len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) < 0.85
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert near > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == set(label)


@pytest.fixture(scope="module")
def odd_docs(odd):
    from pyspark.sql import functions as F

    return odd.withColumn("n_chars", F.length("text").cast("int"))


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def _counted(rows):
    from collections import Counter

    return Counter(rows)


def test_each_stage_on_an_empty_table(spark, odd_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs.limit(0), SF)
        assert out.count() == 0, name
        if name != "sentencepiece":
            assert out.columns == COLUMNS


def test_toxicity_equals_a_loop(spark, odd_docs):
    from gridloom.llm import op3_toxicity as m

    docs = odd_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    model = m.fit(*m.sample(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = _rows(docs)
    score = model.score([m._words(r[1]) for r in rows])
    assert _counted(_rows(corpus_pipeline.toxicity(spark, docs, SF))) == _counted(r for r, s in zip(rows, score, strict=True) if s < model.cutoff)


def test_exact_dedup_equals_a_loop(spark, odd_docs):
    import re

    rows, best = _rows(odd_docs), {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        best[k] = min(best.get(k, (True, 0)), (r[0] is None, r[0] or 0))
    got = _rows(corpus_pipeline.exact_dedup(spark, odd_docs, SF))
    assert not _counted(got) - _counted(rows)
    assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), (r[0] is None, r[0] or 0)) for r in got) == sorted(best.items())


def test_near_dedup_on_odd_rows(spark, odd_docs):
    rows = _rows(odd_docs)
    sets = [_sets(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    want = sorted(min((r[0] is None, r[0] or 0) for r, x in zip(rows, label, strict=True) if x == g) for g in set(label))
    got = _rows(corpus_pipeline.near_dedup(spark, odd_docs, SF))
    assert sorted((r[0] is None, r[0] or 0) for r in got) == want
    assert not _counted(got) - _counted(rows)


def test_mixing_takes_each_source_to_its_target(spark, odd_docs):
    import re

    from gridloom.llm.op8_mixing import mix

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, got = _counted(_rows(odd_docs)), _counted(_rows(corpus_pipeline.mixing(spark, odd_docs, SF)))
    assert set(got) <= set(rows)
    assert all(n <= 2 * rows[r] for r, n in got.items())
    largest = max(size(r[1]) for r in rows)
    target = {r["source"]: r["target"] for r in mix(odd_docs).select("source", "target").collect()}
    for s, want in target.items():
        assert abs(sum(n * size(r[1]) for r, n in got.items() if r[3] == s) - want) <= largest
    assert got == _counted(_rows(corpus_pipeline.mixing(spark, odd_docs.repartition(5), SF)))


def test_sentencepiece_equals_the_library(spark, odd_docs):
    import hashlib
    from array import array

    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in _rows(odd_docs):
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.sentencepiece(spark, odd_docs, SF).collect()
    assert _counted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == _counted(want)
