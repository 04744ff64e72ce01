"""The chained stages of corpus_pipeline against brute force over a small corpus."""

import random
import re
from itertools import combinations

import corpus_pipeline
from veilwork.llm import packing


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def corpus():
    """Unrelated texts, toxic ones, a repeated passage, near and exact copies, addresses, a long text and odd rows."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(2_000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, near, texts = some(70), some(150), []
    for i in range(150):
        body = some(rng.randint(30, 200))
        if i % 3 == 0:
            for bad in ("vile", "scum", "trash"):
                body.insert(rng.randrange(len(body)), bad)
        if i % 7 == 1:
            body[10:10] = passage
        if i % 5 == 2:
            body.append(f"jo{i}@example.com")
        texts.append(" ".join(body))
    for k in range(4):
        copy = list(near)
        for _ in range(3 * k):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[151], texts[1], " ".join(some(5_000)), "", None, "two words"]
    return list(enumerate(texts)) + [(None, texts[4])]


def expected(rows):
    """Bins of (doc_id, start, length), each stage over all that the one before kept."""
    docs = {i: words(t) for i, t in rows if i is not None and t is not None and "vile" not in words(t)}
    grams = {i: set(zip(w, w[1:], w[2:])) or {tuple(w)} for i, w in docs.items() if w}
    group = {i: i for i in docs}
    for i, j in combinations(sorted(grams), 2):
        if len(grams[i] & grams[j]) >= 0.6 * len(grams[i] | grams[j]):
            x, y = sorted((group[i], group[j]))
            group = {k: x if v == y else v for k, v in group.items()}
    kept = {i: w for i, w in docs.items() if group[i] == i}
    seen, copies = set(), set()
    for i, w in sorted(kept.items()):
        for a in range(len(w) - 49):
            if tuple(w[a : a + 50]) in seen:
                copies |= {(i, x) for x in range(a, a + 50)}
            seen.add(tuple(w[a : a + 50]))
    assert len(kept) < len(docs) < len(rows) and copies
    texts = dict(r for r in rows if r[0] is not None)
    bins, done, clock = [], [], 0
    for i, w in sorted(kept.items()):
        size = len(w) - sum(d == i for d, _ in copies) - 2 * texts[i].count("@")  # three words of an address become one
        for start in range(0, size, packing.CAPACITY):
            piece, clock = (i, start, min(packing.CAPACITY, size - start)), clock + 1
            fits = [b for b in bins if b[0] >= piece[2]]
            b = min(fits, key=lambda b: (b[0], -b[1])) if fits else [packing.CAPACITY, 0, []]
            bins = [x for x in bins if x is not b]
            b = [b[0] - piece[2], clock, [*b[2], piece]]
            (bins if b[0] else done).append(b)
            assert len(bins) <= packing.OPEN_BINS
    return sorted(b[2] for b in done + bins)


def test_run_is_all_stages_over_all_documents(spark, tmp_path):
    rows = corpus()
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("vile" in t)) for i, t in rows if i is not None and t]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(list(zip(r.doc_ids, r.starts, r.lengths)) for r in got) == expected(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "pii", "best_fit_packing"]


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    rows = [(1, None, "a", 1, True), (2, "", "b", 2, True), (None, "one two three", "c", 3, True), (4, "word " * 30_000, "d", 4, False), (4, "word " * 30_000, "d", 4, False), (6, "4111 1111 1111 1111", "e", 5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts_ string, part int, gone_id_ boolean")
    spark.createDataFrame([(1, 0), (9, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = stage(spark, docs, str(tmp_path)), stage(spark, none, str(tmp_path))
        assert docs.columns == none.columns == ["doc_id", "text", "cuts_", "part", "gone_id_"] and none.count() == 0
    got = sorted(docs.collect(), key=str)
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 4, 4, 6]
    assert {r.doc_id: r.text for r in got if r.doc_id != 4} == {1: None, 2: "", None: "one two three", 6: "[CREDIT_CARD]"}
    assert all(0 < len(r.text.split()) < 60 for r in got if r.doc_id == 4)
    assert sum(r.n_words for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) > 0
