"""Toxicity by a counterfactually regularised linear classifier."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.exchange import dropped, exchange, pack, packed_rows, partitions, spread, unpack, written
from veilwork.llm.tokens import U64, Words, chunks, mix, split_words, text_buffer, word_prefixes

#: Most labelled documents that the classifier is fitted on, chosen by hash of doc_id.
MAX_LABELLED = 12_000
#: Word beginnings, in bytes, that are features beside whole words: inflected and unseen forms share them.
PREFIXES = (4, 5, 6)
MIN_DOCUMENTS = 5
#: Most features of the model: those that divide the classes best.
MAX_FEATURES = 8192
HELD_OUT = 5

#: Terms that name groups of people, by language; swapping one for another of its list must not change a score.
IDENTITY_TERMS = (
    tuple("muslim muslims christian christians jewish jews hindu hindus buddhist atheist catholic protestant sikh".split()),
    tuple("black white asian african american european latino hispanic arab indian mexican chinese native immigrant refugee".split()),
    tuple("gay lesbian bisexual transgender trans queer straight heterosexual homosexual".split()),
    tuple("woman women man men female male girl girls boy boys mother father".split()),
    tuple("disabled blind deaf autistic elderly old young teenage".split()),
    tuple("muslime christen juden frauen männer schwarze weiße schwule lesben ausländer flüchtlinge behinderte".split()),
    tuple("musulmans chrétiens juifs femmes hommes noirs blancs gays lesbiennes immigrés réfugiés handicapés".split()),
    tuple("musulmanes cristianos judíos mujeres hombres negros blancos gais lesbianas inmigrantes refugiados discapacitados".split()),
)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Feature hashes of all words of the texts, one row for each feature kind, and the document of each word."""
    words = split_words(texts)
    data, at = text_buffer(texts)
    kinds = [words.hashes]
    for n in PREFIXES:
        kinds.append(mix(word_prefixes(data, at, words, n) + U64(n)))
    return np.stack(kinds), words.doc, words


def _term(term: str) -> np.ndarray:
    found, _, _ = features(pa.array([term]))
    return np.unique(found)


@dataclass
class Model:
    """Weights of features (sorted hashes), bias and the probability from which a document is toxic."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text; a feature counts once however often it is there."""
        n = len(texts)
        total = np.full(n, self.bias)
        if len(self.keys):
            bits = np.zeros(1 << 16, bool)
            bits[(self.keys >> U64(48)).astype(np.int64)] = True
            found, doc, _ = features(texts)
            for kind in found:
                hit = np.flatnonzero(bits[(kind >> U64(48)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, kind[hit]), len(self.keys) - 1)
                good = self.keys[at] == kind[hit]
                own = np.unique(doc[hit[good]] * len(self.keys) + at[good])
                np.add.at(total, own // len(self.keys), self.weights[own % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


@dataclass
class Labelled:
    """Labelled documents by the features that are kept.

    keys (sorted features), row and column (of each feature of each document), toxic and held by document; terms: the places
    in keys of what identity terms have, and swaps: the mean of d d^T over all swaps, where d is the change of these.
    """

    keys: np.ndarray
    row: np.ndarray
    column: np.ndarray
    toxic: np.ndarray
    held: np.ndarray
    terms: np.ndarray
    swaps: np.ndarray


TERMS = {t: k for k, group in enumerate(IDENTITY_TERMS) for t in group}


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled documents, one row for each doc_id: its least text.

    A label that contradicts another of its document, a null one, and documents without text are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").cast("int").alias("toxic"))


def swap_changes(words: Words, found: np.ndarray, a: int, b: int, names: np.ndarray, own: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features that go, features that come) for each swap in the text of words a to b: all places of one identity term
    that is there get another of its list. names: the term of each word or ""; own: each term's features.

    A feature that another word has too doesn't go, and one that is there already doesn't come.
    """
    here = names[a:b]
    for s in dict.fromkeys(here[here != ""].tolist()):
        rest = np.unique(found[:, a:b][:, here != s])
        goes = np.setdiff1d(own[s], rest)
        for t in IDENTITY_TERMS[TERMS[s]]:
            if t != s:
                yield np.setdiff1d(goes, own[t]), np.setdiff1d(np.setdiff1d(own[t], rest), own[s])


def labelled_features(docs: DataFrame, labels: DataFrame, most: int) -> Labelled:
    """What the classifier is fitted on.

    The labelled texts are written once; features are counted where they are, and the MAX_FEATURES that divide the classes
    best are chosen from sums by feature. The driver gets those, for each document the numbers of its features, and how
    often each change by a swap is there: a few MB, whatever the texts' length. Empty tables give no documents; columns other
    than doc_id, text and toxic are ignored.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    chosen = written(sample(docs, labels, most), "labelled")
    known = chosen.select("doc_id", "toxic").toArrow().sort_by("doc_id")
    ids, toxic = known["doc_id"].to_numpy(), known["toxic"].to_numpy().astype(float)
    n = len(ids)
    held = np.arange(n) % HELD_OUT == HELD_OUT - 1
    if not 0 < toxic[~held].sum() < (~held).sum() or not 0 < toxic[held].sum() < held.sum():
        held[:] = False
    if not n or toxic.min() == toxic.max():
        none = np.zeros(0, np.int64)
        dropped(chosen)
        return Labelled(none.view(U64), none, none, toxic, held, none, np.zeros((0, 0)))
    kept_out, share = ids[held], float(toxic[~held].mean())
    least = min(MIN_DOCUMENTS, max(1, int((~held).sum()) // 20))
    own = {t: _term(t) for t in TERMS}
    identity = np.unique(np.concatenate(list(own.values())))

    def best(keys: np.ndarray, df: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features that divide the classes best, in order, and how well they do."""
        z = np.where(df >= least, np.abs(pos - df * share) / np.sqrt(df * share * (1 - share)), 0)
        z[np.isin(keys, identity)] += 1e6
        use = np.sort(np.argsort(-z, kind="stable")[: min(MAX_FEATURES, int((z > 0).sum()))])
        return keys[use], z[use]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found, _, words = features(batch.column("text"))
            train_ = ~np.isin(batch.column("doc_id").to_numpy(), kept_out)
            bad = batch.column("toxic").to_numpy() > 0
            each = [np.unique(found[:, a:b]) if ok else found[0, :0] for a, b, ok in zip(words.first[:-1], words.first[1:], train_)]
            if not sum(map(len, each)):
                continue
            keys, place, df = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            pos = np.bincount(place, weights=np.repeat(bad, [len(x) for x in each]), minlength=len(keys)).astype(np.int32)
            order, edges = spread(keys, parts)
            keys, df, pos = keys[order], df[order].astype(np.int32), pos[order]
            yield packed_rows((p, pack(keys[a:b], df[a:b], pos[a:b])) for p in range(parts) for a, b in [(edges[p], edges[p + 1])] if b > a)

    def receive(payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        pieces = [unpack(p) for p in payloads]
        if pieces:
            keys, place = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
            df, pos = (np.bincount(place, weights=np.concatenate([p[i] for p in pieces]), minlength=len(keys)) for i in (1, 2))
            keys, z = best(keys, df, pos)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(z)], ["key", "z"])

    ranked = exchange(chosen, send, receive, "key long, z double", parts).toArrow()
    keys, z = ranked["key"].to_numpy().view(U64), ranked["z"].to_numpy()
    order = np.argsort(keys)
    keys, z = keys[order], z[order]
    keys = keys[np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sorted(TERMS)
        hashes = np.array([split_words(pa.array([t])).hashes[0] for t in listed])
        by = np.argsort(hashes)
        changes: dict[bytes, int] = {}
        where = lambda x: np.searchsorted(keys, x[np.isin(x, keys)])
        for batch in chunks(batches):
            found, _, words = features(batch.column("text"))
            at = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
            hit = keys[at] == found if len(keys) else np.zeros(found.shape, bool)
            term = by[np.minimum(np.searchsorted(hashes[by], words.hashes), len(by) - 1)]
            names = np.where(hashes[term] == words.hashes, np.array(listed)[term], "")
            train_ = ~np.isin(batch.column("doc_id").to_numpy(), kept_out)
            values = []
            for a, b, ok in zip(words.first[:-1].tolist(), words.first[1:].tolist(), train_):
                values.append(np.unique(at[:, a:b][hit[:, a:b]]).astype(np.int32).tobytes())
                if ok and (names[a:b] != "").any():
                    for goes, comes in swap_changes(words, found, a, b, names, own):
                        name = pack(where(goes), where(comes))
                        changes[name] = changes.get(name, 0) + 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary()), pa.nulls(len(values), pa.int64())], ["doc_id", "value", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(changes), pa.int64()), pa.array(list(changes), pa.binary()), pa.array(list(changes.values()), pa.int64())], ["doc_id", "value", "n"])

    placed = written(chosen.mapInArrow(place, "doc_id long, value binary, n long"), "placed")
    dropped(chosen)
    found = placed.where("doc_id IS NOT NULL").select("doc_id", "value").toArrow().sort_by("doc_id")
    columns = [np.frombuffer(v.as_py(), np.int32) for v in found["value"]]
    row, column = np.repeat(np.arange(n), [len(c) for c in columns]), np.concatenate(columns)
    terms = np.flatnonzero(np.isin(keys, identity))
    changed = [(unpack(r["value"]), r["n"]) for r in placed.where("n IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n")).collect()]
    dropped(placed)
    where = lambda x: np.searchsorted(keys, x[np.isin(x, keys)])
    for group in IDENTITY_TERMS:  # each pair once more, as if each term stood alone, so that unseen ones are held together too
        changed += [((where(np.setdiff1d(own[s], own[t])), where(np.setdiff1d(own[t], own[s]))), 1) for s, t in combinations(group, 2)]
    swaps, total = np.zeros((len(terms), len(terms))), 0
    for (goes, comes), times in changed:
        at = np.searchsorted(terms, np.append(goes, comes))
        d = np.append(-np.ones(len(goes)), np.ones(len(comes)))
        swaps[np.ix_(at, at)] += times * np.outer(d, d)
        total += times
    return Labelled(keys, row, column, toxic, held, terms, swaps / max(total, 1))


def fit(data: Labelled, fairness: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, steps: int = 400) -> Model:
    """Logistic regression with weights kept sparse.

    In each labelled sentence each identity term that is there is swapped for each other of its list; the loss adds
    `fairness` times the mean square of the score's changes, over all these swaps. Each HELD_OUT-th document sets the
    threshold: the middle of the best F1's range. Without documents of both kinds no text, or each, is toxic.
    """
    toxic, held = data.toxic, data.held
    n = len(toxic)
    if not n or toxic.min() == toxic.max():
        return Model(np.zeros(0, U64), np.zeros(0), -10.0 if not n or not toxic.max() else 10.0, 0.5)
    keys, terms, swaps = data.keys, data.terms, data.swaps
    number = np.cumsum(~held) - 1
    mine = ~held[data.row]
    row, column = number[data.row[mine]], data.column[mine]
    y = toxic[~held]
    share = y.mean()
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    norms = np.bincount(row, minlength=len(y))
    steep = float(np.linalg.eigvalsh(swaps)[-1]) if len(terms) else 0.0
    step = 1.0 / (0.25 * float((balance * norms).sum()) + l2 + 2 * fairness * steep)
    w, v, bias, bias_v, t = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=v[column], minlength=len(y)) + bias_v, -50, 50)))
        slope = balance * (p - y)
        grad = np.bincount(column, weights=slope[row], minlength=len(keys)) + l2 * v
        if len(terms):
            grad[terms] += 2 * fairness * swaps @ v[terms]
        moved = v - step * grad
        fresh, fresh_bias = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), bias_v - step * slope.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = fresh + (t - 1) / t2 * (fresh - w), fresh_bias + (t - 1) / t2 * (fresh_bias - bias)
        w, bias, t = fresh, fresh_bias, t2
    used = w != 0
    model = Model(keys[used], w[used], float(bias), 0.5)
    test = np.flatnonzero(held) if held.any() else np.arange(n)
    total = np.bincount(data.row, weights=w[data.column], minlength=n)[test] + bias
    p = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(toxic[test][order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + toxic[test].sum())
    f1[:-1][np.diff(p[order]) == 0] = -1
    k = int(np.argmax(f1))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    model.threshold = float((p[order][k] + below) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """The classifier of docs by labels (doc_id, toxic). Null and contradicting labels, null texts and rows without doc_id
    don't count, repeated rows count once, and empty tables give a model that finds nothing toxic."""
    return fit(labelled_features(docs, labels, most))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, toxic) of every row: the probability, and whether it reaches the model's threshold.

    Null and empty texts are scored by the bias alone and are never toxic. Rows without doc_id and repeated rows are scored
    like others. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            p = sent.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(_toxic(sent.value, batch.column("text"), p))], ["doc_id", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, toxic boolean")


def _toxic(model: Model, texts: pa.Array, p: np.ndarray) -> np.ndarray:
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    return (p >= model.threshold) & some


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model finds toxic; other rows and all columns stay as they are.

    Null and empty texts, and rows without doc_id that aren't toxic, stay; repeated rows stay or go together; a text of any
    length is scored whole. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text")
            clean = ~_toxic(sent.value, texts, sent.value.score(texts))
            yield batch if clean.all() else batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
