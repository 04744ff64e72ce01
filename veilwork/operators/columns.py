"""Columns of what veilwork.operators.plain makes of texts, worked out in Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Tuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as C

from veilwork.config import MaskConfig
from veilwork.operators import plain
from veilwork.operators.scan import SPANS

_SPAN = (("start", pa.int32()), ("end", pa.int32()), ("seq", pa.int32()), ("entity", pa.string()), ("score", pa.float64()), ("recognizer", pa.string()), ("pattern", pa.string()), ("boost", pa.float64()), ("word", pa.string()))
_ENTITY = (*_SPAN, ("value", pa.string()), ("token", pa.string()))
_BRIEF = (_SPAN[0], _SPAN[1], _SPAN[3], _SPAN[6])
_ENTITIES = SPANS[:-2] + ",value:string,token:string>>"
_SIDE = "struct<start:int,end:int,entity:string,pattern:string>"
DECISIONS = f"array<struct<winner:{_SIDE},loser:{_SIDE},reason:string>>"
WINNERS = "array<struct<start:int,end:int,entity:string>>"
_PAIR = (("entity", pa.string()), ("token", pa.string()), ("value", pa.string()))
PAIRS = "array<struct<entity:string,token:string,value:string>>"
#: What masking makes of a text.
KINDS = {"normalized_text": "string", "entities": _ENTITIES, "conflict_log": DECISIONS, "masked_text": "string", "n_entities": "int", "n_conflicts": "int", "winners": WINNERS, "new_pairs": PAIRS}


def _structs(rows: list[tuple], fields: tuple) -> pa.StructArray:
    columns = zip(*rows) if rows else ((),) * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _lists(lists: list[list], make: Callable[[list], pa.Array]) -> pa.ListArray:
    offsets, n = [0], 0
    for one in lists:
        n += len(one)
        offsets.append(n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), make([x for one in lists for x in one]))


def spans_array(lists: list[list[tuple]]) -> pa.ListArray:
    return _lists(lists, lambda rows: _structs(rows, _SPAN))


def _entities_array(lists: list[list[tuple]]) -> pa.ListArray:
    return _lists(lists, lambda rows: _structs(rows, _ENTITY))


def decisions_array(lists: list[list[tuple]]) -> pa.ListArray:
    def make(rows: list[tuple]) -> pa.StructArray:
        sides = [_structs([(s[0], s[1], s[3], s[6]) for s in (r[k] for r in rows)], _BRIEF) for k in (0, 1)]
        return pa.StructArray.from_arrays([*sides, pa.array([r[2] for r in rows], pa.string())], ["winner", "loser", "reason"])

    return _lists(lists, make)


def winners_array(logs: list[list[tuple]]) -> pa.ListArray:
    """The places and types of a log's winners, each once."""
    return _lists([list(dict.fromkeys((w[0], w[1], w[3]) for w, *_ in log)) for log in logs], lambda rows: _structs(rows, (_SPAN[0], _SPAN[1], _SPAN[3])))


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles: a batch makes a hundred thousand tuples and no cycle, and it would go through all of them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _column(function: Callable, kind: str, *inputs: Column) -> Column:
    # what isn't deterministic is never worked out twice, as a filter's condition and for the rows that it leaves
    return C.arrow_udf(function, kind).asNondeterministic()(*inputs)


def _valid(text: Column) -> Column:
    """Text that Arrow can take: bytes that aren't UTF-8 become U+FFFD."""
    return C.make_valid_utf8(text)


def normal_text(text: Column, config: MaskConfig, blanks: bool = False) -> Column:
    """The text as it is scanned; with blanks, texts of white space alone are normalised too."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        normal = (lambda t: plain.normalized(t, config.nfc)) if blanks else plain.masker(config).normal
        for texts in batches:
            yield pa.array([normal(t) if t is not None else None for t in texts.to_pylist()], pa.string())

    return _column(run, "string", _valid(text))


def made(kind: str, make: Callable, text: Column, config: MaskConfig, array: Callable, *others: Column) -> Column:
    """make(masker, text as it is scanned, *others) of each text that isn't null, as an array by `array`."""

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = plain.masker(config)
        for columns in batches:
            texts, *rest = (c.to_pylist() for c in columns)
            done = [make(m, t if m.lean else plain.normalized(t, config.nfc), *more) if t is not None else [] for t, *more in zip(texts, *rest)]
            yield array(done)

    # a second input, so that batches come as tuples
    return _column(run, kind, _valid(text), *(others or (C.lit(0),)))


def results(config: MaskConfig, wanted: tuple[str, ...], text: Column, normal: bool = False, diarized: Column | None = None, ner: Column | None = None, llm: Column | None = None, session: Column | None = None) -> Column:
    """struct of what is wanted (of KINDS). normal: the text is normalised already. session: rows come with those of a session
    together and in order, and tokens are numbered through each; else each text has its own numbers."""
    given = {"diarized": diarized, "ner": ner, "llm": llm, "session": session}
    names, every, whole = [n for n, c in given.items() if c is not None], tuple(given), session is not None
    reasons, decisions, texts_too = "conflict_log" in wanted, bool({"conflict_log", "winners"} & set(wanted)), "masked_text" in wanted
    pairs_too, pairs_alone = "new_pairs" in wanted, set(wanted) <= {"new_pairs", "normalized_text"}

    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = plain.masker(config)
        at, seen = object(), {}
        for columns in batches:
            with _uncollected():
                texts, *rest = (c.to_pylist() for c in columns)
                inputs = dict(zip(names, rest))
                none = [None] * len(texts)
                normals, every_entities, logs, masked, numbers, pairs = [], [], [], [], [], []
                for t, diarized_, ner_, llm_, of in zip(texts, *(inputs.get(n, none) for n in every)):
                    if t is None:
                        entities, log, n = [], [], 0
                    else:
                        t = t if normal else m.normal(t)
                        if decisions:
                            entities, log = m.decided(t, bool(diarized_), ner_, llm_, reasons)
                            n = len(log)
                        elif pairs_alone:
                            entities, n = m.kept_numbered(t, bool(diarized_), ner_, llm_), 0
                        else:
                            entities, n = m.kept(t, bool(diarized_), ner_, llm_)
                    if whole and of != at:
                        at, seen = of, {}
                    if entities and m.numbered:
                        numbers_of = seen if whole else {}
                        if pairs_too:
                            pairs.append(m.new_pairs(entities, numbers_of))
                        if not pairs_alone:
                            entities = m.with_numbers(entities, numbers_of)
                    elif pairs_too:
                        pairs.append([])
                    normals.append(t)
                    every_entities.append(entities)
                    numbers.append(n)
                    if decisions:
                        logs.append(log)
                    if texts_too:
                        masked.append(plain.replaced(t, entities) if entities else t)
                made = {
                    "normalized_text": lambda: pa.array(normals, pa.string()),
                    "entities": lambda: _entities_array(every_entities),
                    "conflict_log": lambda: decisions_array(logs),
                    "winners": lambda: winners_array(logs),
                    "masked_text": lambda: pa.array(masked, pa.string()),
                    "n_entities": lambda: pa.array(map(len, every_entities), pa.int32()),
                    "n_conflicts": lambda: pa.array(numbers, pa.int32()),
                    "new_pairs": lambda: _lists(pairs, lambda rows: _structs(rows, _PAIR)),
                }
                done = pa.StructArray.from_arrays([made[n]() for n in wanted], list(wanted))
            yield done

    kind = f"struct<{','.join(f'{n}:{KINDS[n]}' for n in wanted)}>"
    inputs = [given[n] for n in names]
    return _column(run, kind, _valid(text), *(inputs or [C.lit(0)]))
