"""Periodic runs of words by seed and extend: k-grams of guaranteed overlap seed diagonals, a table by lag stops repeated work."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runloom.llm.common import ship_package

#: Words of texts that are searched at once; a longer text is a piece of its own.
PIECE_WORDS = 1 << 16
_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number for each pair, the same for equal pairs."""
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _repeated(name: np.ndarray) -> np.ndarray:
    return np.bincount(name)[name] > 1


def _ahead(places: np.ndarray, name: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the places that have another ``by`` words on: which they are, and the other's name."""
    at = np.searchsorted(places, places + by)
    found = np.flatnonzero(at < len(places))
    found = found[places[at[found]] == places[found] + by]
    return found, name[at[found]]


def _index(words: np.ndarray, smallest: int):
    """k-grams that occur more than once, for k = smallest, 3 x smallest, ...: (k, places in order, their names).

    Names are ranks, not hashes: equal names are equal k-grams. A k-gram can only be repeated if its thirds are.
    """
    places, name, k = np.arange(len(words)), words, 1
    while k < smallest:
        step = min(k, smallest - k)
        found, other = _ahead(places, name, step)
        if not len(found):
            return
        places, name, k = places[found], _named(name[found], other), k + step
        keep = _repeated(name)
        places, name = places[keep], name[keep]
    while len(places):
        yield k, places, name
        found, second = _ahead(places, name, k)
        if not len(found):
            return
        start, pair = places[found], _named(name[found], second)
        at = np.searchsorted(places, start + 2 * k)
        fine = at < len(places)
        fine[fine] = places[at[fine]] == start[fine] + 2 * k
        if not fine.any():
            return
        places, name, k = start[fine], _named(pair[fine], name[at[fine]]), 3 * k
        keep = _repeated(name)
        places, name = places[keep], name[keep]


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, or back from it, equal those ``lag`` words further on; looked at in growing stretches."""
    done, size = 0, 32
    while True:
        if step > 0:
            a, b = at + done, min(at + done + size, len(words) - lag)
        else:
            a, b = max(at - done - size + 1, 0), at - done + 1
        if a >= b:
            return done
        other = np.flatnonzero(words[a:b] != words[a + lag : b + lag])
        if len(other):
            return done + int(other[0] if step > 0 else b - a - 1 - other[-1])
        done, size = done + b - a, 2 * size


def periodic_runs(words: np.ndarray, repeats: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches of at least ``max(shortest, repeats * period)`` words with that smallest period.

    ``words`` are numbers, those of different texts different. A run of period q has at least max(shortest - q, (repeats - 1) q)
    words that equal the word q further on, so a k-gram of at most that length recurs in it q words on; if k is q or more, not
    sooner, by Fine and Wilf. k grows threefold, so every period has such a k, and only each occurrence with the next one of the
    same k-gram is a seed: as many as words, however often a k-gram occurs.
    """
    if repeats < 4:
        raise ValueError("k-grams that grow threefold need four repeats")
    smallest = max(1, min(max(shortest - q, (repeats - 1) * q) for q in range(1, shortest + 1)))
    found, covered, before = [], {}, 0
    for k, places, name in _index(words, smallest):
        order = np.argsort(name, kind="stable")
        seed, other, same = places[order][:-1], places[order][1:], name[order][1:] == name[order][:-1]
        lag = other - seed
        fine = same & (lag > before) & (lag <= k)
        for i, q in sorted(zip(seed[fine].tolist(), lag[fine].tolist())):
            if i < covered.get(q, 0):
                continue  # on a diagonal that has been followed beyond this place
            right = i + _reach(words, i, q, 1)
            start = i - _reach(words, i - 1, q, -1)
            covered[q] = right
            length = right + q - start
            if length >= max(shortest, repeats * q):
                found.append((start, length, q))
        before = k
    return sorted(found, key=lambda run: (run[0], run[2]))


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    edge = np.zeros(len(words) + 1, np.int64)
    best = None
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
        rank = (-Fraction(length, period), start, period)
        if best is None or rank < best[0]:
            best = (rank, (start, length, period, 1000 * length // period))
    gone = np.cumsum(edge[:-1]) > 0
    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if runs else b" ".join(words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (len(runs), *(best[1] if best else (None,) * 4), hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), kept.decode(), runs)


def _found(repeats: int, shortest: int, text: bool):
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def piece(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers, starts, total = [], [0], 0
        for words in texts:
            known: dict[bytes, int] = {}
            numbers += [known.setdefault(w, len(known) + total) for w in words]
            total += len(known)
            starts.append(len(numbers))
        runs: list[list] = [[] for _ in texts]
        every = periodic_runs(np.array(numbers, np.int64), repeats, shortest) if numbers else []
        owner = np.searchsorted(starts, [r[0] for r in every], "right") - 1
        for (start, length, period), o in zip(every, owner.tolist()):
            runs[o].append((start - starts[o], length, period))
        rows = [_digest(w, r) for w, r in zip(texts, runs)]
        columns = list(zip(*rows))
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))]
        out = ["doc_id", *names]
        if text:
            listed = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in columns[8]]
            arrays += [pa.array(columns[7], pa.string()), pa.array(listed, run_type)]
            out += ["text", "runs"]
        return pa.RecordBatch.from_arrays(arrays, out)

    def run(batches):
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                # bytes.split() cuts at space, tab, line feed, vertical tab, form feed and carriage return, as words are defined
                words = raw.as_py().encode().split() if raw.is_valid else []
                if held and held + len(words) > PIECE_WORDS:
                    yield piece(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(words)
                held += len(words)
            if ids:
                yield piece(ids, texts)

    return run


def collapse_runs(docs: DataFrame, repeats: int = 4, shortest: int = 6, text: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256); with ``text``, also (text, runs).

    A run is a stretch of words with smallest period q and at least ``max(shortest, repeats * q)`` words that no neighbouring word
    extends keeping that period. Of the runs, the one with the greatest length / period is given (ties: smallest start, then
    period) and the hash of all; the collapsed text has the first q words of each run, without what any run holds beyond.

    Each text is searched whole where it lies, without a shuffle: the words of a batch's texts get numbers that no two texts share,
    k-grams are indexed for all of them at once, seeds lie on diagonals of one lag, and a table by lag of the furthest place
    followed keeps each diagonal stretch from being followed twice. Work and memory go with a batch's words times the
    number of k (one for each threefold length), a word that fills a text included.

    * null or empty text, no words: no runs, four nulls, hashes of the empty string; * repeated rows: each row its result;
    * null doc_id: as any other; * a text of any length is one piece; * extra columns are ignored; * an empty table gives no row.
    """
    ship_package(docs.sparkSession)
    extra = ", text string, runs array<struct<start long, length long, period long>>" if text else ""
    return docs.select("doc_id", "text").mapInArrow(_found(repeats, shortest, text), f"doc_id long, {_COLUMNS}{extra}")
