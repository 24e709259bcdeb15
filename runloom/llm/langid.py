"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import ship_package, stored

UNKNOWN = "und"
#: Words are runs of letters, in Spark as in Python.
_WORD = r"\p{L}+"
_LETTERS = regex.compile(_WORD)
#: Words whose scores a Python worker remembers.
_REMEMBER = 80_000


def held_out_fold(doc_id, folds: int = 5):
    """True for the documents that no model learns from: crc32 of the id as text divides by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class Model:
    """Log frequencies by language: by length (0: whole words) the keys and a matrix with a row for each. It goes to every worker."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[pa.Array, np.ndarray]]):
        self.languages, self.tables = languages, tables
        self.rows: dict[str, int] = {}
        self.matrix = np.zeros((0, len(languages)))
        self.places: dict[int, dict[str, int]] | None = None

    def __getstate__(self):
        return self.languages, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, words: list[str]) -> np.ndarray:
        """The evidence of each word: its own if it is known, else the mean of its longest n-grams of which any is known."""
        if self.places is None:
            self.places = {n: dict(zip(keys.to_pylist(), range(len(keys)))) for n, (keys, _) in self.tables.items()}
        out = np.zeros((len(words), len(self.languages)))
        rest = list(range(len(words)))
        for n in sorted(self.places, key=lambda n: -n if n else -np.inf):
            place, found, counts, hit, missed = self.places[n], [], [], [], []
            for i in rest:
                marked = f" {words[i]} "
                tried = [marked[j : j + n] for j in range(len(marked) - n + 1)] if n else [words[i]]
                own = [p for key in tried if (p := place.get(key)) is not None]
                if own:
                    found += own
                    counts.append(len(own))
                    hit.append(i)
                else:
                    missed.append(i)
            if hit:
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                weights = self.tables[n][1][found].astype(np.float64)
                out[hit] = np.add.reduceat(weights, starts) / np.array(counts)[:, None]
            rest = missed
        return out - out.max(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        spoken = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.rows) > _REMEMBER:
            self.rows, self.matrix = {}, self.matrix[:0]
        rows = self.rows
        new = list({w for words in spoken for w in words if w not in rows})
        if new:
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.matrix = np.concatenate([self.matrix, self.scores(new)])
        return [self._choice([rows[w] for w in words]) if words else (UNKNOWN, 0.0) for words in spoken]

    def _choice(self, rows: list[int]) -> tuple[str, float]:
        total = self.matrix[rows].sum(axis=0)
        # the evidence of a hundred words at most, in the mean, so that scores of long texts stay graded
        odds = np.exp((total - total.max()) * min(1.0, 100 / len(rows)))
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _in_turn(model: Model, texts: list[str | None], size: int = 1 << 19) -> list[tuple[str, float]]:
    """Predictions of texts, about ``size`` characters at a time."""
    out, run, held = [], [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held > size:
            out += model.predict(run)
            run, held = [], 0
    return out + model.predict(run)


def _log_table(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Keys with their log frequencies by language, with half a count added."""
    counts = rows.column("counts").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(np.float64)
    totals = counts.sum(axis=0) + 0.5 * len(counts)
    return rows.column("key").combine_chunks(), np.log((counts + 0.5) / totals).astype(np.float32)


def _gram(text: Column, n: int):
    """The ``n`` characters of ``text`` from a place on; of one argument, since a second one would be given the index."""
    return lambda place: F.substring(text, place, F.lit(n))


def learn(labelled: DataFrame, sample: int = 3000, longest: int = 4) -> Model:
    """Learn from (doc_id, text, lang): counts by Spark, a row for each key on the driver.

    The documented bound: of each language a repeatable draw of about ``sample`` documents (all, if it has fewer). All words of
    the draw and all n-grams of up to ``longest`` characters are kept, however rare.
    """
    usable = labelled.where("lang is not null and text is not null")
    cut = usable.groupBy("lang").count().select(F.col("lang").alias("l"), (F.lit(float(sample)) / F.col("count")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.join(stored(cut, "language-shares"), F.col("lang") == F.col("l")).where(draw < F.col("share"))
    spoken = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), 0)).alias("key"))
    counted = stored(spoken.groupBy("lang", "key").count(), "language-words")
    marked = F.concat(F.lit(" "), "key", F.lit(" "))
    tables = [counted.select("lang", F.lit(0).alias("size"), "key", "count")]
    for n in range(1, longest + 1):
        starts = F.sequence(F.lit(1), F.length(marked) - n + 1)
        grams = counted.where(F.length(marked) >= n).select(
            "lang", F.explode(F.transform(starts, _gram(marked, n))).alias("key"), "count"
        )
        tables.append(grams.where(F.trim("key") != "").groupBy("lang", "key").agg(F.sum("count").alias("count")).select("lang", F.lit(n).alias("size"), "key", "count"))
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    by_language = [F.coalesce(F.sum(F.when(F.col("lang") == name, F.col("count"))), F.lit(0)) for name in languages]
    if not languages:
        return Model([], {})
    rows = every.groupBy("size", "key").agg(F.array(*by_language).alias("counts")).toArrow()
    sizes = rows.column("size").to_numpy()
    return Model(languages, {int(n): _log_table(rows.filter(pa.array(sizes == n))) for n in np.unique(sizes)})


def _predictions(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            found = _in_turn(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("twin"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "twin", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, twin, lang_pred, score) of every whole text; ``twin`` is the hash of the text.

    * null text, or none of letters: ``und`` with score 0; * letters that the model has never seen weigh alike for all
    languages, and the first in code-point order is given; * rows are independent; * no other column is read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.xxhash64("text").alias("twin"), "text")
    return rows.mapInArrow(_predictions(shared), "doc_id long, twin long, lang_pred string, score double")


def _accepted(shared, least: float):
    def run(batches):
        model = shared.value
        for batch in batches:
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score in _in_turn(model, batch.column("text").to_pylist())], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with a score of ``least`` or more."""
    spark = docs.sparkSession
    ship_package(spark)
    return docs.mapInArrow(_accepted(spark.sparkContext.broadcast(model), least), docs.schema)
