"""Quality rules, lines first: lines that fail are taken out, then documents that lose too much go."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import WHITE, ship_package
from runloom.llm.words import windows, words

_SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in _SYMBOLS]] = True
_TAKE_SYMBOLS = str.maketrans("", "", _SYMBOLS)
_ENDS = tuple(".!?…:;\"'”’»)]。！？")
_SEPARATOR = re.compile(r"(?:^|\s)[|>»›•·→/](?=\s|$)")
_BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|copyright \d|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|uses? cookies|"
    r"sign up|log ?in|click here|read more|subscribe (?:to|now)|newsletter|share (?:this|on)|follow us|back to top|skip to content|"
    r"enable javascript|lorem ipsum|powered by|add to cart)\b|©",
    re.I,
)
_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_failed_lines long, n_lost_words long"


def line_fails(line: str, n_words: int) -> bool:
    """Punctuation, navigation and boilerplate rules of one line that has ``n_words`` words."""
    if len(line) - len(line.translate(_TAKE_SYMBOLS)) > 0.3 * n_words:
        return True
    if len(_SEPARATOR.findall(line)) >= max(2, 0.2 * n_words):
        return True
    if n_words <= 25 and _BOILERPLATE.search(line):
        return True
    return n_words < 4 and not line.rstrip(WHITE).endswith(_ENDS)


def _measure(text_name: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text_name)
            column = batch.column(at)
            n = batch.num_rows
            figures = np.zeros((7, n), np.int64)
            for first, owner, word, start, end, data, at_byte in words(column, lower=False):
                texts = len(at_byte) - 1
                rows = slice(first, first + texts)
                figures[0, rows] = np.bincount(owner, minlength=texts)
                inside = np.zeros(len(data) + 1, np.int32)
                inside[start] += 1
                inside[end] -= 1  # words of one text never touch; at the border of texts both cancel out
                counted = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
                for row, flags in ((1, counted), (2, _IS_SYMBOL[data])):
                    sums = np.concatenate([[0], np.cumsum(flags)])
                    figures[row, rows] = sums[at_byte[1:]] - sums[at_byte[:-1]]
                place, value = windows(owner, word)
                if len(place):
                    keyed = value ^ (owner[place].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    order = np.argsort(keyed, kind="stable")
                    ranked = keyed[order]
                    again = np.zeros(len(ranked), bool)
                    same = ranked[1:] == ranked[:-1]
                    again[1:] |= same
                    again[:-1] |= same
                    covered = np.zeros(len(owner), bool)
                    hit = place[order[again]]
                    for k in range(3):
                        covered[hit + k] = True
                    figures[4, rows] = np.bincount(owner[covered], minlength=texts)
            for i, text in enumerate(column.to_pylist()):
                if not text:
                    continue
                lines = [(line, k) for line in text.split("\n") if (k := len(line.encode().split()))]
                figures[3, i] = len(lines) - len({line for line, _ in lines})
                lost = [k for line, k in lines if line_fails(line, k)]
                figures[5, i], figures[6, i] = len(lost), sum(lost)
            columns = [batch.column(j) for j in range(batch.num_columns) if j != at]
            names = [m for j, m in enumerate(batch.schema.names) if j != at]
            made = [c.split()[0] for c in _COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, figures)], [*names, *made])

    return run


def quality_verdicts(
    docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50
) -> DataFrame:
    """Per document: doc_id, the base figures, n_failed_lines, n_lost_words, base_failed and kept.

    A document fails the base if it has under ``min_words`` words or if over ``max_repeat_percent`` % of its words lie in 3-word
    windows that it holds twice. Otherwise it is kept unless lines that fail hold over ``max_lost_percent`` % of its words.

    * null or empty text: all figures 0, base_failed true, kept false; * lines without a word count nowhere; * rows are
    independent: repeated rows and null ids give a row each; * extra columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(_measure("text"), f"doc_id long, {_COLUMNS}")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_lost_words") <= max_lost_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)
