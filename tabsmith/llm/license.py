"""License scans (operator 8): TF-IDF cosine to notice templates, then inheritance from directories.

1. A record's text is cut at tags, line ends and sentence ends; each piece is a candidate. Its vector has tf * idf for each word; idf counts the records of the whole table that hold
   the word, for the words of the templates; any other word weighs as one that no record holds. The best cosine
   to a template over all candidates decides; from ``THRESHOLD`` on the record carries that license itself.
   Besides, a window of each template's length slides over the words of the whole text, whatever its size, with
   lines joined and tags left out (a shorter text is one window); a window from ``THRESHOLD`` on counts like a
   candidate. Templates are notices, headers and full texts.
2. Records whose path matches ``licence_file`` speak for their directory: its license is the one most of them
   carry (ties: the larger best cosine, then the smaller name).
3. A record without a license of its own inherits that of its nearest ancestor directory that has one: distinct
   directories are joined to their ancestors, records to directories.

Edge cases: null or empty texts have no license of their own and may inherit; a null path has no directory
(``path`` stays null) and inherits nothing; equal cosines go to the first template in the list; repeated rows
count and appear as often as they are there. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import pieces, small_batches, utf8, written
from tabsmith.llm.license_texts import FULL_TEXTS, HEADERS
from tabsmith.llm.words import NOT_ALNUM, word_hashes

THRESHOLD = 0.8
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)([._-][^/]*)?$"
_CUT = r"<[^>]*>|\n|[.!?] "
_TAG = r"</?[A-Za-z!?][^<>]*>"

# Short public notices of common licenses, the usual headers, full texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    *HEADERS,
    *FULL_TEXTS,
)


def candidates(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all candidates, their bounds, and the record of each candidate."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    lists = pc.split_pattern(pc.replace_substring_regex(text, _CUT, "\n"), "\n")
    words, bounds = word_hashes(*utf8(pc.list_flatten(lists)), NOT_ALNUM)
    return words, bounds, pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def joined(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the whole texts without tags, and their bounds."""
    return word_hashes(*utf8(pc.replace_substring_regex(pc.fill_null(text, "").cast(pa.large_string()), _TAG, " ")), NOT_ALNUM)


def window_norms(words: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Sum of (count * weight) ** 2 over the distinct words of each window of ``length`` words."""
    n, square = len(words), weight * weight
    code = np.unique(words, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    key, rank = code[order] * (n + 1) + order, np.empty(n, np.int64)
    rank[order] = np.arange(n)
    out, new = np.arange(n - length), np.arange(length, n)
    left = np.searchsorted(key, code[out] * (n + 1) + out + length) - rank[out]  # the leaving word's count in its window
    held = rank[new] - np.searchsorted(key, code[new] * (n + 1) + out + 1)  # the new word's count before it comes
    first = np.bincount(code[:length])
    one = np.zeros(len(first))
    one[code[:length]] = square[:length]
    steps = square[out] * (1 - 2 * left) + square[new] * (2 * held + 1)
    return np.concatenate([[0.0], np.cumsum(steps)]) + (first * first * one).sum()


class Scanner:
    """Cosines of candidates to the templates, given how many of ``n`` records hold each template word."""

    def __init__(self, templates: tuple, held: dict[int, int], n: int):
        self.names = [name for name, _ in templates]
        words, bounds = word_hashes(*utf8(pa.array([t for _, t in templates], pa.string())), NOT_ALNUM)
        self.vocabulary = np.unique(words)
        df = np.array([held.get(int(w), 0) for w in self.vocabulary.view(np.int64)])
        self.idf, self.other = np.log((n + 1) / (df + 1)) + 1, np.log(n + 1) + 1
        self.matrix = np.zeros((len(templates), len(self.vocabulary)))
        for i in range(len(templates)):
            own, count = np.unique(words[bounds[i] : bounds[i + 1]], return_counts=True)
            at = np.searchsorted(self.vocabulary, own)
            self.matrix[i, at] = count * self.idf[at]
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-300)
        self.lengths = np.diff(bounds)

    def best(self, words: np.ndarray, bounds: np.ndarray, record: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best template (-1: no common word) and its cosine, for each of ``n`` records."""
        which, score = np.full(n, -1), np.zeros(n)
        if not len(words):
            return which, score
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.lexsort((words, row))
        words, row = words[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])]))
        tf = np.diff(np.append(first, len(words)))
        words, row = words[first], row[first]
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        inside = self.vocabulary[at] == words
        weight = tf * np.where(inside, self.idf[at], self.other)
        norm = np.sqrt(np.bincount(row, weight * weight, len(bounds) - 1))
        near, place = np.unique(row[inside], return_inverse=True)
        if not len(near):
            return which, score
        dot = np.zeros((len(near), len(self.matrix)))
        for i, template in enumerate(self.matrix):
            dot[:, i] = np.bincount(place, weight[inside] * template[at[inside]], len(near))
        cosine = dot / norm[near][:, None]
        top = cosine.argmax(axis=1)
        value = cosine[np.arange(len(near)), top]
        for i in np.lexsort((-top, value)):  # the best last; ties: the first template last
            which[record[near[i]]], score[record[near[i]]] = top[i], value[i]
        return which, score


    def best_window(self, words: np.ndarray, bounds: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Index of the template with the best window from ``threshold`` on (-1: none) and its cosine, for each record."""
        n = len(bounds) - 1
        which, score = np.full(n, -1), np.zeros(n)
        if not len(words):
            return which, score
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at[self.vocabulary[at] != words] = len(self.vocabulary)
        weight = np.append(self.idf, self.other)[at]
        squares = np.concatenate([[0.0], np.cumsum(weight * weight)])
        row = np.repeat(np.arange(n), np.diff(bounds))
        begin, stop, place = bounds[row], bounds[row + 1], np.arange(len(words))
        ends = {}
        for i, length in enumerate(self.lengths):
            if length not in ends:
                ends = {length: (np.minimum(place + length, stop), (place + length <= stop) | (place == begin))}
            end, valid = ends[length]
            total = np.concatenate([[0.0], np.cumsum(np.append(self.idf * self.matrix[i], 0.0)[at])])
            dot = total[end] - total[:-1]
            # a word's squared count is its count at least, so no cosine lies above this
            near = valid & (dot * dot >= (threshold * threshold - 1e-6) * (squares[end] - squares[:-1])) & (dot > 1e-9)
            for r in np.unique(row[near]):
                a, b = bounds[r], bounds[r + 1]
                size = min(length, b - a)
                norm = window_norms(words[a:b], weight[a:b], size)
                value = float((dot[a : b - size + 1] / np.sqrt(norm)).max())
                if value >= threshold and value > score[r] + 1e-9:
                    which[r], score[r] = i, min(value, 1.0)
        return which, score


def word_counts(files: DataFrame, vocabulary: np.ndarray) -> tuple[dict[int, int], int]:
    """How many records hold each word of ``vocabulary``, and the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for part in pieces(batches):
            words, bounds = word_hashes(*utf8(part.column("text")), NOT_ALNUM)
            at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            inside = vocabulary[at] == words
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[inside]
            pair = np.unique(row * len(vocabulary) + at[inside])
            total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
            n += part.num_rows
        yield pa.RecordBatch.from_pydict({"word": np.append(vocabulary.view(np.int64), 0), "n": np.append(total, n)})

    sums = files.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in sums.collect()}  # the templates' words
    return got, got.pop(0, 0)


def directory(path: Column) -> Column:
    """What stands before the last ``/`` of a path; the empty text is the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, columns: list[str], licence_file: str = LICENCE_FILE, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``columns``, path, own_license, score, license and basis (``own``, ``inherited``, ``none``) and the directory
    ``inherited_from``, for every row of ``files`` (path, text and the columns)."""
    small_batches(files)
    files = files.withColumn("path", F.col("path").cast("string")).withColumn("text", F.col("text").cast("string"))
    vocabulary = np.unique(word_hashes(*utf8(pa.array([t for _, t in templates], pa.string())), NOT_ALNUM)[0])
    held = files.sparkSession.sparkContext.broadcast(Scanner(templates, *word_counts(files, vocabulary)))  # the templates
    source = files.select(*columns, "path", "text")
    kept = [f.name for f in source.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = held.value
        for part in pieces(batches):
            which, score = scanner.best(*candidates(part.column("text")), part.num_rows)
            window, value = scanner.best_window(*joined(part.column("text")), threshold)
            better = (window >= 0) & (value > score + 1e-9)
            which, score = np.where(better, window, which), np.where(better, value, score)
            own = [scanner.names[w] if w >= 0 and s >= threshold else None for w, s in zip(which, score)]
            yield pa.RecordBatch.from_pydict({n: part.column(n) for n in kept} | {"own_license": pa.array(own, pa.string()), "score": score})

    kinds = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in kept)
    found = written(source.mapInArrow(run, f"{kinds}, own_license string, score double").withColumn("__dir", directory(F.col("path"))), "scanned")
    grants = found.where(F.col("own_license").isNotNull() & F.col("path").rlike(licence_file)).groupBy("__dir", "own_license").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s"))
    grants = grants.groupBy("__dir").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("s")).alias("s"), F.col("own_license").alias("name"))).alias("g"))
    grants = grants.select(F.col("__dir").alias("ancestor"), F.col("g.name").alias("name"))
    parts = F.split("__dir", "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    dirs = found.select("__dir").where(F.col("__dir").isNotNull()).distinct().select("__dir", F.explode(depths).alias("depth"))
    dirs = dirs.select("__dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("ancestor")).where((F.col("depth") == 0) | (F.col("ancestor") != ""))
    nearest = dirs.join(grants, "ancestor").groupBy("__dir").agg(F.max(F.struct("depth", "ancestor", "name")).alias("near"))
    out = found.join(nearest, "__dir", "left")
    own, given = F.col("own_license").isNotNull(), F.col("near").isNotNull()
    return out.select(
        *columns, "path", "own_license", "score", F.coalesce("own_license", "near.name").alias("license"),
        F.when(own, "own").when(given, "inherited").otherwise("none").alias("basis"),
        F.when(~own, F.col("near.ancestor")).alias("inherited_from"),
    )
