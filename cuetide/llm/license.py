"""License scans: sparse TF-IDF cosine to license templates, and inheritance from the nearest ancestor directory.

Terms are runs of letters and digits, lower case; a template's weights are term count times the idf over the templates,
and terms that no template has weigh as much as the rarest. There are two sets of templates: notices, which a header is
compared to, and whole license texts, which whole texts are compared to. Both are parameters. A header is a line, or a
run of lines as notices are wrapped in comments, whose cosine to a notice reaches `header_cosine`; runs hold up to twice
the terms of the longest notice. Comment marks are no terms, or are words that are taken off (rem, dnl). A notice with
numbers, such as those of a version, is matched only by what holds all of them: version 2 never stands for version 3.

A license file is a text that as a whole reaches `file_cosine`, or one whose file name says so (LICENSE, COPYING, NOTICE
and the like) and that holds a header. A text's own license is the one it matches as a whole, else its header's. A text without takes over the license of the nearest directory above it that holds a license file; in one
directory the highest cosine wins, then the license that sorts first.

Before any weighing, a text must hold an anchor: terms without which nothing can reach the threshold, since the other
terms of the template have too little of its length. Templates go to the executors; they don't grow with the data.
Directories are joined as distinct rows, so a directory with very many files costs one.

Null paths stand for the root's files with no name; null and empty texts match nothing. Ties between templates go to the
one that sorts first. Repeated rows are judged each; empty tables give none. A very long text needs memory for its terms.
Other columns pass unchanged; columns named as outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuetide.llm.common import add_columns, spare, stored
from cuetide.llm.license_texts import TEMPLATES, TEXTS

HEADER_COSINE, FILE_COSINE = 0.8, 0.5
SCANNED = ["header_license", "header_cosine", "header_line", "whole_license", "whole_cosine"]
ADDED = ["is_license_file", "own_license", "own_cosine", "license", "found_in"]
_TERM = re.compile(r"[^\W_]+")
_MARK = re.compile(r"^\s*(?:rem|dnl)\b")
#: Lines whose running sums are held at once, and runs that are remembered.
_BLOCK = 5000
_FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([.\-_].*)?$"


def load_texts(paths: list[str]) -> list[tuple[str, str]]:
    """Templates from files, each named by its license (GPL-3.0.txt), for `texts` beside TEXTS."""
    return [(Path(p).stem, Path(p).read_text(encoding="utf-8")) for p in sorted(paths)]


class Templates:
    def __init__(self, templates: list[tuple[str, str]], least_cosine: float):
        bags = [Counter(_TERM.findall(text.lower())) for _, text in templates]
        count = len(bags)
        held = Counter(t for bag in bags for t in bag)
        self.idf = {t: math.log((1 + count) / (1 + n)) + 1 for t, n in held.items()}
        self.rare = math.log(1 + count) + 1
        self.names = [name for name, _ in templates]
        self.numbers = [frozenset(t for t in bag if t.isdigit()) for bag in bags]
        self.weights: dict[str, list[tuple[int, float]]] = {}
        self.anchors: set[str] = set()
        for at, bag in enumerate(bags):
            raw = {t: n * self.idf[t] for t, n in bag.items()}
            length = math.sqrt(sum(w * w for w in raw.values())) or 1.0
            unit = sorted(((w / length, t) for t, w in raw.items()), reverse=True)
            for w, t in unit:
                self.weights.setdefault(t, []).append((at, w))
            # Without the terms taken so far, a text's cosine is at most the length of the rest.
            rest = 1.0
            for w, t in unit:
                if math.sqrt(max(rest, 0.0)) < least_cosine:
                    break
                self.anchors.add(t)
                rest -= w * w
        self.longest = max((sum(bag.values()) for bag in bags), default=0)
        self.least = least_cosine
        #: Places of the terms that templates have, and per place, with one more for all others: the weight, whether it
        #: is an anchor, the product with each template, and the place among the numbers that templates ask for.
        self.terms = {t: at for at, t in enumerate(self.weights)}
        self.weight = np.array([*(self.idf[t] for t in self.terms), self.rare])
        self.is_anchor = np.array([*(t in self.anchors for t in self.terms), False])
        self.matrix = np.zeros((len(self.terms), count))
        for t, at in self.terms.items():
            for name, w in self.weights[t]:
                self.matrix[at, name] = self.idf[t] * w
        self.asked = {n: at for at, n in enumerate(sorted(set().union(*self.numbers)))}
        self.number = np.array([*(self.asked.get(t, -1) for t in self.terms), -1])
        self.needs = np.zeros((len(self.asked), count), np.int64)
        for at, numbers in enumerate(self.numbers):
            self.needs[[self.asked[n] for n in numbers], at] = 1

    def _nearest(self, dots: dict[int, float], bag: Counter[str]) -> int:
        """The template with the largest product, the first of equals, of those whose numbers the bag has; or -1."""
        found, most = -1, 0.0
        for at in sorted(dots):
            if dots[at] > most + 1e-12 and all(n in bag for n in self.numbers[at]):
                found, most = at, dots[at]
        return found

    def best(self, terms: list[str]) -> tuple[float, int]:
        """(cosine, template) of the nearest template; (0, -1) if none shares a term."""
        bag = Counter(terms)
        dots: dict[int, float] = {}
        square = 0.0
        for term, n in bag.items():
            weight = n * self.idf.get(term, self.rare)
            square += weight * weight
            for at, w in self.weights.get(term, ()):
                dots[at] = dots.get(at, 0.0) + weight * w
        at = self._nearest(dots, bag)
        return (dots[at] / math.sqrt(square), at) if at >= 0 else (0.0, -1)

    def _measured(self, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sums over lines, from 0, of the terms of these places: products with each template, counts of the
        numbers templates ask for, and squares of the terms' weights. A line's terms start at its start."""
        owner = np.repeat(np.arange(1, len(starts) + 1), np.diff(np.append(starts, len(places))))
        known = places < len(self.terms)
        products, counts = np.zeros((len(starts) + 1, len(self.names))), np.zeros((len(starts) + 1, len(self.asked)), np.int64)
        np.add.at(products, owner[known], self.matrix[places[known]])
        number = self.number[places]
        np.add.at(counts, (owner[number >= 0], number[number >= 0]), 1)
        squares = np.bincount(owner, self.weight[places] ** 2, len(starts) + 1)
        return np.cumsum(products, 0), np.cumsum(counts, 0), np.cumsum(squares)

    def _squares(self, lines: list[list[str]], first: int, last: int) -> np.ndarray:
        """The squared length of the bag of lines first .. k, for each k."""
        bag: dict[str, int] = {}
        square, out = 0.0, []
        for terms in lines[first:last]:
            for term in terms:
                weight, n = self.idf.get(term, self.rare), bag.get(term, 0)
                square += (2 * n + 1) * weight * weight
                bag[term] = n + 1
            out.append(square)
        return np.array(out)

    def best_run(self, lines: list[list[str]]) -> tuple[float, int, int]:
        """Of the terms of a text's lines: (cosine, template, first line) of the nearest line or run of lines that holds an
        anchor; (0, -1, -1) if none reaches the least cosine. The first of equal runs counts, cosines being equal that differ
        by less than 1e-9.

        A run starts and ends with a term of a template and has at most twice the terms of the longest one, unless it is one
        line. Lines without terms are passed over. Products come from running sums over the lines, so a start costs its
        bag's length and a few array operations; starts that are followed by the same lines cost one."""
        places = [at for at, terms in enumerate(lines) if terms]
        lines = [lines[at] for at in places]
        if not lines:
            return 0.0, -1, -1
        most, unknown = 2 * self.longest, len(self.terms)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        terms = np.fromiter((self.terms.get(t, unknown) for own in lines for t in own), np.int64, int(ends[-1]))
        known = np.logical_or.reduceat(terms < unknown, begins)
        # Of each start, the line after the last that a run may hold, and the next line with an anchor.
        after = np.maximum(np.searchsorted(ends, begins + most, "right"), np.arange(len(lines)) + 1)
        anchored = np.append(np.flatnonzero(np.logical_or.reduceat(self.is_anchor[terms], begins)), len(lines))
        anchor = anchored[np.searchsorted(anchored, np.arange(len(lines)))]
        texts: dict[tuple[str, ...], int] = {}
        ids: list[int] = []
        seen: set[tuple[int, ...]] = set()
        bound, best, base, measured_to = self.least - 1e-12, (0, -1, -1), 0, 0
        for first in np.flatnonzero(known & (anchor < after)).tolist():
            last, holds = int(after[first]), int(anchor[first])
            if last > measured_to:
                base, measured_to = first, min(len(lines), first + _BLOCK + most)
                products, counts, least = self._measured(terms[begins[base] : ends[measured_to - 1]], begins[base:measured_to] - begins[base])
            lasts = holds + np.flatnonzero(known[holds:last])
            if not len(lasts):
                continue
            dots = products[lasts + 1 - base] - products[first - base]
            # A bag is no shorter than if its terms were all different.
            if (dots.max(1) <= bound * np.sqrt(least[lasts + 1 - base] - least[first - base]) - 1e-9).all():
                continue
            ids = ids or [texts.setdefault(tuple(own), len(texts)) for own in lines]
            if (followed := tuple(ids[first:last])) in seen:
                continue
            if len(seen) >= _BLOCK:
                seen.clear()
            seen.add(followed)
            cosines = dots / np.sqrt(self._squares(lines, first, last))[lasts - first, None]
            if cosines.max() <= bound:
                continue
            lacking = counts[lasts + 1 - base] - counts[first - base] == 0
            cosines[(lacking @ self.needs) > 0] = 0.0
            top = cosines.max(1)
            for k in np.flatnonzero(top > bound).tolist():
                if top[k] > bound:
                    bound, best = float(top[k]) + 1e-9, (first, int(lasts[k]) + 1, int(np.flatnonzero(cosines[k] > top[k] - 1e-9)[0]))
        first, last, name = best
        if name < 0:
            return 0.0, -1, -1
        run = [t for terms in lines[first:last] for t in terms]
        return self._cosine(run, name), name, places[first]

    def _cosine(self, terms: list[str], template: int) -> float:
        bag = Counter(terms)
        dot = sum(n * self.idf.get(t, self.rare) * w for t, n in bag.items() for at, w in self.weights.get(t, ()) if at == template)
        return dot / math.sqrt(sum((n * self.idf.get(t, self.rare)) ** 2 for t, n in bag.items()))


def scan(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, texts: list[tuple[str, str]] = TEXTS, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> DataFrame:
    """Add header_license, header_cosine, header_line (of the best line or the first of the best run, from 0), whole_license
    and whole_cosine (null where the threshold is missed)."""
    sent = df.sparkSession.sparkContext.broadcast((templates, texts))

    def make():
        notices, wholes = Templates(sent.value[0], header_cosine), Templates(sent.value[1], file_cosine)

        def step(values: list) -> tuple[list, ...]:
            rows = []
            for value in values:
                header, whole = (None, None, None), (None, None)
                lowered = (value or "").lower()
                terms = _TERM.findall(lowered)
                distinct = set(terms)
                if not notices.anchors.isdisjoint(distinct):
                    best = notices.best_run([_TERM.findall(_MARK.sub("", line)) for line in lowered.split("\n")])
                    if best[0] >= header_cosine:
                        header = (notices.names[best[1]], best[0], best[2])
                if not wholes.anchors.isdisjoint(distinct):
                    cosine, at = wholes.best(terms)
                    if cosine >= file_cosine:
                        whole = (wholes.names[at], cosine)
                rows.append((*header, *whole))
            return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * 5

        return step

    kinds = [(T.StringType(), pa.string()), (T.DoubleType(), pa.float64()), (T.IntegerType(), pa.int32()), (T.StringType(), pa.string()), (T.DoubleType(), pa.float64())]
    return add_columns(df, make, text, [(name, *kind) for name, kind in zip(SCANNED, kinds, strict=True)])


def directory_of(path: Column) -> Column:
    """The path up to its last slash, without that; empty for the root."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def with_licenses(df: DataFrame, path: str = "path", text: str = "text", file_cosine: float = FILE_COSINE, **scanning) -> DataFrame:
    """df's columns but the text, and: own_license, own_cosine, is_license_file, license (own or inherited), found_in (the
    directory it is inherited from, null if it's the row's own)."""
    here, at, below, said = (spare([*df.columns, *ADDED], n) for n in ("here", "at", "below", "said"))
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)
    whole, header = F.col("whole_cosine").isNotNull(), F.col("header_cosine").isNotNull()
    found = {
        "is_license_file": whole | (name.rlike(_FILE_NAME) & header),
        "own_license": F.when(whole, F.col("whole_license")).otherwise(F.col("header_license")),
        "own_cosine": F.when(whole, F.col("whole_cosine")).otherwise(F.col("header_cosine")),
        here: directory_of(F.col(path)),
    }
    own = scan(df, text, file_cosine=file_cosine, **scanning).drop(text).withColumns(found)
    own = stored(own.drop(*SCANNED), "license-own")
    # The highest cosine, then the license that sorts first.
    best = F.min_by("own_license", F.struct(-F.col("own_cosine"), F.col("own_license"))).alias(said)
    declared = stored(own.where("is_license_file and own_license is not null").groupBy(F.col(here).alias(at)).agg(best), "license-dirs")
    parts = F.split(here, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = F.concat(F.array(F.lit("")), F.when(F.col(here) == "", F.array().cast("array<string>")).otherwise(paths))
    dirs = own.select(here).distinct().select(here, F.explode(above).alias("above"))
    nearest = F.max_by(F.struct(said, at), F.length(at)).alias("near")
    inherited = dirs.join(declared, F.col("above") == F.col(at)).groupBy(F.col(here).alias(below)).agg(nearest)
    inherited = stored(inherited.select(below, "near.*"), "license-inherited")
    joined = own.join(inherited, F.col(here) == F.col(below), "left")
    return joined.withColumns({"license": F.coalesce("own_license", said), "found_in": F.when(F.col("own_license").isNull(), F.col(at))}).drop(here, at, below, said)
