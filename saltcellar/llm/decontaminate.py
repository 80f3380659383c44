"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import sent_if_small, small_batches, stored, text_of, whole_row

WINDOW_WORDS = 20
EDIT_SHARE = 0.06
PART_CHARS = 1_000_000  # characters of the benchmark in one pass over the documents; what a task holds grows with them alone
STRETCH_WORDS = 1000  # longer items are laid out in stretches that share all but a word of a window
_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Lower-case words with one space between: case, punctuation and line breaks are no difference."""
    return _OTHER.sub(" ", text.lower()).strip()


def window_starts(words: int) -> list[int]:
    """First words of the windows of an item of so many words, one at every word; a shorter item is one window."""
    return list(range(max(words - WINDOW_WORDS, 0) + 1))


def pieces(window: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of about one length, with their offsets: that many edits leave one untouched."""
    cuts = [len(window) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, window[a:b]) for a, b in zip(cuts, cuts[1:])]


def stretches(text: str) -> list[str]:
    """Pieces of a long item of bounded length; each window of the item is whole in one of them."""
    parts = text.split(" ") if text else []
    if len(parts) <= STRETCH_WORDS:
        return [text] if parts else []
    share = WINDOW_WORDS - 1
    return [" ".join(parts[s : s + STRETCH_WORDS + share]) for s in range(0, len(parts) - share, STRETCH_WORDS)]


def reach(pattern: str, text: str, most: int) -> list[int]:
    """For 0 to `most` edits, how many leading characters of the pattern can be had from the beginning of the text."""
    long, wide = len(pattern), len(text)
    out: list[int] = []
    last: dict[int, int] = {}
    for edits in range(most + 1):
        rows: dict[int, int] = {}
        for d in range(-edits, edits + 1):  # d: characters of the text less characters of the pattern
            if edits:
                # a replaced character, one more of the pattern, one more of the text
                i = max(last.get(d, -9) + 1, last.get(d + 1, -9) + 1, last.get(d - 1, -9))
            else:
                i = 0
            i = min(i, long, wide - d)
            if i < 0 or i + d < 0:
                continue
            while i < long and i + d < wide and pattern[i] == text[i + d]:
                i += 1
            rows[d] = i
        last = rows
        out.append(max(max(rows.values(), default=0), out[-1] if out else 0))
        if out[-1] == long:
            break
    return out


def end_distance(pattern_bits: dict[str, int], length: int, text: str, most: int) -> int:
    """Least edits that turn the pattern into some part of `text` (Myers, one machine-independent word); most + 1 if more."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best = full, 0, length, length
    for char in text:
        match = pattern_bits.get(char, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        vertical = match | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best = score
    return min(best, most + 1)


def _bits(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, char in enumerate(pattern):
        found[char] = found.get(char, 0) | (1 << i)
    return found


class _Text:
    """A stretch of items with its windows in order: where they begin and end, and their budgets."""

    def __init__(self, text: str, items: list[int], share: float):
        self.text, self.items = text, items
        words = text.split(" ")
        begin = array("l", [0])
        for word in words[:-1]:
            begin.append(begin[-1] + len(word) + 1)
        size = min(WINDOW_WORDS, len(words))
        first = window_starts(len(words))
        self.start = array("l", [begin[w] for w in first])
        self.end = array("l", [begin[w + size - 1] + len(words[w + size - 1]) for w in first])
        self.budget = array("l", [int((e - s) * share) for s, e in zip(self.start, self.end)])
        self.longest = max(e - s for s, e in zip(self.start, self.end))

    def pieces(self) -> list[tuple[int, str]]:
        """Pieces of which every window holds one more than its budget. Windows share those of a grid over the stretch."""
        if len(self.start) == 1:
            return [(self.start[0] + at, piece) for at, piece in pieces(self.text[self.start[0] : self.end[0]], self.budget[0])]
        step = min((e - s + 1) // (b + 2) for s, e, b in zip(self.start, self.end, self.budget))
        return [(at, self.text[at : at + step]) for at in range(0, len(self.text) - step + 1, step)]

    def least_edits(self, at: int, length: int, text: str, place: int) -> int | None:
        """Least edits among the windows around the piece at `at`, which stands in `text` at `place`; None beyond the budgets."""
        after = at + length
        low, high = bisect_left(self.end, after), bisect_right(self.start, at)
        if low >= high:
            return None
        most = max(self.budget[low:high])
        left, right, behind = self.start[low], self.end[high - 1], place + length
        forward = reach(self.text[after:right], text[behind : behind + right - after + most], most)
        need = min(e - s for s, e in zip(self.start[low:high], self.end[low:high]))
        if forward[-1] + length + at - left < need:
            return None
        back = reach(self.text[left:at][::-1], text[max(0, place - (at - left) - most) : place][::-1], most)
        if forward[-1] + length + back[-1] < need:
            return None
        best = None
        for s, e, budget in zip(self.start[low:high], self.end[low:high], self.budget[low:high]):
            edits = bisect_left(back, at - s) + bisect_left(forward, e - after)
            if back[-1] >= at - s and forward[-1] >= e - after and edits <= budget and (best is None or edits < best):
                best = edits
        return best


class _Index:
    """The pieces of one part of the benchmark in one automaton; built once per task."""

    def __init__(self, rows: list[tuple[int, str]], share: float):
        owners: dict[str, list[int]] = {}
        for item, text in rows:
            owners.setdefault(text, []).append(item)
        self.tests = [_Text(text, items, share) for text, items in owners.items()]
        where: dict[str, list[tuple[int, int]]] = {}
        for number, test in enumerate(self.tests):
            for offset, piece in test.pieces():
                where.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def search(self, text: str) -> dict[int, int]:
        """Item -> least edits among its windows that are found in `text`."""
        best: dict[int, int] = {}
        if not self.tests:
            return best
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                if best.get(number) == 0:
                    continue
                edits = self.tests[number].least_edits(offset, length, text, end + 1 - length)
                if edits is not None and edits < best.get(number, edits + 1):
                    best[number] = edits
        found: dict[int, int] = {}
        for number, edits in best.items():
            for item in self.tests[number].items:
                found[item] = min(edits, found.get(item, edits))
        return found


def _parts(benchmark: DataFrame, item: str, item_text: str, most_chars: int | None, part_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's stretches (item, text) in parts of about `part_chars` characters; the driver holds one part at a time."""
    named = benchmark.select(F.col(item).cast("long").alias("item"), text_of(item_text).alias("of")).filter("item IS NOT NULL")
    if most_chars is not None:
        size = named.agg(F.coalesce(F.sum(F.length("of")), F.lit(0))).first()[0]
        if size > most_chars:
            raise ValueError(f"the benchmark has {size} characters, more than the {most_chars} asked for")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, text in zip(batch["item"], batch["of"]):
                laid = stretches(plain(text))
                if laid:
                    yield pd.DataFrame({"item": number, "stretch": laid})

    laid = stored(small_batches(named).mapInPandas(cut, "item bigint, stretch string").distinct(), "benchmark")
    size = laid.agg(F.coalesce(F.sum(F.length("stretch")), F.lit(0))).first()[0]
    number = max(1, -(-size // part_chars))
    part = F.pmod(F.xxhash64("stretch"), F.lit(number))
    for k in range(number):
        yield sorted((r["item"], r["stretch"]) for r in laid.filter(part == k).toLocalIterator())


def _judged(documents: DataFrame, tests: list[tuple[int, str]], key: str, text: str, edit_share: float) -> DataFrame:
    """(_key, _row, items, edits) of each document row for one part of the benchmark; _row hashes key and text."""
    shared = documents.sparkSession.sparkContext.broadcast(tests)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Index(shared.value, edit_share)
        for batch in batches:
            hits = [sorted(index.search(plain(t)).items()) for t in batch["_text"]]
            yield pd.DataFrame(
                {
                    "_key": batch["_key"],
                    "_row": batch["_row"],
                    "items": [np.array([i for i, _ in h], dtype="int64") for h in hits],
                    "edits": [np.array([e for _, e in h], dtype="int32") for h in hits],
                }
            )

    kind = documents.schema[key].dataType.simpleString()
    rows = small_batches(documents).select(F.col(key).alias("_key"), F.xxhash64(F.col(key), text_of(text)).alias("_row"), text_of(text).alias("_text"))
    return rows.mapInPandas(judge, f"_key {kind}, _row bigint, items array<bigint>, edits array<int>")


def _found(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    edit_share: float = EDIT_SHARE, most_chars: int | None = None, part_chars: int = PART_CHARS,
) -> DataFrame:
    """(_key, _row, items, edits), the contaminated rows only, once each."""
    hits = None
    for tests in _parts(benchmark, item, item_text, most_chars, part_chars):
        part = stored(_judged(documents, tests, key, text, edit_share).filter(F.size("items") > 0), "contaminated")
        hits = part if hits is None else hits.union(part)
    each = hits.select("_key", "_row", F.inline(F.arrays_zip("items", "edits"))).groupBy("_key", "_row", "items").agg(F.min("edits").alias("edits"))
    listed = each.groupBy("_key", "_row").agg(F.sort_array(F.collect_list(F.struct("items", "edits"))).alias("hits"))
    return listed.select("_key", "_row", F.col("hits.items").alias("items"), F.col("hits.edits").alias("edits"))


def contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", edit_share: float = EDIT_SHARE, most_chars: int | None = None, part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per document row with the test items found in it: key, items (sorted ids), edits (of each), n_items.

    Each test item is read as windows of 20 words from every word on (a shorter item: the whole of it), so any 20 words of an item count. A
    window may differ by 6 % of its characters: pieces are cut so that each window holds one more than that, each document is
    searched for all pieces at once over its whole text, and from each hit the edits are counted both ways along diagonals.
    Case, punctuation and white space make no difference. A benchmark of any size is taken, in parts of about `part_chars`
    characters, with one pass over the documents for each; `most_chars`, if given, refuses a larger one.

    Null or empty documents match nothing; null or wordless items match nothing; repeated items are found under each id;
    items with a null id are left out; repeated documents are judged row by row; an empty benchmark finds nothing.
    """
    found = sent_if_small(stored(_found(documents, benchmark, key, text, item, item_text, edit_share, most_chars, part_chars), "found"))
    rows = documents.select(F.col(key).alias("_own"), F.xxhash64(F.col(key), text_of(text)).alias("_own_row"))
    joined = rows.join(found, F.col("_own").eqNullSafe(F.col("_key")) & (F.col("_own_row") == F.col("_row")), "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    edits = F.coalesce("edits", F.array().cast("array<int>"))
    return joined.select(F.col("_own").alias(key), items.alias("items"), edits.alias("edits"), F.size(items).alias("n_items"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The documents without those in which a test item is found; all columns stay as they are."""
    bad = sent_if_small(stored(_found(documents, benchmark, key, **settings).select("_key", "_row"), "found"))
    row = F.xxhash64(F.col(f"own.{key}"), text_of(F.col(f"own.{settings.get('text', 'text')}")))
    rows = documents.select(whole_row(documents))
    return rows.join(bad, F.col(f"own.{key}").eqNullSafe(F.col("_key")) & (row == F.col("_row")), "left_anti").select("own.*")
