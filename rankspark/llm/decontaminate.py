"""Benchmark decontamination by pigeonhole edit matching (operator 10).

A test item of m code points has an error budget of m // ERRORS_PER edits. Split into budget + 1
pieces, an occurrence within the budget leaves at least one piece untouched. All pieces are found
in one Aho-Corasick pass over a document; around every piece hit the window that an occurrence
could fill is verified with Myers' bit-parallel edit distance.

The test items are the stated query set: they are dealt into blocks of about BLOCK_CHARS code
points, so what a task holds is bounded, and each block is searched against all documents.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import bounded

#: One edit is allowed for so many code points of an item.
ERRORS_PER = 20
BLOCK_CHARS = 1_000_000


def normal_text(text: str | None) -> str:
    """Lower-cased text with every run of white space as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 consecutive pieces of nearly equal length, with their places."""
    n = len(item)
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Myers:
    """Myers' bit-vector search: the best match of a pattern that ends anywhere in a text."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance to any substring of ``text``, and the first end that has it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        least, where = score, 0
        masks = self.masks
        for i, c in enumerate(text, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least, where = score, i
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
        return least, where


def _search(items: list[tuple[int, str]], errors_per: int):
    def run(batches):
        import ahocorasick

        automaton, kinds = ahocorasick.Automaton(), []
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, item) in enumerate(items):
            budget = len(item) // errors_per
            kinds.append((budget, Myers(item)))
            for at, piece in pieces(item, budget):
                by_piece.setdefault(piece, []).append((i, at))
        for piece, uses in by_piece.items():
            automaton.add_word(piece, (len(piece), uses))
        if by_piece:
            automaton.make_automaton()
        for b in bounded(batches, 1):
            docs, found, distances, ends = [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist() if by_piece else ()):
                if not text:
                    continue
                text = normal_text(text)
                windows: dict[int, list[list[int]]] = {}
                for stop, (size, uses) in automaton.iter(text):
                    for i, at in uses:
                        budget, pattern = kinds[i]
                        start = stop + 1 - size - at
                        windows.setdefault(i, []).append([max(0, start - budget), start + pattern.size + budget])
                for i, spans in windows.items():
                    budget, pattern = kinds[i]
                    merged: list[list[int]] = []
                    for span in sorted(spans):
                        if merged and span[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], span[1])
                        else:
                            merged.append(span)
                    least, end = min((d, lo + e) for lo, hi in merged for d, e in [pattern.best(text[lo:hi])])
                    if least <= budget:
                        docs.append(row)
                        found.append(items[i][0])
                        distances.append(least)
                        ends.append(end)
            yield pa.record_batch([b.column(0).take(pa.array(docs, pa.int64())), pa.array(found, pa.int64()), pa.array(distances, pa.int32()), pa.array(ends, pa.int64())], names=[b.schema.names[0], "item_id", "distance", "end_pos"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, errors_per: int = ERRORS_PER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents that hold a test item within its error budget.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    Returns a row per document row and item found: doc_id, item_id, distance (smallest edit
    distance of the normalised item to a passage of the normalised text) and end_pos (code
    points of normalised text before the first end of such a passage). Items shorter than
    ``errors_per`` must occur unchanged. Null or empty texts and items match nothing; repeated
    items and rows are reported each; empty tables give no rows.
    """
    return _found(docs.select("doc_id", "text"), benchmark, errors_per, block_chars)


def _found(rows: DataFrame, benchmark: DataFrame, errors_per: int = ERRORS_PER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``contaminated`` for rows of any key and a text; the key stands in place of doc_id."""
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    results = []
    for i in range(blocks):
        held = [(r.item_id, normal_text(r.text)) for r in dealt.where(F.col("block") == i).collect()]
        held = [x for x in held if x[1]]
        results.append(rows.mapInArrow(_search(held, errors_per), f"{rows.columns[0]} {rows.dtypes[0][1]}, item_id long, distance int, end_pos long"))
    return reduce(DataFrame.unionByName, results)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; all columns are kept. The decision depends on
    the text alone and is joined back by a digest of it, so ids don't matter."""
    hits = _found(docs.select(F.sha2("text", 256).alias("version"), "text"), benchmark).select(F.col("version").alias("hit_version")).distinct()
    return docs.join(hits, F.sha2(docs["text"], 256) == hits["hit_version"], "left_anti")
