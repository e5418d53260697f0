"""Evaluation passages inside training text: many patterns, one pass.

Wu-Manber search over words: all runs of ``length`` consecutive words of the held-out items are the patterns. A block of two words ending at the current position
is looked up in the shift table; a block that ends no pattern allows a jump past every position that cannot be a match, a block that does leads through a bucket,
keyed by the hash of a pattern's last words, to the patterns that are compared word by word. Ordinary text is crossed eleven words a step.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.mail import visible_words, words
from platewise.session import materialize

BLOCK = 2


class PassageSearch:
    """Shift table and suffix buckets of all ``length``-word runs of the items."""

    def __init__(self, items: list[tuple[int, list[str]]], length: int = 12):
        self.length = length
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[int, list[tuple[int, list[str], int]]]] = defaultdict(lambda: defaultdict(list))
        last = length - BLOCK
        for item, text in items:
            for start in range(len(text) - length + 1):
                for at in range(last + 1):
                    block = (text[start + at], text[start + at + 1])
                    jump = last - at
                    if jump < self.shift.get(block, last + 1):
                        self.shift[block] = jump
                end = start + length
                suffix = (text[end - 2], text[end - 1])
                self.bucket[suffix][hash(tuple(text[end - 4 : end]))].append((item, text, start))

    def find(self, text: list[str]) -> set[int]:
        """Items with a run in ``text``."""
        found: set[int] = set()
        shift, far, length = self.shift, self.length - BLOCK + 1, self.length
        at = length - 1  # the last word of the window
        end = len(text)
        while at < end:
            jump = shift.get((text[at - 1], text[at]), far)
            if jump:
                at += jump
                continue
            candidates = self.bucket[(text[at - 1], text[at])].get(hash(tuple(text[at - 3 : at + 1])), ())
            for item, whole, start in candidates:
                if item not in found and whole[start : start + length] == text[at - length + 1 : at + 1]:
                    found.add(item)
            at += 1
        return found


#: The tables of the block a Python worker built last: its tasks search the same block one after the other.
_built: dict[str, PassageSearch] = {}


def _tables(name: str, block: list[tuple[int, list[str]]], length: int) -> PassageSearch:
    if name not in _built:
        _built.clear()
        _built[name] = PassageSearch(block, length)
    return _built[name]


def _item_blocks(items: DataFrame, item_id: str, item_text: str, length: int, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items with at least ``length`` words, in blocks of at most ``block_words`` words (a longer item is a block of its own); one block at a time is held."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null").toLocalIterator():
        run = words(row["t"])
        if len(run) < length:
            continue
        if block and size + len(run) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], run))
        size += len(run)
    if block:
        yield block


def leaked_passages(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 12, block_words: int = 500_000
) -> DataFrame:
    """(``item_id``, ``doc_id``): documents that show at least ``length`` consecutive words of an item, whole texts, quoted mail included.

    Items are taken in blocks of at most ``block_words`` words (their tables go to every task; a few hundred MB at most), so the held-out set may be of any size. The mails are read
    once: one block searches them as they are read; for several blocks the words read are written and every block searches those. Documents are never shuffled. Items
    shorter than ``length`` words and null texts match nothing; repeated items or documents with other ids are each reported."""
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    doc_type = documents.schema[doc_id].dataType.simpleString()
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, doc_id {doc_type}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shown": [[" ".join(w) for w in visible_words(t)] if isinstance(t, str) else [] for t in pdf["text"]]})

    def search_block(block: list[tuple[int, list[str]]], parsed: bool) -> DataFrame:
        held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables = _tables(name, held.value, length)
            for pdf in batches:
                pairs = set()
                for doc, raw in zip(pdf["doc_id"], pdf.iloc[:, 1]):
                    parts = (p.split(" ") for p in raw) if parsed else visible_words(raw) if isinstance(raw, str) else ()
                    for shown in parts:
                        pairs.update((item, doc) for item in tables.find(shown))
                yield pd.DataFrame(sorted(pairs), columns=["item_id", "doc_id"])

        return (written if parsed else source).mapInPandas(search, schema)

    blocks = _item_blocks(items, item_id, item_text, length, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        return search_block(first, False).distinct()
    written = materialize(source.mapInPandas(read, f"doc_id {doc_type}, shown array<string>"), "visible-words")
    result = search_block(first, True)
    for block in itertools.chain([second], blocks):
        result = result.union(search_block(block, True))
    return result.distinct()
