"""Which text items of a document a quote marks: all of them looked for in one pass over the quote.

An item is marked if it isn't empty and lies in the quote, both made NFC and white space aside (text.highlights says so
for one pair).  The distinct items of a document make one automaton (Aho and Corasick); quotes stream through it, so no
pair of an item and a quote is ever made but those that match.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.functions.text import squeeze
from citeframe.functions.thai import nfc
from citeframe.shipping import ship

#: Documents with more than this part of all quotes' text have their quotes dealt out, so many parts of the whole to a task.
HOT = 1000


def _automaton(items: dict[str, list[int]]) -> ahocorasick.Automaton | None:
    if not items:
        return None
    made = ahocorasick.Automaton()
    for text, positions in items.items():
        made.add_word(text, positions)
    made.make_automaton()
    return made


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document (and part): its items (side 0), then its quotes (side 1), as (_doc, pos, marked)."""
    now, items, machine = None, defaultdict(list), None
    for batch in batches:
        docs, parts, sides, at, texts = (batch.column(c).to_pylist() for c in ("_doc", "part", "side", "pos", "text"))
        out = []
        for k, doc in enumerate(docs):
            if (doc, parts[k]) != now:
                now, items, machine = (doc, parts[k]), defaultdict(list), None
            if sides[k] == 0:
                if texts[k]:
                    items[texts[k]].append(at[k])
                continue
            if items and machine is None:
                machine = _automaton(items)
            found = {id(hit): hit for _, hit in machine.iter(texts[k])} if machine and texts[k] else {}
            out.append((doc, at[k], sorted(p for hit in found.values() for p in hit)))
        if out:
            ids, pos, marked = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(pos, pa.int64()), pa.array(marked, pa.list_(pa.int64()))], names=["_doc", "pos", "marked"])


def highlight_items(items: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, quote and marked (array<bigint>: the items that it marks, rising) of every quote; none marks nothing.

    items: (key, item bigint, text), quotes: (key, quote bigint, text).  Texts that are null, or empty once white space
    is taken off, mark nothing and aren't marked; equal items are marked each.  Rows without a key are one document.
    A document's items have to fit a task; its quotes needn't.  The quotes of documents with much of all text are
    dealt out, each part with the document's items.
    """
    ship(items.sparkSession)
    plain = squeeze(nfc(F.coalesce(F.col("text"), F.lit(""))))
    doc = F.to_json(F.struct(key)).alias("_doc")
    told = quotes.select(doc, F.col("quote").cast("bigint").alias("pos"), plain.alias("text"))
    sizes = told.groupBy("_doc").agg(F.sum(F.length("text") + 1).alias("c"))
    total = sizes.agg(F.sum("c")).first()[0] or 1
    # fewer than HOT rows
    often = F.broadcast(sizes.filter(F.col("c") * HOT > total).select("_doc", F.ceil(F.col("c") * HOT / total).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    dealt = told.join(often, "_doc", "left").select("_doc", F.pmod(F.xxhash64("pos", "text"), parts).cast("int").alias("part"), F.lit(1).alias("side"), "pos", "text")
    known = items.select(doc, F.col("item").cast("bigint").alias("pos"), plain.alias("text"))
    known = known.join(often, "_doc", "left").select("_doc", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), "pos", "text")
    stream = known.unionByName(dealt).repartition("_doc", "part").sortWithinPartitions("_doc", "part", "side")
    found = stream.mapInArrow(_marked, "_doc string, pos bigint, marked array<bigint>")
    return found.select(F.from_json("_doc", quotes.select(key).schema)[key].alias(key), F.col("pos").alias("quote"), "marked")
