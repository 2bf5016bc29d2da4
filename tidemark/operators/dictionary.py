"""Dictionaries as tables: which of very many terms a text holds, rules by term, and names of places in texts.

Terms are matched by Aho-Corasick automata: one pass over a text finds every term, however many there are. A dictionary is
dealt to slices of bounded size, each of which is one automaton for every task, so a dictionary of any size is matched
whole; texts are read once for each slice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of terms of one automaton, about: some 100 bytes each in every worker.
SLICE_CHARS = 1 << 20
_LETTER = r"[\p{L}\p{N}]"

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(number: str, terms: pa.Table) -> ahocorasick.Automaton:
    """The automaton of a slice; a worker keeps the one that it used last."""
    if number not in _automata:
        _automata.clear()
        out = ahocorasick.Automaton()
        for no, term in zip(terms.column(0).to_pylist(), terms.column(1).to_pylist(), strict=True):
            out.add_word(term, (no, len(term)))
        if len(out):
            out.make_automaton()
        _automata[number] = out
    return _automata[number]


def term_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, slice_chars: int = SLICE_CHARS, distinct: bool = True) -> DataFrame:
    """(key, term, start, length) of every occurrence of a term in a text, overlapping ones too; with ``distinct`` the first
    of each term in a text. ``start`` is a character place from 0.

    ``terms`` has a column ``term``; empty and null terms match nothing, equal ones count once, null texts have no hits. Case
    matters: give both sides in one form. Slices are made by hash and hold ``slice_chars`` characters, one term at least.
    """
    spark = texts.sparkSession
    own = terms.select(F.col("term")).where(F.char_length("term") > 0).distinct()
    chars = own.agg(F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()[0]
    slices = max(1, -(-chars // slice_chars))
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.char_length("text") > 0)
    out = None
    for n in range(slices):
        held = own.where(F.pmod(F.xxhash64("term"), F.lit(slices)) == n).withColumn("no", F.lit(0)).select("no", "term").toArrow()
        shared, name = spark.sparkContext.broadcast(held), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            search = _automaton(name, shared.value)
            for batch in batches:
                if not len(search):
                    return
                owner, found, start, size = [], [], [], []
                for row, own_text in enumerate(batch.column(1).to_pylist()):
                    seen = set()
                    for end, (_, length) in search.iter(own_text):
                        at = end - length + 1
                        term = own_text[at : end + 1]
                        if distinct:
                            if term in seen:
                                continue
                            seen.add(term)
                        owner.append(row)
                        found.append(term)
                        start.append(at)
                        size.append(length)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], names=["key", "term", "start", "length"])

        kind = texts.schema[key].dataType.simpleString()
        part = rows.mapInArrow(find, f"key {kind}, term string, start int, length int")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def at_word_edges(hits: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """The hits that no letter or digit touches on either side; ``texts`` keys must be unique."""
    beside = lambda at: F.coalesce(F.rlike(F.substring(F.col(text), at, F.lit(1)), F.lit(_LETTER)), F.lit(False))
    before = (F.col("start") > 0) & beside(F.col("start"))
    return hits.join(texts.select(key, text), key).where(~before & ~beside(F.col("start") + F.col("length") + 1)).drop(text)


def first_entry(texts: DataFrame, key: str, text: str, entries: DataFrame, order: list[Column], **options: int) -> DataFrame:
    """(key, columns of ``entries``): the entry, first in ``order``, whose ``term`` a text holds. ``order`` should be total."""
    hits = term_hits(texts, key, text, entries, **options).select(key, "term")
    columns = [c for c in entries.columns if c != key]
    ranked = hits.join(entries.select(*columns), "term")
    best = ranked.groupBy(key).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*columns).alias("entry"))).alias("b"))
    return best.select(key, "b.entry.*")


def apply_term_rules(texts: DataFrame, key: str, text: str, rules: DataFrame, verdict: str = "verdict", score: str = "score", **options: int) -> DataFrame:
    """``texts`` with verdict and score after the first rule whose term the text holds; adds rule, stage and borderline.

    ``rules`` is a table (no, stage, rule, term, action, points) of any length, ``no`` unique: ``reject`` is final, ``hold``
    rejects but stays open, ``cap`` leaves at most ``points`` and reference at best. Keys must be unique.
    """
    found = first_entry(texts, key, text, rules.select("no", "stage", "rule", "term", "action", "points"), [F.col("no")], **options).drop("term", "no")
    out = texts.join(found, key, "left")
    stops, capped = F.coalesce(F.col("action").isin("reject", "hold"), F.lit(False)), F.coalesce(F.col("action") == "cap", F.lit(False))
    new_verdict = F.when(stops, "rejected").when(capped & (F.col(verdict) == "verified"), "reference").otherwise(F.col(verdict))
    new_score = F.when(stops, F.col("points")).when(capped, F.least(F.col(score), F.col("points"))).otherwise(F.col(score))
    return out.withColumns({verdict: new_verdict, score: new_score, "borderline": F.coalesce(F.col("action") == "hold", F.lit(False))}).drop("action", "points")


def resolve_places(texts: DataFrame, key: str, text: str, gazetteer: DataFrame, **options: int) -> DataFrame:
    """(key, region, level, name): the place that each text names, of a ``gazetteer`` (region, name, level, parent).

    Only longest names count: one inside a longer one that stands at the same place does not. A name that several regions
    have means the one whose parent the text also names, else none unless it is the only one. Of the rest the deepest level
    counts, then the longest name, then the first in the text, then the smallest region. Names match at word edges.
    """
    hits = at_word_edges(term_hits(texts, key, text, gazetteer.select(F.col("name").alias("term")), distinct=False, **options), texts, key, text)
    # the hits of one text are few beside its length; those covered by a longer one go
    spans = hits.groupBy(key).agg(F.collect_list(F.struct("start", "length", "term")).alias("all"))
    covers = lambda a, b: (a["length"] > b["length"]) & (a["start"] <= b["start"]) & (a["start"] + a["length"] >= b["start"] + b["length"])
    longest = spans.select(key, F.explode(F.filter("all", lambda b: ~F.exists("all", lambda a: covers(a, b)))).alias("h")).select(key, "h.*")
    named = longest.groupBy(key, "term").agg(F.min("start").alias("start"))
    entries = gazetteer.select(F.col("name").alias("term"), "region", "level", "parent")
    meant = named.join(entries, "term")
    counts = gazetteer.groupBy(F.col("name").alias("term")).agg(F.count_distinct("region").alias("regions"))
    above = meant.select(key, F.col("region").alias("parent"), F.lit(True).alias("parent_named")).distinct()
    meant = meant.join(counts, "term").join(above, [key, "parent"], "left").where((F.col("regions") == 1) | F.col("parent_named"))
    best = F.max_by(F.struct("region", "level", F.col("term").alias("name")), F.struct("level", F.char_length("term").alias("n"), (-F.col("start")).alias("s"), (-F.xxhash64("region")).alias("r")))
    return meant.groupBy(key).agg(best.alias("b")).select(key, "b.region", "b.level", "b.name")
