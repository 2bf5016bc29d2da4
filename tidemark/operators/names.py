"""Names, addresses and ordered rules: what tells an entity apart, where it lies, and which rule decides a text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.nested import bound

# ---------------------------------------------------------------- names


def cleaned_name(name: Column, tails: tuple[str, ...]) -> Column:
    """A name without describing words at its end; the name itself where fewer than two characters would be left."""
    words = F.split(F.trim(F.coalesce(name, F.lit(""))), r"[ \t]+")
    kept = F.transform(words, lambda w, i: F.when(~F.lower(w).isin(*tails) | (i == 0), i))
    short = F.array_join(F.slice(words, 1, F.greatest(F.array_max(kept) + 1, F.lit(1))), " ")
    return F.when(F.char_length(short) >= 2, short).otherwise(name)


def _rather(items: Column, weak: Callable[[Column], Column]) -> Column:
    """The items that are not weak, or all of them where all are. Items are named twice: they should be bound."""
    return bound(F.filter(items, lambda m: ~weak(m)), lambda strong: F.when(F.size(strong) > 0, strong).otherwise(items))


def distinctive_words(name: Column, areas: Column, generic: tuple[str, ...], suffix: str, branch: str) -> Column:
    """The words by which a name is told apart, in order.

    ``suffix`` is a pattern of trade words at the end of a word, taken off; ``generic`` words and ``areas`` (an array of
    lower-case names, also where an area holds the word or differs by one letter) do not count. Words with the ``branch``
    pattern and plain numbers count only where nothing else is left.
    """
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[ \t,.;:]+"), lambda w: w != "")
    marked = F.transform(words, lambda w: F.struct(F.regexp_replace(w, suffix, "").alias("core"), F.rlike(w, F.lit(branch)).alias("branch")))
    is_area = lambda c: F.exists(areas, lambda a: (a == c) | a.contains(c) | (c.contains(a) & (F.char_length(c) - F.char_length(a) <= 1)))
    kept = F.filter(marked, lambda m: (F.char_length(m["core"]) >= 2) & ~m["core"].isin(*generic) & ~is_area(m["core"]))
    is_number = lambda m: F.rlike(m["core"], F.lit("^[0-9]+$"))
    return bound(kept, lambda k: bound(_rather(k, lambda m: m["branch"]), lambda own: F.transform(_rather(own, is_number), lambda m: m["core"])))


def split_scripts(word: Column, scripts: tuple[str, str]) -> Column:
    """The parts of a word between two scripts, given as character classes: a name written together with a foreign addition."""
    a, b = scripts
    apart = F.regexp_replace(F.regexp_replace(word, f"({a})({b})", "$1 $2"), f"({b})({a})", "$1 $2")
    return F.split(apart, " ")


def word_signals(name: Column, areas: Column, generic: tuple[str, ...], suffix: str, branch: str, venue: str, scripts: tuple[str, str]) -> Column:
    """(words, venue_only, venue_left_out) of a name.

    ``words`` are found as by ``distinctive_words``, but words are also parted between ``scripts`` (a branch mark holds for all
    parts of its word), marks at their ends go, and words of the ``venue`` pattern (buildings and sights that many share)
    count only where nothing else is left: then ``venue_only`` is true and a text should name the whole entity.
    ``venue_left_out`` says that the name has such a word which does not count, so a text about the sight is not enough.
    """
    blank = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[ \t]+"), lambda w: w != "")
    parts = F.flatten(F.transform(blank, lambda w: F.transform(split_scripts(w, scripts), lambda p: F.struct(p.alias("raw"), F.rlike(w, F.lit(branch)).alias("branch")))))
    core = lambda raw: F.regexp_replace(F.regexp_replace(raw, "[,.;:]+$", ""), suffix, "")
    is_area = lambda c: F.exists(areas, lambda a: (a == c) | a.contains(c) | (c.contains(a) & (F.char_length(c) - F.char_length(a) <= 1)))
    kept = lambda ps: F.filter(F.transform(ps, lambda m: F.struct(m["raw"].alias("raw"), core(m["raw"]).alias("core"), m["branch"].alias("branch"))), lambda m: (F.char_length(m["core"]) >= 2) & ~m["core"].isin(*generic) & ~is_area(m["core"]))
    is_venue = lambda m: F.rlike(m["raw"], F.lit(venue)) | F.rlike(m["core"], F.lit(venue))

    def signals(ps: Column, pool: Column, final: Column) -> Column:
        strong = _rather(final, lambda m: F.rlike(m["core"], F.lit("^[0-9]+$")))
        only = (F.size(pool) > 0) & F.forall(pool, is_venue)
        left_out = F.exists(ps, lambda m: F.rlike(m["raw"], F.lit(venue))) & (F.size(final) > 0) & ~F.exists(final, is_venue)
        return F.struct(F.transform(strong, lambda m: m["core"]).alias("words"), only.alias("venue_only"), left_out.alias("venue_left_out"))

    by_pool = lambda ps, pool: bound(_rather(pool, is_venue), lambda final: signals(ps, pool, final))
    return bound(parts, lambda ps: bound(kept(ps), lambda k: bound(_rather(k, lambda m: m["branch"]), lambda pool: by_pool(ps, pool))))


def names_entity(text: Column, name: Column, words: Column, context: str) -> Column:
    """Whether a text names an entity: its whole name of four letters or more, blanks aside, or a distinctive word at the
    beginning of a word. A name without distinctive words also needs the ``context`` pattern."""
    whole = (F.char_length(tx.normal_name(name)) >= 4) & F.contains(tx.normal_name(text), tx.normal_name(name))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.size(words) == 0, whole & F.rlike(F.lower(text), F.lit(context))).otherwise(whole | F.exists(words, lambda w: F.contains(spaced, F.concat(F.lit(" "), w))))


def coherence(entities: DataFrame, texts: DataFrame, key: str, context: str) -> DataFrame:
    """(key, quotes, coherence): the share of an entity's texts that name it, one where it has none.

    ``entities`` has (key, name, words), ``texts`` (key, text)."""
    hit = names_entity(F.col("text"), F.col("name"), F.col("words"), context)
    named = texts.where(F.coalesce("text", F.lit("")) != "").join(entities, key).groupBy(key).agg(F.count("*").alias("quotes"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("coherence"))
    return entities.select(key).join(named, key, "left").select(key, F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("coherence", F.lit(1.0)).alias("coherence"))


def quote_confidence(text: Column, name: Column, words: Column, weak: tuple[str, ...], context: str) -> Column:
    """1 where a quote surely speaks of the entity, else 0: its whole name, or a distinctive word that is no weak one.

    A name that is one short or weak word must stand there whole, with the ``context`` beside it."""
    plain, squeezed = tx.normal_name(name), tx.normal_name(text)
    sole = (F.size(words) == 1) & (F.get(words, F.lit(0)) == plain)
    all_weak = F.forall(words, lambda w: w.isin(*weak) | F.rlike(w, F.lit("^[0-9]+$")) | (F.char_length(w) <= 2))
    bare = sole & (all_weak | (F.char_length(plain) <= 4))
    whole = (F.char_length(plain) >= 4) & F.contains(squeezed, plain)
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    by_word = F.exists(words, lambda w: F.contains(spaced, F.concat(F.lit(" "), w)))
    sure = F.when(bare, (F.char_length(plain) >= 2) & F.contains(squeezed, plain) & F.rlike(F.lower(text), F.lit(context))).when(~sole & whole, True).when(all_weak | (F.size(words) == 0), False).otherwise(by_word)
    return F.coalesce(sure, F.lit(False)).cast("int")


# ---------------------------------------------------------------- addresses


def province_of(address: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The province whose prefix an address begins with: a CASE made from an ordered list."""
    out = F.lit(None).cast("string")
    for prefix, province in reversed(prefixes):
        out = F.when(address.startswith(prefix), F.lit(province)).otherwise(out)
    return out


def address_parts(df: DataFrame, key: str, address: str, gazetteer: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """(key, province, district, dong) of addresses; ``gazetteer`` has (province, district).

    The first district word that the address's own province has counts. Without a readable province a district name counts
    if just one province has it. The dong follows a district word.
    """
    at = F.coalesce(F.col(address), F.lit(""))
    own = df.select(key, province_of(F.trim(at), prefixes).alias("own"), F.regexp_extract_all(at, F.lit("([가-힣]+(?:구|시|군))(?:[^가-힣]|$)"), F.lit(1)).alias("words"), F.regexp_extract(at, "(?:구|시|군) +([가-힣]+[0-9]?(?:동|읍|면|가))(?:[^가-힣]|$)", 1).alias("dong"))
    only = gazetteer.groupBy("district").agg(F.count_distinct("province").alias("provinces"))
    known = gazetteer.join(only, "district")
    words = own.select(key, "own", F.posexplode("words").alias("no", "district")).join(known, "district").where((F.col("province") == F.col("own")) | (F.col("own").isNull() & (F.col("provinces") == 1)))
    first = words.groupBy(key).agg(F.min_by(F.struct("province", "district"), "no").alias("f"))
    return own.join(first, key, "left").select(key, F.coalesce("own", "f.province").alias("province"), F.col("f.district").alias("district"), F.nullif("dong", F.lit("")).alias("dong"))


def region_of_query(words: Column, kinds: list[tuple[str, dict[str, str]]], tails: str) -> Column:
    """(kind, region) of the words of a search: the first kind of region, in order, one of whose names is a word; else the
    longest name that a word begins with, where one of the ``tails`` of a place follows. ``kinds`` maps names to regions."""
    lists = [(kind, F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("region")) for n, r in sorted(names.items())])) for kind, names in kinds]
    exact = [F.get(F.filter(pairs, lambda p: F.array_contains(words, p["name"])), F.lit(0))["region"] for _, pairs in lists]
    out = F.lit(None).cast("struct<kind:string,region:string>")
    every = F.array(*[F.struct(F.lit(len(n)).alias("n"), F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.lit(r).alias("region")) for kind, names in kinds for n, r in names.items()])
    glued = F.array_max(F.filter(every, lambda p: F.exists(words, lambda w: w.startswith(p["name"]) & F.rlike(F.substring(w, p["n"] + 1, F.char_length(w)), F.lit(f"^(?:{tails})")))))
    out = F.when(glued.isNotNull(), F.struct(glued["kind"].alias("kind"), glued["region"].alias("region")))
    for (kind, _), region in reversed(list(zip(lists, exact, strict=True))):
        out = F.when(region.isNotNull(), F.struct(F.lit(kind).alias("kind"), region.alias("region"))).otherwise(out)
    return out


# ---------------------------------------------------------------- ordered rules


@dataclass(frozen=True)
class TextRule:
    """One row of a rule table. ``field`` is a column, ``unless`` a pattern over the same column that lifts the rule.

    ``action`` is ``reject`` (final, with ``score``), ``hold`` (rejected, open to a later decision) or ``cap`` (at most
    ``score``, and reference at best)."""

    stage: str
    name: str
    field: str
    pattern: str
    action: str
    score: int = 0
    unless: str | None = None

    def holds(self) -> Column:
        out = F.coalesce(F.rlike(F.col(self.field), F.lit(self.pattern)), F.lit(False))
        return out & ~F.coalesce(F.rlike(F.col(self.field), F.lit(self.unless)), F.lit(False)) if self.unless else out

    def sql(self) -> str:
        """``holds`` in DuckDB."""
        quoted = lambda p: "'" + p.replace("'", "''") + "'"
        out = f"coalesce(regexp_matches({self.field}, {quoted(self.pattern)}), false)"
        return f"({out} AND NOT coalesce(regexp_matches({self.field}, {quoted(self.unless)}), false))" if self.unless else out


def apply_rules(df: DataFrame, rules: list[TextRule], verdict: str = "verdict", score: str = "score") -> DataFrame:
    """``df`` with verdict and score after the first rule, in order, that holds; adds rule, stage and borderline.

    The table may be of any length: it becomes one CASE, of which a row evaluates no more than up to its rule.
    """
    chosen = F.lit(None).cast("struct<stage:string,name:string,action:string,score:int>")
    for r in reversed(rules):
        chosen = F.when(r.holds(), F.struct(F.lit(r.stage).alias("stage"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.score).alias("score"))).otherwise(chosen)
    found = df.withColumn("__rule", chosen)
    action, capped = F.col("__rule.action"), F.col("__rule.action") == "cap"
    out_verdict = F.when(action.isin("reject", "hold"), "rejected").when(capped & (F.col(verdict) == "verified"), "reference").otherwise(F.col(verdict))
    out_score = F.when(action.isin("reject", "hold"), F.col("__rule.score")).when(capped, F.least(F.col(score), F.col("__rule.score"))).otherwise(F.col(score))
    return found.withColumns({verdict: out_verdict, score: out_score, "rule": F.col("__rule.name"), "stage": F.col("__rule.stage"), "borderline": F.coalesce(action == "hold", F.lit(False))}).drop("__rule")
