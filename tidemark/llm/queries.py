"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, collocations, language_id, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, spelling, substrings, topk, toxicity
from tidemark.llm.common import split_remainder, table

#: The vocabulary of the packing query.
VOCABULARY = "word_bpe_49k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


OP1_SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, {_LINES} AS ls FROM documents),
win AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM base WHERE len(ws) >= 5)
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, text, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         {_count('[#*$%&|<>]')}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)
),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * {_count('[A-Z]')} > 4 * {_count('[A-Za-z]')}
            OR 10 * {_count('!')} > 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * len(ls)) AS kept
FROM f
"""


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "part", "chunk", "pos", "turn", "role", "repaired_role", "action", "inserted", "segment")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def learn_lang(doc_id: Column) -> Column:
    return split_remainder(doc_id, 4) != 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    models = language_id.learn_models(docs, learn_lang)
    out = language_id.identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", (~learn_lang(F.col("doc_id"))).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents").select("doc_id", "text"), lambda i: split_remainder(i, 3) != 1
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), learn)
    return out.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "toxicity.score", "toxicity.predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mixing.topic").alias("topic"), F.round("mixing.prob", 6).alias("prob"), F.col("mixing.sampled").alias("sampled"))


def _sql_filled(source: str, group: str, bound: str, value: str, goal: str, keep: str) -> str:
    """``value`` of a subquery scaled in each group so that the sum of least(bound, value) is the goal; columns ``keep`` and value."""
    return f"""SELECT {keep}, CASE WHEN reach IS NULL THEN 0.0 ELSE {value} * greatest(CASE WHEN open > 0 THEN rest / open END, lowest) END AS {value} FROM (
      SELECT *, {goal} - coalesce(sum(CASE WHEN filled THEN {bound} END) OVER (PARTITION BY {group}), 0) AS rest,
             sum(CASE WHEN reach IS NOT NULL AND NOT filled THEN {value} END) OVER (PARTITION BY {group}) AS open, max(CASE WHEN filled THEN reach END) OVER (PARTITION BY {group}) AS lowest
      FROM (SELECT *, reach IS NOT NULL AND sum_b + reach * (sum(CASE WHEN reach IS NULL THEN 0 ELSE {value} END) OVER (PARTITION BY {group}) - sum_v) <= {goal} AS filled
        FROM (SELECT *, sum(CASE WHEN reach IS NULL THEN 0 ELSE {bound} END) OVER (PARTITION BY {group} ORDER BY reach) AS sum_b,
                     sum(CASE WHEN reach IS NULL THEN 0 ELSE {value} END) OVER (PARTITION BY {group} ORDER BY reach) AS sum_v
          FROM (SELECT *, CASE WHEN {bound} > 0 AND {value} > 0 THEN {bound} / {value} END AS reach FROM ({source})))))"""


def _op6_sql() -> str:
    margins, keys = mixing.MARGINS, ", ".join(mixing.MARGINS)
    shares = ",\n".join(
        f"share_{m} AS (SELECT {m}, corpus * pow(t, {mixing.FLATTEN}) / sum(pow(t, {mixing.FLATTEN})) OVER () AS goal, t / {mixing.KEEP_SHARE} AS held FROM (SELECT {m}, any_value(corpus) AS corpus, sum(tokens) AS t FROM cells GROUP BY {m}))"
        for m in margins
    )
    goals = ",\n".join(
        f"goal_{m} AS (SELECT {m}, least(held, goal) AS goal_{m} FROM ("
        + _sql_filled(f"SELECT *, 1 AS one, least(sum(goal) OVER (), sum(held) OVER ()) AS whole FROM share_{m}", "one", "held", "goal", "whole", f"{m}, held")
        + "))"
        for m in margins
    )
    columns = f"{keys}, tokens, corpus, bound, " + ", ".join(f"goal_{m}" for m in margins)
    one_round = "SELECT * FROM fit WHERE more"
    for m in margins:
        one_round = _sql_filled(one_round, m, "bound", "free", f"goal_{m}", f"n, {columns}")
    off = "greatest(" + ", ".join(f"abs(sum(least(bound, free)) OVER (PARTITION BY {m}) - goal_{m}) / corpus" for m in margins) + ")"
    draw = f"('0x' || substr(md5('{mixing.SALT}' || doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r}"
    prob = f"least(1.0, {mixing.KEEP_SHARE} * least(bound, free) / last.tokens)"
    return rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table'
              WHEN length(text) < 80 * (length(text) - length(replace(text, chr(10), '')) + 1) THEN 'lines'
              WHEN length(text) >= 3000 THEN 'long' ELSE 'short' END AS topic,
         greatest(len({_WORDS}), 1)::BIGINT AS tokens
  FROM documents
),
cells AS (SELECT {keys}, sum(tokens)::DOUBLE AS tokens, sum(sum(tokens)) OVER ()::DOUBLE AS corpus FROM docs GROUP BY {keys}),
{shares},
{goals},
start AS (SELECT {keys}, tokens, corpus, tokens / {mixing.KEEP_SHARE} AS bound, {", ".join(f"goal_{m}" for m in margins)}, tokens AS free FROM cells {" ".join(f"JOIN goal_{m} USING ({m})" for m in margins)}),
fit AS (
  SELECT 0 AS n, {columns}, free, true AS more FROM start
  UNION ALL
  SELECT n + 1, {columns}, free, n + 1 < {mixing.ROUNDS} AND ((n + 1) % {mixing.CHECK_ROUNDS} <> 0 OR max(off) OVER () > {mixing.TOLERANCE!r}) AS more
  FROM (SELECT *, {off} AS off FROM ({one_round}))
),
last AS (SELECT * FROM fit WHERE NOT more)
SELECT doc_id, docs.topic AS topic, round({prob}, 6) AS prob, {draw} < {prob} AS sampled
FROM docs JOIN last USING ({keys})
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = table(spark, sf_dir, "documents").select("doc_id", "text"), lambda i: split_remainder(i, 4) != 2
    out = quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), learn)
    return out.select("doc_id", (~learn(F.col("doc_id"))).alias("held_out"), "quality_score.score", "quality_score.predicted")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("line_dedup.text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ls AS (
  SELECT r, doc_id, i, l, translate(trim(l, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d)
),
hot AS (SELECT k, max(doc_id) AS keeper FROM ls WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'row ' || r)) >= 3),
marked AS (SELECT ls.*, hot.k IS NOT NULL AND (keeper IS NULL OR doc_id IS NULL OR keeper <> doc_id) AS gone FROM ls LEFT JOIN hot USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: CRC-32 of a list of bytes: one step of the reflected polynomial for each bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b:
    list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT id, w, count(*) AS c FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{spelling.MIN_LETTERS},}}')), '{spelling.UPPER}', '{spelling.LOWER}') AS w
    FROM documents) GROUP BY ALL
),
hashed AS (
  SELECT w, c, {_CRC} AS h
  FROM (SELECT w, c, list_transform(flatten(list_transform(string_split(id || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)), lambda x: x::BIGINT) AS bytes FROM runs)
),
cut AS (SELECT CASE WHEN h % {spelling.SLIP} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
keys AS (
  SELECT DISTINCT word, n, k FROM (
    SELECT word, n, word AS k FROM words
    UNION ALL SELECT word, n, substr(word, 1, i) || substr(word, i + 2) FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS i FROM words))
),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b USING (k) 
         WHERE a.word <> b.word AND (length(a.word) <> length(b.word) OR len(list_filter(list_zip(string_split(a.word, ''), string_split(b.word, '')), lambda z: z[1] <> z[2])) = 1)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top, min(CASE WHEN rk = 1 THEN other END) AS other
         FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS rk FROM near) GROUP BY word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= {spelling.TIMES} * words.n THEN other END AS form, CASE WHEN top >= {spelling.TIMES} * words.n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS root, 1 AS step FROM forms WHERE form IS NOT NULL UNION ALL SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT word, max_by(root, step) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n::BIGINT AS form_n FROM forms LEFT JOIN ends USING (word)
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + {substrings.WINDOW - 1}), ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) AS i FROM d WHERE len(ws) >= {substrings.WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + k AS p FROM twice, range({substrings.WINDOW}) AS t(k)),
w AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT w.r, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS t FROM w ANTI JOIN gone ON w.r = gone.r AND w.p = gone.p GROUP BY w.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _op13_sql() -> str:
    most, joined = collocations.MAX_WORDS, lambda a, b: f"array_to_string(list_slice(ws, {a}, {b}), ' ')"
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS words, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: {joined('i', f'i + {n - 1}')})) AS phrase FROM pieces WHERE len(ws) >= {n}" for n in range(1, most + 1))
    inner = " UNION ALL ".join(f"SELECT lang, {joined(a, a + n - 1)} AS phrase, a FROM cand WHERE words > {n} AND {a + n - 1} <= words" for n in range(2, most) for a in range(1, most - n + 2))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, {joined(1, k)} AS x, {joined(k + 1, 'words')} AS y FROM left_over WHERE words > {k}" for k in range(1, most))
    return rf"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, '{collocations.NO_LANG}') AS lang, text FROM documents)
),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE words > 1 AND f >= {collocations.MIN_COUNT}),
longer AS (SELECT lang, phrase, max(a) AS most FROM ({inner}) GROUP BY ALL),
left_over AS (SELECT cand.* FROM cand LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < {collocations.COVERED} * a::HUGEINT),
scored AS (
  SELECT lang, c.phrase, a, k, p.f AS l, q.f AS r, (({collocations.SCALE}::HUGEINT * a) // (p.f + q.f)::HUGEINT)::BIGINT AS score
  FROM ({cuts}) c JOIN counts p USING (lang) JOIN counts q USING (lang) WHERE p.phrase = c.x AND q.phrase = c.y
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_chat_format": op2_chat_format,
    "op3_simhash": op3_simhash,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_exact_topk": op7_exact_topk,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {"op1_quality_rules": OP1_SQL, "op6_source_mixing": _op6_sql(), "op7_exact_topk": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_phrase_collocations": _op13_sql()}
