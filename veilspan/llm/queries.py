"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import ann, bpe, chat, content_sort, line_dedup, mixing, phrases, pii, runs, simhash, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    span = F.transform("masks", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return out.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join(span, ",").alias("masks"))


ORACLE["op1_chat_formatting"] = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part, turn,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS said
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
pieces AS (
  SELECT t.*, speaker, role = speaker AS mine,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
      WHEN role = speaker THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head,
    replace(replace(said, '<|', '< |'), '|>', '| >') || '<|end|>' || chr(10) AS body
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, said) AS stop FROM pieces)
SELECT conv_id, speaker, part, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, said) AS text,
  coalesce(string_agg((stop - length(body))::BIGINT || ':' || (stop - 1)::BIGINT, ','
    ORDER BY turn NULLS FIRST, role, said) FILTER (WHERE mine), '') AS masks
FROM placed GROUP BY conv_id, speaker, part
"""


@register
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE["op2_exact_topk"] = """
WITH ints AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path(PIECES))


@register
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    return bpe.round_trip(_table(spark, sf_dir, "documents"), path(RANKS), PATTERN)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")), ~held_out())


@register
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


@register
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(entropy=0.95, max_repeats=4.0)
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), mix)


@register
def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), with_text=False)


ORACLE["op8_line_dedup"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.last AS gone FROM keyed l LEFT JOIN hot h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def span_text(spans: str) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    order = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("k"),
            F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(order), lambda s: s["t"]), ",")


@register
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = pii.find_personal_data(docs, pii.fit(docs)).withColumn("all", F.concat("spans", "added"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(span_text("spans"), 256).alias("base_sha256"),
        span_text("all").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@register
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.approximate_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Of every tenth document by crc32 of its id, words from a place on become repeats of the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        at = F.transform(place, lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    # one element, so that the words are split once
    tail = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, tail).otherwise(F.col("text")).alias("text"))


@register
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))

    def stronger(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("best", F.aggregate("runs", none, stronger)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM split),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM placed CROSS JOIN (VALUES (1), (2), (3)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= 10),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS k1 FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.k1, l.a AS l, r.a AS r,
    (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k1], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k1 + 1:], ' ')),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k1) = 1),
longer AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a
  FROM candidates WHERE k = 3),
kept AS (
  SELECT * FROM weakest x WHERE NOT EXISTS (
    SELECT 1 FROM longer y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.a >= 50 * x.a)),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register
def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_copies(_table(spark, sf_dir, "documents"))


ORACLE["op13_content_sort"] = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM texts
"""
