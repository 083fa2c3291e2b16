"""One query per operator, over whole tables, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm import archive, bpe, compression, merkle, mixing, neighbours, quotes, simhash, spelling, token_files, toxicity, url_rules, vector_codes
from scour.llm.ordering import with_positions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def case(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: quotation linking -------------------------------------------------------------------------


QUOTES_SQL = r"""
WITH RECURSIVE lines AS (
    SELECT conv_id, turn, i, regexp_extract(parts[i], '^(?:[ \t]{0,3}>)+') AS marks,
        regexp_replace(parts[i], '^(?:[ \t]{0,3}>)+[ \t]?', '') AS content
    FROM (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS parts
        FROM conversations) s, unnest(range(1, len(s.parts) + 1)) AS t(i)),
leveled AS (
    SELECT *, lag(level) OVER message AS last_level, lag(content) OVER message AS last_content,
        lead(level) OVER message AS next_level
    FROM (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level FROM lines)
    WINDOW message AS (PARTITION BY conv_id, turn ORDER BY i)),
own AS (
    SELECT conv_id, turn, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (
        level = 0 AND NOT (coalesce(next_level, 0) > 0 AND regexp_matches(content,
            '(?i)^[ \t]*(on\b.*\bwrote|.*\bwrites):[ \t]*$'))), ''),
        '^(?:[ \t]*\n)+|\s+$', '', 'g') AS own_text
    FROM leveled GROUP BY conv_id, turn),
cut AS (
    SELECT *, count(*) FILTER (last_level IS NULL OR level <> last_level OR trim(last_content) = '')
        OVER (PARTITION BY conv_id, turn ORDER BY i) AS passage
    FROM leveled),
passages AS (
    SELECT conv_id, turn, passage, level, string_agg(content, chr(10) ORDER BY i) AS body
    FROM cut GROUP BY conv_id, turn, passage, level HAVING trim(body) <> ''),
units AS (
    SELECT conv_id, turn, passage, level, true AS whole, body AS part FROM passages
    UNION ALL SELECT conv_id, turn, passage, level, false, unnest(string_split(body, chr(10))) FROM passages),
spoken AS (
    SELECT conv_id, turn, passage, level, whole, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS words
    FROM units WHERE trim(part) <> ''),
said AS (SELECT conv_id, words, min(turn) AS origin FROM spoken WHERE level = 0 GROUP BY ALL),
links AS (
    SELECT q.conv_id, q.turn, q.passage, q.level, max({'whole': whole, 'origin': origin}).origin AS origin
    FROM spoken q JOIN said USING (conv_id, words) WHERE q.level > 0 AND origin < q.turn GROUP BY ALL),
linked AS (
    SELECT conv_id, turn, max({'level': -level, 'origin': origin}).origin AS origin, count(*) AS linked
    FROM links GROUP BY ALL),
replies AS (
    SELECT m.conv_id, m.turn, coalesce(origin, previous) AS reply_to, coalesce(linked, 0) AS linked
    FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
        FROM conversations) m LEFT JOIN linked USING (conv_id, turn)),
walk AS (
    SELECT conv_id, turn, [turn] AS path FROM replies WHERE reply_to IS NULL
    UNION ALL SELECT r.conv_id, r.turn, list_append(path, r.turn)
    FROM replies r JOIN walk w ON r.conv_id = w.conv_id AND r.reply_to = w.turn),
placed AS (
    SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM walk)
SELECT m.conv_id, m.turn, m.role, reply_to, position, linked, own_text, (
    SELECT count(*) FROM passages p WHERE p.conv_id = m.conv_id AND p.turn = m.turn AND level > 0) AS quotes
FROM conversations m JOIN replies USING (conv_id, turn) JOIN placed USING (conv_id, turn)
JOIN own USING (conv_id, turn)
"""


@case("op1_quotation_links", QUOTES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations_without_quotes(table(spark, sf_dir, "conversations"))


# --- 2: BPE ---------------------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"


@case("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.transcode(documents, public_tokenizers.path(TOKENIZER))
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# --- 3: mixing sources ----------------------------------------------------------------------------

WEIGHTS = (5, 2, 1)

MIX_SQL = r"""
WITH sized AS (
    SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
            WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight
    FROM totals),
-- Sources in the order in which a rising level reaches their limits.
stepped AS (
    SELECT *, coalesce(sum(cap) OVER below, 0) AS kept,
        sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open
    FROM weighed
    WINDOW below AS (ORDER BY cap / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
    SELECT arg_min((1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - kept) / open, cap / weight) AS level
    FROM stepped
    WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM totals) - kept) / open < cap / weight),
targets AS (
    SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels), 'inf'::DOUBLE) * weight) AS target
    FROM weighed)
SELECT s.doc_id, s.size, t.source_size, t.target,
    s.size * (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) AS taken
FROM (
    SELECT s.*, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
        / 4503599627370496.0::DOUBLE AS coin
    FROM sized s) s
JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets) t
    ON s.source IS NOT DISTINCT FROM t.source
"""


def source_weights(documents: DataFrame, cycle: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The cycle of weights over the sources by code point, null last."""
    sources = documents.select("source").distinct()
    ranked = with_positions(sources.where("source IS NOT NULL"), "source")
    last = sources.where("source IS NULL").crossJoin(
        ranked.agg(F.count(F.lit(1)).alias("position"))
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in cycle]), (F.col("position") % len(cycle) + 1).cast("int")
    )
    return ranked.unionByName(last).select("source", weight.alias("weight"))


@case("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixing.mix(documents, source_weights(documents)).select(
        "doc_id",
        "mix.size",
        "mix.source_size",
        "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
    )


# --- 4: fingerprints ------------------------------------------------------------------------------


@case("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(table(spark, sf_dir, "documents"))


# --- 5: URL filters -------------------------------------------------------------------------------

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

URL_SQL = r"""
WITH rules(action, rule_host, rule_path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
        ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rests AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0
        THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages),
parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
    FROM rests)
SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    coalesce(arg_max(action, length(rule_host || rule_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path
"""


@case("op5_url_filters", URL_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, URL_RULES)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


# --- 6: SimHash ---------------------------------------------------------------------------------


@case("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id",
        simhash.as_hex(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


# --- 7: token files -------------------------------------------------------------------------------

END_ID = 2


@case("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID
    )
    return token_files.read_token_files(spark, files).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


# --- 8: quality classifier ------------------------------------------------------------------------


def held_out(key: str = "doc_id"):
    """Whether the labels of a document are not to be learned from."""
    remainder = F.crc32(F.col(key).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def fit_quality(spark: SparkSession, documents: DataFrame, sf_dir: str) -> compression.Model | None:
    return compression.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))


@case("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = compression.score(documents, fit_quality(spark, documents, sf_dir))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


# --- 9: nearest neighbours ------------------------------------------------------------------------


@case("op9_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0
    )


# --- 10: WARC -------------------------------------------------------------------------------------

WARC_SQL = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages),
coded AS (
    SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::INT) AS parts
    FROM hashed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
    array_to_string(list_transform(parts, lambda v:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM coded
"""


@case("op10_warc", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = archive.write_archive(table(spark, sf_dir, "pages"))
    return archive.read_captures(spark, written).select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


# --- 11: spelling variants ------------------------------------------------------------------------

SPELLING_SQL = r"""
WITH RECURSIVE steps AS (
    SELECT i AS byte, 0 AS step, i::BIGINT AS rest FROM range(256) t(i)
    UNION ALL SELECT byte, step + 1,
        CASE WHEN rest % 2 = 1 THEN xor(rest >> 1, 3988292384::BIGINT) ELSE rest >> 1 END
    FROM steps WHERE step < 8),
crc_table AS (SELECT list(rest ORDER BY byte) AS codes FROM steps WHERE step = 8),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            range(octet_length(encode(doc || ':' || run))), lambda i:
            ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(codes[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h
    FROM runs, crc_table),
spoiled AS (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT)
        || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
    FROM hashed),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM spoiled WHERE length(word) >= 6
    GROUP BY word HAVING sum(times) >= 5),
cuts AS (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words),
without AS (
    SELECT DISTINCT word, n, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM cuts),
-- One letter blanked out at the same place: replaced. One letter left out: inserted or deleted.
pairs AS (
    SELECT a.word, b.word AS other, b.n
    FROM (SELECT *, substr(word, 1, place - 1) || ' ' || substr(word, place + 1) AS blank FROM cuts) a
    JOIN (SELECT *, substr(word, 1, place - 1) || ' ' || substr(word, place + 1) AS blank FROM cuts) b
        ON a.blank = b.blank AND a.word <> b.word
    UNION ALL SELECT l.word, s.word, s.n FROM without l JOIN words s ON l.rest = s.word
    UNION ALL SELECT s.word, l.word, l.n FROM without l JOIN words s ON l.rest = s.word),
best AS (
    SELECT word, count(*) AS n_near, min({'rank': -n, 'other': other}) AS best FROM pairs GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
        CASE WHEN -best.rank >= 5 * w.n THEN best.other END AS form,
        CASE WHEN -best.rank >= 5 * w.n THEN -best.rank END AS form_n
    FROM words w LEFT JOIN best USING (word)),
chains AS (
    SELECT word, word AS place, 0 AS step FROM forms
    UNION ALL SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON c.place = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

#: One in so many occurrences loses a letter.
SPOILED = 199


def spoiled_words(documents: DataFrame) -> DataFrame:
    """The runs of letters of all texts, some of them with a letter left out. A null id is empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # Shorter runs make no word of six letters.
    runs = F.regexp_extract_all("text", F.lit(r"([A-Za-z\u00C0-\u00FF]{6,})"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    return (
        documents.select("doc_id", F.explode(runs).alias("run"))
        .withColumn("run", F.translate("run", upper, lower))
        .select("run", F.crc32(name.cast("binary")).alias("h"))
        .select(
            F.when(
                F.col("h") % SPOILED == 0,
                F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))"),
            )
            .otherwise(F.col("run"))
            .alias("word")
        )
    )


@case("op11_spelling_variants", SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spelling.count_words(spoiled_words(table(spark, sf_dir, "documents")), 6, 5)
    return spelling.spelling_variants(counted).select("word", "form", "root", "n", "n_near", "form_n")


# --- 13: vector codes -----------------------------------------------------------------------------


@case("op13_vector_codes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(coded.rows).select(
        F.col("key").alias("vec_id"),
        vector_codes.as_hex(F.col("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(vector_codes.digest(coded.codebooks)).alias("codebooks_sha256"),
    )


# --- 12: toxicity ---------------------------------------------------------------------------------


@case("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
