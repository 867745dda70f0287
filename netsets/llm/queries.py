"""The registered queries of the training-data operators, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from netsets.llm.common import read
from netsets.llm.decontaminate import benchmark_hits
from netsets.llm.exact_dedup import exact_duplicates
from netsets.llm.license_scan import BLANK_LINE, GAP, LINE_END, LINES, NOTICE, OWN_MARKS, PROPRIETARY, RULES, SENTENCE_END, SENTENCES, license_scan, rule_pattern
from netsets.llm.mixing import mix
from netsets.llm.pii import personal_data
from netsets.llm.secrets import secrets
from netsets.llm.simhash import near_duplicates
from netsets.llm.tokens import token_output
from netsets.llm.toxicity import toxicity
from netsets.llm.url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"), keep="largest")


ORACLES["op7_exact_dedup"] = """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op9_mix_sources"] = r"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
        FROM documents),
    per_source AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
        FROM sized GROUP BY source),
    -- each round fills the sources that their share would overfill and shares what is left among the rest
    rounds AS (
        SELECT source, source_size, weight, FALSE AS filled, 0 AS round,
               1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS left_words, (sum(weight) OVER ())::DOUBLE AS left_weight
        FROM per_source
        UNION ALL
        SELECT source, source_size, weight, now_filled, round + 1,
               1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                   - coalesce(sum(CASE WHEN now_filled THEN 2 * source_size END) OVER (), 0)::DOUBLE,
               coalesce(sum(CASE WHEN now_filled THEN 0 ELSE weight END) OVER (), 0)::DOUBLE
        FROM (SELECT *, filled OR weight * (left_words / left_weight) >= 2 * source_size AS now_filled FROM rounds
              WHERE round < 40 AND left_weight > 0)),
    targets AS (
        SELECT source, source_size,
               CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE weight * (left_words / left_weight) END AS target
        FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
    -- an own weight is the binary length of the size; in the order of falling weight the stopped ones come first
    step AS (
        SELECT source, own, sum(size)::BIGINT AS words FROM (SELECT source, size, len(bin(size)) AS own FROM sized WHERE size > 0) GROUP BY source, own),
    level AS (
        SELECT source, own,
               (target - 2 * coalesce(sum(words) OVER above, 0)) / (sum(words * own) OVER (PARTITION BY source) - coalesce(sum(words * own) OVER above, 0)) AS rate
        FROM step JOIN targets USING (source)
        WINDOW above AS (PARTITION BY source ORDER BY own DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    rates AS (
        SELECT source, coalesce(arg_max(rate, own) FILTER (rate * own < 2), max(rate)) AS rate FROM level GROUP BY source),
    ratios AS (
        SELECT doc_id, source, size, u, source_size, target,
               CASE WHEN size > 0 THEN least(rate * len(bin(size)), 2.0::DOUBLE) ELSE 0 END AS copies
        FROM sized JOIN targets USING (source) LEFT JOIN rates USING (source)),
    ranked AS (
        SELECT *, floor(copies) AS whole, copies - floor(copies) AS pi,
               (u / (1 - u)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) AS rank
        FROM ratios),
    run AS (
        SELECT *, sum(CASE WHEN pi > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS through,
               target - sum(whole * size) OVER (PARTITION BY source) AS need
        FROM ranked)
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN pi > 0 AND size > 0 AND through - size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM run
"""


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op5_decontaminate"] = r"""
    WITH doc AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
        FROM documents),
    item AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
        FROM benchmark),
    pattern AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
    place AS (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
              FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
    met AS (SELECT doc_id, item_id, place.n, i FROM place JOIN pattern USING (n, key)),
    hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY doc_id),
    found AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM met) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")]
    found = secrets(read(spark, sf_dir, "documents"), vocabularies=words)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "guesses")


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_ssn", "scores")


#: Parameters of the registered query: host and path rules, and the listed domains.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
LISTED_DOMAINS = [
    f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")
]


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return judge_urls(read(spark, sf_dir, "pages"), listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op3_url_filter"] = f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    part AS (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM rest),
    ruled AS (
        SELECT page_id, host, path,
               CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                    WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                    WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                    WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
        FROM part)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                WHEN {" OR ".join(f"('.' || host) LIKE '%.{d}'" for d in LISTED_DOMAINS)} THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled
"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("places")


def _license_oracle() -> str:
    """Candidates (each end of a sentence that begins with a line, and each line) joined to the known sentences; the rules one after the other."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, {quoted(name)}, {quoted(rule_pattern(sequence, GAP))})" for k, (name, sequence) in enumerate(RULES, 1))
    normal = rf"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '[^a-z0-9\x01]+', ' ', 'g'), '\x01', '.', 'g')), '{NOTICE}', 'under ')"""
    return rf"""
    WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
    rules(k, name, pattern) AS (VALUES {rules}),
    plain AS (
        SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{OWN_MARKS}', ' ', 'g'), '{LINE_END}', chr(10), 'g') AS t FROM documents),
    ended AS (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(t, '{BLANK_LINE}', chr(2), 'g'), '{SENTENCE_END}', chr(2) || '\1', 'g'), chr(2)) AS sentences FROM plain),
    sentence AS (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS place FROM ended),
    lined AS (SELECT doc_id, place, list_filter(string_split(s, chr(10)), lambda l: regexp_matches(l, '[A-Za-z0-9]')) AS lines FROM sentence),
    candidate AS (
        SELECT doc_id, place, i, TRUE AS whole, array_to_string(lines[i:], ' ') AS raw
        FROM (SELECT *, unnest(range(greatest(len(lines) - {LINES - 1}, 1), len(lines) + 1)) AS i FROM lined)
        UNION ALL
        SELECT doc_id, place, i, FALSE, lines[i] FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM lined)),
    met AS (
        SELECT doc_id, place, i, whole, id FROM (SELECT doc_id, place, i, whole, {normal} AS sentence FROM candidate) JOIN known USING (sentence)),
    ends AS (SELECT doc_id, place, min(i) AS first_i FROM met WHERE whole GROUP BY doc_id, place),
    counted AS (
        SELECT doc_id, place, i, id FROM met LEFT JOIN ends USING (doc_id, place)
        WHERE (whole AND i = first_i) OR (NOT whole AND i < coalesce(first_i, i + 1))),
    seq AS (SELECT doc_id, string_agg(id, ' ' ORDER BY place, i) AS seq FROM counted GROUP BY doc_id),
    run AS (
        SELECT doc_id, 0 AS k, seq || ' ' AS left_over, CAST([] AS VARCHAR[]) AS names, 0::BIGINT AS n FROM seq
        UNION ALL
        SELECT doc_id, rules.k, regexp_replace(left_over, pattern, '| ', 'g'),
               CASE WHEN regexp_matches(left_over, pattern) THEN list_append(names, name) ELSE names END, n + len(regexp_extract_all(left_over, pattern))
        FROM run JOIN rules ON rules.k = run.k + 1),
    done AS (
        SELECT doc_id, n, left_over, list_sort(list_distinct(names)) AS names FROM run WHERE k = {len(RULES)})
    SELECT doc_id, coalesce(seq, '') AS sentence_ids,
           coalesce(array_to_string(CASE WHEN len(names) > 1 THEN list_filter(names, lambda x: x <> '{PROPRIETARY}') ELSE names END, ','), '') AS licenses,
           coalesce(n, 0)::BIGINT AS n_matches, coalesce(len(regexp_extract_all(left_over, '[A-Z]+[0-9]+')), 0)::BIGINT AS n_unclaimed
    FROM documents LEFT JOIN seq USING (doc_id) LEFT JOIN done USING (doc_id)
    """


ORACLES["op2_license_scan"] = _license_oracle()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
