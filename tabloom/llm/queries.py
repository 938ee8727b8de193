"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    decontamination,
    licenses,
    line_dedup,
    mixing,
    quality,
    ranked_search,
    secrets,
    sharding,
    simhash,
    token_counts,
    toxicity,
    vector_codes,
    warc,
)
from tabloom.llm.common import durable, reach_workers, table
from tabloom.session import ensure_checkpoint_dir


def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", simhash.fingerprint("text", 4).alias("fp"))
    grouped = simhash.near_duplicates(durable(docs), radius=4)
    return grouped.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(mixing.measured(table(spark, sf_dir, "documents")))
    return mixing.mix(rows, rows.select("source", "size", "hash")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("matches")
    return found.select(
        "doc_id",
        *[secrets.counted(m, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(secrets.of_kinds(m, secrets.BASE)).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(m).alias("spans"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_pages(table(spark, sf_dir, "pages"), folder)
    records = warc.read_warc(spark, folder, extra="page=x-page-id", payloads="response")
    records = records.filter(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"
    return records.select(
        F.col("page").cast("bigint").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("http_length")).cast("bigint").alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1).try_cast("bigint").alias("refers_to"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path``: the tokenizer file; the public byte-level one unless named."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, str(path))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", "severity", "toxic")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sized(table(spark, sf_dir, "documents")).select(
        "doc_id", "__size", "__crc", "__g1", "__g2", "__spread"
    )
    out = sharding.assign(durable(docs), ["__g1", "__g2"], "__spread", shards=16)
    return out.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digits = F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0"))
    return coded.select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, sf_dir, "benchmark"))


def _reaching(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reach_workers(spark)
        return query(spark, sf_dir)

    return run


def registered() -> dict:
    return {name: _reaching(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


def _mixing_sql() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || ':17'), 1, 15) AS h
  FROM documents),
w AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
before AS (
  SELECT source, s, w,
         (SELECT sum(s) FROM w) - coalesce(sum(3 * s) OVER o, 0) AS rest,
         (SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0) AS weight
  FROM w WINDOW o AS (ORDER BY 3.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, CAST(rest AS DOUBLE) * w / weight >= 3 * s AS is_capped FROM before),
free AS (
  SELECT (SELECT sum(s) FROM w) - coalesce(sum(3 * s) FILTER (is_capped), 0) AS rest,
         sum(w) FILTER (NOT is_capped) AS weight
  FROM capped),
goal AS (
  SELECT c.source, c.s,
         CASE WHEN is_capped THEN CAST(3 * c.s AS DOUBLE) ELSE CAST(free.rest AS DOUBLE) * c.w / free.weight END AS target
  FROM capped c CROSS JOIN free),
budget AS (
  SELECT source, s, target, CAST(least(floor(target / s), 3) AS BIGINT) AS times,
         target - least(floor(target / s), 3) * s AS l
  FROM goal WHERE s > 0),
hashes AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
run AS (
  SELECT b.source, h, words, l, sum(words) OVER (PARTITION BY b.source ORDER BY h) AS upto
  FROM hashes x JOIN budget b ON x.source IS NOT DISTINCT FROM b.source),
once AS (
  SELECT source, h FROM run
  WHERE upto <= l OR (upto - words <= l AND words - (l - (upto - words)) < l - (upto - words)))
SELECT d.doc_id, d.size, g.s AS source_size, g.target,
       CAST(d.size * least(coalesce(b.times, 0) + CASE WHEN o.h IS NULL THEN 0 ELSE 1 END, 3) AS BIGINT) AS taken
FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN once o ON d.source IS NOT DISTINCT FROM o.source AND d.h = o.h"""


def _secrets_sql() -> str:
    parts = []
    rules = [*secrets.BASE, *secrets.MORE]
    for n, r in enumerate(rules):
        regex = "'" + (("(?i)" if r.any_case else "") + r.regex).replace("'", "''") + "'"
        parts.append(f"""
  SELECT rid, {n} AS n, '{r.kind}' AS kind, e - length(m) AS s, e, length(k) AS k FROM (
    SELECT rid, m, k, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
      SELECT rid, unnest(ms) AS m, unnest(ks) AS k, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS i FROM (
        SELECT rid, regexp_extract_all(x, {regex}, 0) AS ms, regexp_extract_all(x, {regex}, {r.group}) AS ks,
               regexp_split_to_array(x, {regex}) AS ps
        FROM t WHERE regexp_matches(x, {regex}))))
  WHERE length(k) >= {r.least}""")
    base = len(secrets.BASE)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
f AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({one}, ',' ORDER BY s, n) FILTER (n < {base}) AS base, string_agg({one}, ',' ORDER BY s, n) AS spans
  FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""


def _lines_sql() -> str:
    return r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (
  SELECT rid, doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM t),
w AS (
  SELECT rid, doc_id, text, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS whole
  FROM l WINDOW o AS (PARTITION BY rid ORDER BY pos)),
n AS (
  SELECT rid, pos, dense_rank() OVER (PARTITION BY whole ORDER BY doc_id NULLS LAST, md5(text), pos) AS nth
  FROM w WHERE regexp_matches(whole, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT rid, pos + k AS pos FROM n CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
r AS (
  SELECT l.rid, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text,
         count(*) AS n_lines, count(g.pos) AS n_removed
  FROM l LEFT JOIN gone g ON l.rid = g.rid AND l.pos = g.pos GROUP BY l.rid)
SELECT doc_id, CASE WHEN t.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
       CASE WHEN t.text IS NULL THEN 0 ELSE n_lines END AS n_lines, n_removed
FROM t JOIN r USING (rid)"""


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, payload_bytes >= 100 AS shared FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN shared AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN shared AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN first END AS refers_to
FROM f"""


def _licenses_sql() -> str:
    def listed(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = ", ".join(f"({listed(licenses.template_words(p))}, '{label}')" for p, label in licenses.PHRASES)
    templates = [(label, licenses.template_words(t)) for label, t in licenses.TEMPLATES]
    rows = ", ".join(f"('{label}', {licenses.step_of(len(w))}, {listed(sorted(set(w)))})" for label, w in templates)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
p(w, label) AS (VALUES {phrases}),
m(label, step, w) AS (VALUES {rows}),
spots AS (SELECT rid, ws, unnest(range(len(ws))) AS pos FROM t),
places AS (SELECT rid, pos, label FROM spots JOIN p ON ws[pos + 1] = p.w[1] AND ws[pos + 1:pos + len(p.w)] = p.w),
base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM places GROUP BY rid),
steps AS (SELECT DISTINCT step FROM m),
b AS (
  SELECT rid, step, list_distinct(ws[k * step + 1:k * step + 2 * step]) AS held FROM (
    SELECT rid, ws, step, unnest(range(greatest(CAST(ceil(len(ws) / step) AS BIGINT) - 2, 0) + 1)) AS k FROM t, steps)),
o AS (SELECT rid, m.label, len(list_intersect(held, m.w)) AS overlap, len(m.w) AS words FROM b JOIN m ON b.step = m.step),
more AS (
  SELECT rid, list(DISTINCT label) AS labels, max(CAST(overlap AS DOUBLE) / words) AS score
  FROM o WHERE overlap * 100 >= {licenses.THRESHOLD} * words GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       coalesce(score, 0.0E0) AS score
FROM t LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)"""


def _codes_sql() -> str:
    """Every round spelled out: all distances as exact doubles, the nearest entry, then the means rounded down."""

    def nearest(r: int) -> str:
        key = f"CAST(x2 - 2 * list_inner_product(x, y) + y2 AS BIGINT) * {vector_codes.ENTRIES} + k"
        return f"""
a{r} AS MATERIALIZED (SELECT rid, x.p, x, min({key}) AS m FROM x JOIN c{r} c ON x.p = c.p GROUP BY rid, x.p, x)"""

    def means(r: int) -> str:
        return f"""
u{r} AS (SELECT p, m % {vector_codes.ENTRIES} AS k, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{r}),
v{r} AS (SELECT p, k, pos, floor(sum(v) / count(*)) AS v FROM u{r} GROUP BY 1, 2, 3),
w{r} AS (SELECT p, k, list(v ORDER BY pos) AS y FROM v{r} GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (
  SELECT p, k, y, list_inner_product(y, y) AS y2
  FROM (SELECT c.p, c.k, coalesce(w.y, c.y) AS y FROM c{r} c LEFT JOIN w{r} w ON c.p = w.p AND c.k = w.k))"""

    n = vector_codes.ROUNDS
    rounds = ",".join(nearest(r) + "," + means(r) for r in range(n)) + "," + nearest(n)
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
         list_transform(embedding, lambda e: floor({vector_codes.SCALE} * CAST(e AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (
  SELECT rid, p, x, list_inner_product(x, x) AS x2 FROM (
    SELECT rid, p, v[p * len(v) // {vector_codes.PARTS} + 1:(p + 1) * len(v) // {vector_codes.PARTS}] AS x
    FROM q, (SELECT unnest(range({vector_codes.PARTS})) AS p))),
c0 AS (SELECT p, rid - 1 AS k, x AS y, x2 AS y2 FROM x WHERE rid <= {vector_codes.ENTRIES}),{rounds},
done AS (
  SELECT rid, string_agg(printf('%02x', m % {vector_codes.ENTRIES}), '' ORDER BY p) AS code,
         CAST(sum(m // {vector_codes.ENTRIES}) AS BIGINT) AS error
  FROM a{n} GROUP BY rid),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(y, lambda e: CAST(e AS BIGINT)), ','), ',' ORDER BY p, k)) AS codebooks_sha256
  FROM c{n})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM q JOIN done USING (rid) CROSS JOIN books"""


_SEARCH_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents)
  WHERE len(ws) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
tf AS MATERIALIZED (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
i AS (SELECT row_number() OVER () AS qid, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (
  SELECT qid, w, count(*) AS times FROM (
    SELECT qid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM i)
  GROUP BY 1, 2),
g AS (
  SELECT qid, w, times * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM q JOIN df USING (w) CROSS JOIN c),
s AS (
  SELECT qid, rid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM g JOIN tf USING (w) JOIN d USING (rid) CROSS JOIN c GROUP BY 1, 2),
r AS (
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (qid) WHERE rank <= 20"""


#: The others hash with XXH64, fit a model, use a tokenizer or iterate; tests/llm holds them against brute force.
SQL: dict[str, str] = {"op2_mixing": _mixing_sql(), "op3_line_dedup": _lines_sql(), "op5_secrets": _secrets_sql(), "op6_warc": _WARC_SQL, "op11_licenses": _licenses_sql(), "op12_vector_codes": _codes_sql(), "op13_ranked_search": _SEARCH_SQL}
