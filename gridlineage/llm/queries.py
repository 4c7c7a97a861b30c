"""One query for each corpus operator over the whole tables; digests are taken from what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, codebooks, exact_dedup, filter_audit, minhash, packing, quality, records, sharding, sitetree, toxicity, urlfilter
from .common import learns, table


def crc(c: Column | str) -> Column:
    """Unsigned CRC-32 of a text or binary column; null counts as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.crc32(c.cast("binary")), F.lit(0))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), crc("text").alias("text_crc32"))
    out = sharding.interleave(rows, 16, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(scores: DataFrame, limit: float, *more: str) -> DataFrame:
    """Scores with what the contract asks for: whether labels of the row were kept from the model, and the prediction; then further columns."""
    return scores.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"), *more)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return held_out(scores, 0.7, "spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return held_out(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2, size=4096).drop("ids")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return groups.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.new_folder(spark)
    files = records.write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return records.read_records(files, folder).select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.main_text(table(spark, sf_dir, "pages"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.audio_features(table(spark, sf_dir, "documents"))
    loud = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.format_number(v.cast("double"), 3)), " ")
    feature = F.concat(F.lit("frames="), "frames", F.lit(";spans="), F.size("spans"), F.lit(";loud="), F.format_number(loud, 3), F.lit(";mean="), listed("means"), F.lit(";deviation="), listed("deviations"))
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), crc(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The rules of op12: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op13_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_quality, op4_packing, op5_exact_dedup, op6_records, op7_minhash, op8_bpe, op9_sitetree, op10_audio, op11_filter_audit, op12_url_filter, op13_codebooks)}

#: The same rows in DuckDB's SQL.
ORACLE_SQL = {
    "op1_sharding": """
        WITH x AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
             d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, hex(coalesce(text, '')) AS t, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum,
                          md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mixed FROM documents),
             r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mixed, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n FROM d),
             p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rank + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), stratum, mixed, doc_id) - 1 AS place, count(*) OVER () AS total FROM r),
             s AS (SELECT *, CAST(place * 16 // total AS INT) AS shard FROM p)
        SELECT doc_id, size,
               xor(4294967295, list_reduce(list_transform(range(size - 1), lambda k: 16 * strpos('123456789ABCDEF', t[2 * k + 1]) + strpos('123456789ABCDEF', t[2 * k + 2])),
                                           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s, x
    """,
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             r AS (SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
    """,
    "op11_filter_audit": r"""
        WITH l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
             o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
             s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS f FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
             d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
             p AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                          CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                          || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                          || CASE WHEN min(d.doc_id) OVER (PARTITION BY t) < d.doc_id THEN 'E' ELSE '' END AS fails
                   FROM d LEFT JOIN m ON d.doc_id = m.doc_id),
             r AS (SELECT part, filter_order, step, f, fails, good, toxic,
                          least(6, CASE WHEN contains(fails, substr(filter_order, 1, 1)) THEN 1 END, CASE WHEN contains(fails, substr(filter_order, 2, 1)) THEN 2 END, CASE WHEN contains(fails, substr(filter_order, 3, 1)) THEN 3 END,
                                CASE WHEN contains(fails, substr(filter_order, 4, 1)) THEN 4 END, CASE WHEN contains(fails, substr(filter_order, 5, 1)) THEN 5 END) AS gone FROM p, s),
             g AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed, count(*) FILTER (gone < step AND contains(fails, f)) AS redundant,
                          count(*) FILTER (fails = f) AS unique_fails, count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
    """,
    "op12_url_filter": r"""
        WITH RECURSIVE r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(h, p, verdict)),
             h AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>', '', 'g') AS html FROM pages),
             t AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link\s[^>]*canonical|meta\s[^>]*refresh)[^>]*>')) AS tag FROM h WHERE url IS NOT NULL),
             k AS (SELECT url, CASE WHEN lower(tag[2:5]) = 'link' THEN regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END AS target FROM t),
             n AS (SELECT page_id, url, true AS own FROM pages UNION ALL SELECT NULL, target, false FROM k WHERE contains(target, '://')),
             s AS (SELECT *, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM n),
             m AS (SELECT *, lower(regexp_extract(url, '(?s)^(.*?)://', 1)) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]+)', 1) AS name FROM s),
             j AS (SELECT host, path, arg_max(h || p, length(h || p) * 1000 + length(h)) AS rule, arg_max(verdict, length(h || p) * 1000 + length(h)) AS verdict
                   FROM (SELECT DISTINCT host, path FROM s) x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2),
             e AS (SELECT a.name AS a, b.name AS b FROM k JOIN m a ON a.url = k.url AND a.own JOIN m b ON b.url = k.target AND NOT b.own),
             b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
             c AS (SELECT a, a AS z FROM b UNION SELECT c.a, b.b FROM c JOIN b ON b.a = c.z),
             f AS (SELECT c.a AS name, min(verdict) AS alias FROM c JOIN m ON m.name = c.z JOIN j ON j.host = m.host AND j.path = m.path GROUP BY 1)
        SELECT page_id, m.host, m.path, rule, coalesce(verdict, alias, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS "by"
        FROM m LEFT JOIN j ON j.host = m.host AND j.path = m.path LEFT JOIN f ON f.name = m.name WHERE own
    """,
    "op13_codebooks": """
        WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS p)),
             c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < 64),
             a1 AS MATERIALIZED (SELECT p.vec_id, p.p, any_value(p.v) AS v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) % 64 AS e FROM p JOIN c0 c ON c.p = p.p GROUP BY 1, 2),
             m1 AS (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a1) GROUP BY 1, 2, 3),
             n1 AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m1 GROUP BY 1, 2),
             c1 AS MATERIALIZED (SELECT c0.p, c0.e, coalesce(n1.v, c0.v) AS v FROM c0 LEFT JOIN n1 ON n1.p = c0.p AND n1.e = c0.e),
             a2 AS MATERIALIZED (SELECT p.vec_id, p.p, any_value(p.v) AS v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) % 64 AS e FROM p JOIN c1 c ON c.p = p.p GROUP BY 1, 2),
             m2 AS (SELECT p, e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS i FROM a2) GROUP BY 1, 2, 3),
             n2 AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m2 GROUP BY 1, 2),
             c2 AS MATERIALIZED (SELECT c1.p, c1.e, coalesce(n2.v, c1.v) AS v FROM c1 LEFT JOIN n2 ON n2.p = c1.p AND n2.e = c1.e),
             a3 AS MATERIALIZED (SELECT p.vec_id, p.p, any_value(label) AS label, CAST(min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS BIGINT) AS d FROM p JOIN c2 c ON c.p = p.p GROUP BY 1, 2),
             r AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(to_hex(d % 64)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d // 64) AS BIGINT) AS error FROM a3 GROUP BY 1)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM r
    """,
}
