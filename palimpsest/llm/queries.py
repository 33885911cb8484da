"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, html_extract, mixing, ngram_join, phrases, quality_model, quality_rules, secrets, sharding, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(key: Column, of: int) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % of


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned outside fold 1 of 3."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, labels, trains=lambda key: _fold(key, 3) != 1).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingle similarity of 0.75."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that 400-byte repeats cover."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    found = decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base patterns and confirmed structures."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets along a curriculum."""
    out = mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return out.withColumn("position", F.round("position", 9))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned outside fold 0 of 5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_model.score(docs, labels, trains=lambda key: _fold(key, 5) != 0).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on words, symbols and suffix-array repetition of all documents."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 8 clusters after 10 rounds of Lloyd's method in integers."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_quality_model": op8_quality_model,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrases": op11_phrases,
    "op12_html": op12_html,
    "op13_lloyd": op13_lloyd,
}



def lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's method as SQL: a pair of CTEs for each round."""
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v "
        "FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1)::INT AS c, v AS m FROM v "
        f"ORDER BY sha256('3:' || vec_id) NULLS LAST, v LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS (SELECT i, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}), "
            f"a{r} AS MATERIALIZED (SELECT i, min_by(c, d * 64 + c) AS c, min(d) AS d FROM d{r} GROUP BY i)"
        )
        if r < rounds:
            steps.append(
                f"u{r} AS (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{r} JOIN v USING (i)), "
                f"s{r} AS (SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM u{r} GROUP BY c, p), "
                f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM s{r} GROUP BY c), "
                f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)"
            )
    return f"""WITH {', '.join(steps)}
        SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (i) JOIN c{rounds} c ON c.c = a.c"""


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_T = "sqrt((1 - k) * (1 - k) + 4 * k * (o / target))"

SQL: dict[str, str] = {
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), {_WORDS}) AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, chr(1))]
              ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))))) END AS s FROM w),
        u AS (SELECT doc_id, unnest(s) AS x FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN g ga ON ga.doc_id = a JOIN g gb ON gb.doc_id = b WHERE 100 * k >= 75 * (len(ga.s) + len(gb.s) - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS d, doc_id AS m FROM g UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(m) FROM r WHERE d = doc_id) AS component_id,
               CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id FROM g""",
    "op6_mixing": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
        c AS (SELECT *, [5, 2, 1][(i % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
        q AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS lw, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lg
              FROM c WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT lw, lg, cap / w AS r, i FROM q WHERE cap * lg > w * lw ORDER BY cap / w, i LIMIT 1),
        t AS (SELECT q.source, q.i, source_size, CASE WHEN f.r IS NULL OR (cap / w, q.i) < (f.r, f.i) THEN cap::DOUBLE ELSE w::DOUBLE * f.lw::DOUBLE / f.lg::DOUBLE END AS target FROM q LEFT JOIN f ON true),
        o AS (SELECT doc_id, size, source_size, target, [-0.5, 0.0, 0.5][(i % 3 + 1)::INT]::DOUBLE AS k,
              coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY (h >> 40) % 4096, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        x AS (SELECT *, list_transform(range(3), lambda j: greatest(0, least(size, floor(target)::BIGINT - o - j * source_size))) AS p FROM o)
        SELECT doc_id, size, source_size, target, list_sum(p)::BIGINT AS taken, len(list_filter(p, lambda y: y > 0))::INT AS copies,
               CASE WHEN list_sum(p) > 0 THEN round(CASE WHEN k = 0 THEN o / target ELSE 2 * (o / target) / ((1 - k) + {_T}) END, 9) END AS position FROM x""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS head FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to FROM m""",
    "op11_phrases": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_ASCII}), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
        d AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w, count(*) AS m FROM p GROUP BY ALL HAVING len(w) > 0),
        n AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM d GROUP BY lang),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, sum(m)::BIGINT AS a
              FROM (SELECT lang, w, m, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, unnest([1, 2, 3, 4]) AS u(k) WHERE len(w) >= k) GROUP BY ALL HAVING sum(m) >= 30),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
        j AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM c),
        s AS (SELECT j.lang, j.phrase, j.a, j, x.a AS l, y.a AS r, (2000000 * j.a) // (x.a + y.a) AS score FROM j
              JOIN g x ON x.lang = j.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN g y ON y.lang = j.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        i AS (SELECT lang, array_to_string(w[f:t], ' ') AS phrase, max(a) AS within FROM (SELECT c.*, f, unnest(range(f + 1, k + 1)) AS t FROM c, unnest([1, 2, 3]) AS u(f) WHERE f < k)
              WHERE t - f + 1 < k GROUP BY ALL),
        o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE within IS NULL OR 100 * within < 80 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op13_lloyd": lloyd_sql(),
}
