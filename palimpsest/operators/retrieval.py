"""Candidates, scores and gates of record retrieval.

Queries and records are both tables. Candidates come from equi-joins on terms or codes whose
posting lists are capped in length, so no join key can be hot; only candidates are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V
from ..sources.files import held

#: Posting list caps and score weights.
EVIDENCE_CAP, ADDRESS_CAP, VALUE_CAP, RARE_RECORD_CAP, RARE_PAGE_CAP = 64, 256, 128, 32, 8
#: Candidates of reranking: dense ones, and the records of a term or an address at most.
DENSE_CANDIDATES, RERANK_TERM_CAP, RERANK_ADDRESS_CAP, ADDRESS_CHARS = 32, 256, 512, 4
#: Different needles of a group up to which each of its texts is compared with all of them.
FEW_NEEDLES = 64
#: Different words of a pool's queries up to which they go to its records, and records whose words are dealt to one task.
ASKED_WORDS, HIT_RECORDS = 1_024, 20_000
WEIGHTS = {"lexical": 0.25, "token_overlap": 0.45, "rare_lexical": 1.25, "shape_bonus": 0.35, "structured_bonus": 0.15}
READ_THRESHOLD, EVIDENCE_TOKENS = 0.65, 3


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "record_id") -> DataFrame:
    """The k best rows of each query, with their rank from 1; ties go to the lower id."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(table: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(term, key) of a table with a token array."""
    return table.select(F.explode(tokens).alias("term"), F.col(key))


def capped(post: DataFrame, cap: int) -> DataFrame:
    """(term, df) of terms in at most `cap` postings."""
    return post.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= cap)


def asked_postings(queries: DataFrame, records: DataFrame, *keys: str) -> DataFrame:
    """(term, record_id, keys) of the records' terms that some query has."""
    post = records.select(F.explode("tokens").alias("term"), "record_id", *keys)
    return post.join(postings(queries, "query_id").select("term").distinct(), "term", "left_semi")


def shared_terms(queries: DataFrame, records: DataFrame, cap: int, post: DataFrame | None = None) -> DataFrame:
    """(query_id, record_id, term, df): postings of terms that the queries have and that few records have.

    post are the asked_postings of these or more queries, where the caller has them.
    """
    asked = postings(queries, "query_id")
    post = asked_postings(queries, records) if post is None else post
    rare = capped(post, cap)
    return post.join(rare, "term").join(asked, "term").select("query_id", "record_id", "term", "df")


def lexical_candidates(queries: DataFrame, records: DataFrame, cap: int = EVIDENCE_CAP, post: DataFrame | None = None) -> DataFrame:
    return shared_terms(queries, records, cap, post).select("query_id", "record_id").distinct()


def with_tokens(pairs: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with the token arrays of both ends."""
    return pairs.join(queries.select("query_id", F.col("tokens").alias("q_tokens")), "query_id").join(
        records.select("record_id", F.col("tokens").alias("r_tokens")), "record_id"
    )


def lexical_top_k(queries: DataFrame, records: DataFrame, k: int = 5, cap: int = EVIDENCE_CAP) -> DataFrame:
    """(query_id, record_id, score, rank) by lexical score among records that share a rare term."""
    pairs = with_tokens(lexical_candidates(queries, records, cap), queries, records)
    scored = pairs.select("query_id", "record_id", F.round(T.lexical_score(F.col("q_tokens"), F.col("r_tokens")), 6).alias("score"))
    return top_k(scored, k)


def evidence_hits(queries: DataFrame, records: DataFrame, cap: int = EVIDENCE_CAP, post: DataFrame | None = None) -> DataFrame:
    """(query_id, record_id, n_terms): enough shared rare terms, or one that tells by itself."""
    letters = F.col("term").rlike("^[a-z_]*$")
    telling = letters & (T.is_address_term(F.col("term")) | T.is_symbol_term(F.col("term")) | T.is_value_term(F.col("term")))
    hits = shared_terms(queries, records, cap, post).groupBy("query_id", "record_id").agg(
        F.count("*").alias("n_terms"), F.bool_or(telling).alias("telling"), F.bool_or(letters).alias("letters")
    )
    return hits.where("telling or (letters and n_terms >= 2) or n_terms >= 3").select("query_id", "record_id", "n_terms")


def address_hits(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id) by terms of entity and attribute, or of value, with short posting lists.

    records has record_id, entity, attribute and value.
    """
    named = records.select("record_id", F.explode(T.tokens(F.concat_ws(" ", "entity", "attribute"))).alias("term")).where(
        T.is_address_term(F.col("term")) | T.is_symbol_term(F.col("term"))
    )
    valued = records.select("record_id", F.explode(T.tokens(F.col("value"))).alias("term")).where(T.is_value_term(F.col("term")))
    asked = postings(queries, "query_id")
    out = None
    for post, cap in ((named, ADDRESS_CAP), (valued, VALUE_CAP)):
        few = post.join(capped(post, cap), "term").join(asked, "term").select("query_id", "record_id")
        out = few if out is None else out.union(few)
    return out.distinct()


def matches_address(query: Column, query_tokens: Column, entity: Column, attribute: Column, value: Column) -> Column:
    """Whether a record answers to the names in a query."""
    q, e, a = F.lower(F.trim(query)), F.lower(F.trim(entity)), F.lower(F.trim(attribute))
    has = lambda field, rule: F.exists(T.tokens(field), lambda t: F.array_contains(query_tokens, t) & rule(t))
    entity_match = q.contains(e) | (~e.rlike(f"[{T.CJK}]") & has(e, T.is_address_term))
    symbol = a.startswith("symbol:") | a.startswith("class:") | a.startswith("def:")
    in_query = (a != "") & q.contains(a)
    attribute_match = in_query | has(a, lambda t: T.is_address_term(t) | (symbol & T.is_symbol_term(t)))
    value_match = has(value, T.is_value_term)
    file_named = q.rlike(r"(?:[a-z0-9_.\\/-]+)\.(?:py|md|json|toml|yaml|yml)")
    return (
        F.when(e == "", False).when(file_named & symbol & ~entity_match, False).when(~entity_match & ~attribute_match & ~value_match, False)
        .when(~entity_match & (value_match | (attribute_match & symbol)), True).when(a == "", entity_match | value_match)
        .otherwise(entity_match & (attribute_match | value_match))
    )


def rare_scores(queries: DataFrame, records: DataFrame, cap: int = RARE_RECORD_CAP, post: DataFrame | None = None) -> DataFrame:
    """(query_id, record_id, rare): shared terms that few records have, 2 at most."""
    return shared_terms(queries, records, cap, post).groupBy("query_id", "record_id").agg(F.least(F.lit(2.0), F.count("*").cast("double")).alias("rare"))


def record_scores(pairs: DataFrame, rare: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """pairs with every term of the record score as a column of its own, and their sum.

    pairs has query, q_tokens, r_tokens, entity, attribute, value, confidence, importance and
    routed, the score of the learned or vector ranker.
    """
    q, e, a = F.lower(F.trim("query")), F.lower(F.trim("entity")), F.lower(F.trim("attribute"))
    named = (F.length(e) >= 4) & q.contains(e)
    parts = {
        "s_routed": F.col("routed"),
        "s_lexical": weights["lexical"] * T.lexical_score(F.col("q_tokens"), F.col("r_tokens")),
        "s_overlap": weights["token_overlap"] * T.coverage_score(F.col("q_tokens"), F.col("r_tokens")),
        "s_quality": 0.10 * F.col("confidence") + 0.08 * F.col("importance"),
        "s_rare": weights["rare_lexical"] * F.coalesce(F.col("rare"), F.lit(0.0)),
        "s_shape": F.when(F.size("r_tokens") > 0, weights["shape_bonus"]).otherwise(0.0),
        "s_structured": F.when((F.col("entity") != "") | (F.col("attribute") != "") | (F.col("value") != ""), weights["structured_bonus"]).otherwise(0.0),
        "s_entity": F.when(named, 2.5).otherwise(0.0),
        "s_attribute": F.when(named & (a != "") & q.contains(a), 0.75).otherwise(0.0),
    }
    out = pairs.join(rare, ["query_id", "record_id"], "left").withColumns(parts)
    total = F.lit(0.0)
    for name in parts:
        total = total + F.col(name)
    return out.withColumn("score", total)


def page_scores(scored: DataFrame) -> DataFrame:
    """(query_id, page_id, score) of the record scores of candidate pages.

    scored has routed, lexical and overlap of each (query, record), the page's importance and
    its age in hours.
    """
    return scored.groupBy("query_id", "page_id").agg(
        (
            F.max("routed") + F.when(F.bool_or("has_tokens"), 0.20).otherwise(0.0) + 0.05 * F.max("page_importance") + F.max(0.02 / (1.0 + F.col("age_hours")))
            + (0.65 + 0.45) * F.max("lexical") + 1.25 * F.max("rare") + F.when(F.bool_or("entity_hit"), 2.5).otherwise(0.0)
            + F.when(F.bool_or("attribute_hit"), 0.75).otherwise(0.0) + 0.45 * F.max("overlap")
        ).alias("score")
    )


def _shared_words(keep: Sequence[str]):
    """A row for each word that a row's words and asked share, with its count in words (tf); for each word where asked is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column("words"), batch.column("asked")]
            lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            key = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in lengths]) * max(1, len(coded.dictionary)) + code
            own = np.arange(len(key)) < lengths[0].sum()
            shared, tf = np.unique(key[own & (code >= 0)], return_counts=True)
            row, word = np.divmod(shared, max(1, len(coded.dictionary)))
            found = np.isin(shared, key[~own & (code >= 0)]) | (lengths[1] == 0)[row]
            row, word = row[found], word[found]
            columns = [batch.column(c).take(pa.array(row)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, coded.dictionary.take(pa.array(word)), pa.array(tf[found])], names=[*keep, "word", "tf"])

    return run


def _pool_hits(records: DataFrame, stats: DataFrame, asked: DataFrame, pool: str) -> DataFrame:
    """(record_id, pool, n_words, n, mean, word, tf, df) of at least the words of records that their pool's queries have.

    A pool's asked words go to its records in a list, so that only shared words become rows. Where they
    are more than ASKED_WORDS, all words of its records do, as no list may grow with a pool. The rows
    are dealt to a task for HIT_RECORDS records each, however many there are.
    """
    words = asked.where("word is not null").select(pool, "word").distinct().withColumn("many", F.count("*").over(W.partitionBy(pool)))
    words = words.groupBy(pool).agg(F.collect_list(F.when(F.col("many") <= ASKED_WORDS, F.col("word"))).alias("asked")).join(stats, pool)
    keep = ["record_id", pool, "n_words", "n", "mean"]
    own = records.select("record_id", pool, "n_words", "words").join(words, pool).select(*keep, "words", "asked")
    hits = own.mapInArrow(_shared_words(keep), StructType([*own.select(*keep).schema, StructField("word", StringType()), StructField("tf", LongType())]))
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.select(pool).count() // HIT_RECORDS))
    # equal ids of a pool count as one record, if they have as many words
    hits = hits.repartition(tasks, pool, "word").groupBy(*keep, "word").agg(F.sum("tf").alias("tf"))
    return hits.withColumn("df", F.count("*").over(W.partitionBy(pool, "word")))


def bm25(queries: DataFrame, records: DataFrame, k1: float = 1.5, b: float = 0.75, pool: str | None = None) -> DataFrame:
    """(query_id, record_id, score) of records that share a word with the query.

    Both tables have words, with repeats. Statistics are those of all records, or of the pool
    that the column names. A word that a query repeats counts each time.
    """
    by = [pool] if pool else []
    length = records.withColumn("n_words", F.size("words"))
    stats = length.groupBy(*by).agg(F.count("*").alias("n"), F.avg("n_words").alias("mean"))
    asked = queries.select("query_id", *by, F.explode("words").alias("word")).groupBy("query_id", *by, "word").agg(F.count("*").alias("times"))
    if pool:
        rows = _pool_hits(length, stats, asked, pool).join(asked, [pool, "word"])
    else:
        tf = length.select("record_id", "n_words", F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
        tf = tf.groupBy("record_id", "n_words", "word").agg(F.count("*").alias("tf"))
        rows = tf.join(tf.groupBy("word").agg(F.count("*").alias("df")), "word").join(asked, "word").crossJoin(stats)  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_words") / F.col("mean")))
    return rows.groupBy("query_id", "record_id").agg(F.sum(weight).alias("score"))


def lexical_rag(pairs: DataFrame) -> DataFrame:
    """pairs (query, q_terms, r_terms, entity, attribute) with the score of the lexical baseline."""
    q, e, a = F.lower(F.trim("query")), F.lower(F.trim("entity")), F.lower(F.trim("attribute"))
    score = F.size(F.array_intersect("q_terms", "r_terms")) / F.sqrt(F.greatest(F.lit(1), F.size("q_terms") * F.size("r_terms")).cast("double"))
    score = score + F.when((F.length(e) >= 4) & q.contains(e), 5.0).otherwise(0.0) + F.when((a != "") & q.contains(a), 1.0).otherwise(0.0)
    return pairs.withColumn("score", score)


def dense_scores(queries: DataFrame, records: DataFrame, bits: int = 8, dims: int = 64, radius: int = 2) -> DataFrame:
    """(query_id, record_id, cosine) of vectors whose signatures differ in at most `radius` bits.

    The probes of a query are joined with the records' codes, an equi-join; a radius of -1 compares
    every query with every record.
    """
    q, r = queries.select("query_id", F.col("vector").alias("q_vector")), records.select("record_id", F.col("vector").alias("r_vector"))
    if radius < 0:
        pairs = q.join(r)
    else:
        q = q.withColumn("code", F.explode(V.probes(V.signature(F.col("q_vector"), bits, dims), bits, radius)))
        pairs = q.join(r.withColumn("code", V.signature(F.col("r_vector"), bits, dims)), "code")
    return pairs.select("query_id", "record_id", V.cosine(F.col("q_vector"), F.col("r_vector")).alias("cosine"))


def _cell(k: int, digits: int):
    """The k best records of a cell for each of its queries."""

    def unit(table: pa.Table) -> np.ndarray:
        rows = np.array(table.column("vector").to_pylist(), dtype=np.float64)
        size = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)

    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        asked, own, best = queries.column("query_id").to_numpy(), records.column("record_id").to_numpy(), []
        left, right = (unit(queries), unit(records)) if len(asked) and len(own) else (None, None)
        by_id = np.argsort(own, kind="stable")
        for a in range(0, len(asked) if len(own) else 0, 64):
            scores = np.round(left[a : a + 64] @ right[by_id].T, digits)
            scores[asked[a : a + 64, None] == own[by_id]] = -np.inf
            for i, row in enumerate(scores):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                at = np.flatnonzero((row >= least) & (row > -np.inf))
                at = at[np.argsort(-row[at], kind="stable")[:k]]
                best.append((np.full(len(at), asked[a + i]), own[by_id[at]], row[at]))
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "record_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def dense_top_k(queries: DataFrame, records: DataFrame, k: int, digits: int = 6, query_rows: int = 4_096, record_rows: int = 16_384) -> DataFrame:
    """(query_id, record_id, score, rank): the k records of highest cosine, rounded; ties go to the lower id.

    Exact: every query is compared with every other record, a block of queries with a block of
    records at a time, so the work is their product. Ids are longs; a record of the query's own
    id and null vectors don't count.
    """
    # aliases, as both may come from one table
    q = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("vector"))
    r = records.where("vector is not null").select(F.col("record_id").cast("long").alias("record_id"), F.col("vector").alias("vector"))
    n_q, n_r = -(-q.count() // query_rows) or 1, -(-r.count() // record_rows) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("q_block"), every(n_r).alias("r_block"))
    r = r.select("record_id", "vector", F.pmod(F.xxhash64("record_id"), F.lit(n_r)).cast("int").alias("r_block"), every(n_q).alias("q_block"))
    cells = q.groupBy("q_block", "r_block").cogroup(r.groupBy("q_block", "r_block"))
    return top_k(cells.applyInArrow(_cell(k, digits), "query_id long, record_id long, score double"), k)


def signature_top_k(queries: DataFrame, records: DataFrame, k: int, bits: int = 8, dims: int = 64, radius: int = 2, digits: int = 6, query_rows: int = 4_096, record_rows: int = 16_384) -> DataFrame:
    """(query_id, record_id, score, rank): the k records of highest cosine among those of dense_scores, compared in blocks of a code.

    Codes of many queries or records are dealt out in several blocks; only the sizes of the 2 ** bits
    codes are joined by broadcast. Ids, scores and ties as of dense_top_k; vectors of another size don't count.
    """
    q = queries.where(F.size("vector") == dims).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("vector"), V.signature(F.col("vector"), bits, dims).alias("code"))
    r = records.where(F.size("vector") == dims).select(F.col("record_id").cast("long").alias("record_id"), F.col("vector").alias("vector"), V.signature(F.col("vector"), bits, dims).alias("code"))
    q, r = held(q), held(r)  # a signature is long; it is made once
    near = F.explode(V.probes(F.col("code"), bits, radius))
    loads = q.groupBy("code").count().select(near.alias("code"), "count").groupBy("code").agg(F.ceil(F.sum("count") / query_rows).cast("int").alias("q_parts"))
    sizes = r.groupBy("code").agg(F.ceil(F.count("*") / record_rows).cast("int").alias("r_parts"))
    parts = F.broadcast(held(sizes.join(loads, "code")))  # a row for each of at most 2 ** bits codes
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = q.select("query_id", "vector", near.alias("code")).join(parts, "code").select("query_id", "vector", "code", own("query_id", "q_parts").alias("q_part"), each("r_parts").alias("r_part"))
    r = r.join(parts, "code").select("record_id", "vector", "code", own("record_id", "r_parts").alias("r_part"), each("q_parts").alias("q_part"))
    cells = q.groupBy("code", "q_part", "r_part").cogroup(r.groupBy("code", "q_part", "r_part"))
    return top_k(cells.applyInArrow(_cell(k, digits), "query_id long, record_id long, score double"), k)


def _with_grams(rows: DataFrame, text: str, size: int, *keys: str) -> DataFrame:
    """(keys, gram): the distinct runs of `size` characters of each row's text."""
    chars = rows.where(F.length(text) >= size).select(*keys, F.split(text, "").alias("_c"))  # a column of its own, taken apart once
    runs = F.transform(F.sequence(F.lit(0), F.size("_c") - size), lambda i: F.concat(*(F.get("_c", i + j) for j in range(size))))
    return chars.select(*keys, F.explode(F.array_distinct(runs)).alias("gram"))


def contained(texts: DataFrame, needles: DataFrame, by: Sequence[str] = (), size: int = ADDRESS_CHARS, few: int = FEW_NEEDLES) -> DataFrame:
    """(by, text_id, needle_id): the texts (by, text_id, text) that hold a needle (by, needle_id, needle), of equal `by` columns.

    The texts of a group with at most `few` different needles are compared with each of them. In
    larger groups, and without groups, needles are anchored. Equal needles are sought once. Empty
    and null ones, and null texts, give no row.
    """
    own = needles.where(F.length("needle") > 0).select(*by, "needle").distinct()
    if not by:
        found = _anchored(texts, held(own), by, size)
    else:
        counts = own.groupBy(*by).agg(F.count("*").alias("_n"))
        small = own.join(counts.where(F.col("_n") <= few).drop("_n"), [*by], "left_semi")
        found = texts.join(small, [*by]).where(F.col("text").contains(F.col("needle"))).select(*by, "text_id", "needle")
        large = held(counts.where(F.col("_n") > few).drop("_n"))
        if large.head(1):
            rest = _anchored(texts.join(large, [*by], "left_semi"), held(own.join(large, [*by], "left_semi")), by, size)
            found = found if rest is None else found.union(rest)
    if found is None:
        return texts.crossJoin(needles.select("needle_id")).where("false").select("text_id", "needle_id")
    return found.join(needles.select(*by, "needle_id", "needle"), [*by, "needle"]).select(*by, "text_id", "needle_id")


def _anchored(texts: DataFrame, own: DataFrame, by: Sequence[str], size: int) -> DataFrame | None:
    """(by, text_id, needle): the texts that hold a needle of own (by, needle), each once; None without needles.

    A needle is anchored at that of its runs of `size` characters that the fewest texts have, so a
    prefix that many needles share joins nothing by itself; a needle with a run that no text has
    holds nowhere. Shorter needles are their own anchor. What meets at an anchor is verified.
    """
    out = None
    for n in range(1, size + 1):
        now = own.where(F.length("needle") == n) if n < size else own.where(F.length("needle") >= size)
        if not now.head(1):
            continue
        post = held(_with_grams(texts, "text", n, *by, "text_id"))
        spread = post.groupBy(*by, "gram").agg(F.count("*").alias("_n"))
        runs = _with_grams(now, "needle", n, *by, "needle").join(spread, [*by, "gram"], "left")
        anchors = runs.groupBy(*by, "needle").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all")).where("_all").drop("_all")
        met = post.join(anchors, [*by, "gram"]).select(*by, "text_id", "needle")
        out = met if out is None else out.union(met)
    if out is None:
        return None
    return out.join(texts.select(*by, "text_id", "text"), [*by, "text_id"]).where(F.col("text").contains(F.col("needle"))).select(*by, "text_id", "needle")


def contained_addresses(queries: DataFrame, records: DataFrame, cap: int = RERANK_ADDRESS_CAP) -> DataFrame:
    """(query_id, record_id): records whose entity or attribute, of at least four characters and at most `cap` records, occurs in the query."""
    texts = queries.select(F.col("query_id").alias("text_id"), F.lower(F.trim("query")).alias("text"))
    out = None
    for name in ("entity", "attribute"):
        own = records.select("record_id", F.lower(F.trim(name)).alias("needle")).where(F.length("needle") >= ADDRESS_CHARS)
        few = own.groupBy("needle").count().where(F.col("count") <= cap).select("needle", F.col("needle").alias("needle_id"))
        hits = contained(texts, few).select(F.col("text_id").alias("query_id"), F.col("needle_id").alias("needle")).join(own, "needle").select("query_id", "record_id")
        out = hits if out is None else out.union(hits)
    return out.distinct()


def rerank_candidates(queries: DataFrame, records: DataFrame, k: int = DENSE_CANDIDATES) -> DataFrame:
    """(query_id, record_id): the k nearest vectors, all records of rare terms, and those of contained addresses.

    queries has query, tokens and vector; records has entity, attribute, tokens and vector.
    """
    dense = dense_top_k(queries, records, k, digits=12).select("query_id", "record_id")
    lexical = shared_terms(queries, records, RERANK_TERM_CAP).select("query_id", "record_id")
    return dense.union(lexical).union(contained_addresses(queries, records)).where("query_id <> record_id").distinct()


def dense_rerank(pairs: DataFrame) -> DataFrame:
    """pairs (cosine, q_terms, r_terms, query, entity, attribute) with the fixed reranker's score."""
    q, e, a = F.lower("query"), F.lower(F.trim("entity")), F.lower(F.trim("attribute"))
    lexical = F.size(F.array_intersect("q_terms", "r_terms")) / F.sqrt(F.greatest(F.lit(1), F.size("q_terms") * F.size("r_terms")).cast("double"))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return pairs.withColumn(
        "score", 0.35 * ((F.col("cosine") + 1.0) * 0.5) + 0.15 * lexical + 0.30 * flag((e != "") & q.contains(e)) + 0.20 * flag((a != "") & q.contains(a))
    )


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows filled up with 0, their sizes and their lengths; null ones, and those that hold a null, have length 0."""
    rows = [x if x is not None and None not in x else [] for x in column.to_pylist()]
    sizes = np.array([len(x) for x in rows])
    out = np.zeros((len(rows), sizes.max(initial=0)))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out, sizes, np.sqrt((out * out).sum(axis=1))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them."""
    return np.arange(size.sum()) + np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size)


def _rerank_cell(k: int, digits: int):
    """The k best of a cell's pairs for each of its queries, by the scores of dense_rerank; of `left` rows with a record_id are pairs, the others queries."""

    def run(left: pa.Table, records: pa.Table) -> pa.Table:
        is_pair, best = pc.is_valid(left.column("record_id")), []
        pairs, asked = left.filter(is_pair), left.filter(pc.invert(is_pair))
        if len(pairs) and len(asked) and len(records):
            p_query, p_record = (pairs.column(n).to_numpy() for n in ("query_id", "record_id"))
            order = np.lexsort((p_record, p_query))
            p_query, p_record = p_query[order], p_record[order]
            tokens = pa.chunked_array([*asked.column("tokens").chunks, *records.column("tokens").chunks]).combine_chunks()
            words = tokens.flatten().dictionary_encode()  # equal terms of the cell have one code
            code, mark = words.indices.to_numpy(zero_copy_only=False), np.zeros(len(words.dictionary), np.int64)
            known, size = tokens.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start, n = np.cumsum(size) - size, len(asked)
            ids, own, queries = asked.column("query_id").to_numpy(), records.column("record_id").to_numpy(), asked.column("query").to_pylist()
            theirs = code[size[:n].sum() :]
            post, bounds = np.repeat(np.arange(len(own)), size[n:])[np.argsort(theirs, kind="stable")], np.append(0, np.cumsum(np.bincount(theirs, minlength=len(words.dictionary))))
            by_id = np.argsort(own, kind="stable")
            in_order = own[by_id]
            names = [records.column(c).combine_chunks().dictionary_encode() for c in ("entity", "attribute")]
            names = [(pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False), c.dictionary.to_pylist()) for c in names]
            (q_rows, q_dims, q_norm), (r_rows, r_dims, r_norm) = _matrix(asked.column("vector")), _matrix(records.column("vector"))
            dims = min(q_rows.shape[1], r_rows.shape[1])
            for i, x in enumerate(ids):
                found = p_record[slice(*np.searchsorted(p_query, [x, x + 1]))]
                first = np.searchsorted(in_order, found)
                at = by_id[_spans(first, np.searchsorted(in_order, found, "right") - first)]
                if not len(at):
                    continue
                mine = code[start[i] : start[i] + size[i]]
                lists, size_at = bounds[mine + 1] - bounds[mine], size[n + at]
                if 4 * size_at.sum() > lists.sum():  # many candidates: whole lists of the query's terms
                    common = np.bincount(np.concatenate([post[:0], *(post[bounds[c] : bounds[c + 1]] for c in mine)]), minlength=len(own))[at]
                else:
                    mark[mine] = 1
                    sums, ends = np.append(0, np.cumsum(mark[code[_spans(start[n + at], size_at)]])), np.cumsum(size_at)
                    common, mark[mine] = sums[ends] - sums[ends - size_at], 0
                lexical = common / np.sqrt(np.maximum(1, size[i] * size_at).astype(float))
                norm = q_norm[i] * r_norm[at]
                long = ~(norm <= 0)
                cosine = np.where(long, r_rows[at, :dims] @ q_rows[i, :dims] / np.where(long, norm, 1), 0.0)
                flags = []
                for of, text in names:
                    hit = [c for c in np.unique(of[at]) if c >= 0 and text[c] != "" and queries[i] is not None and text[c] in queries[i]]
                    flags.append(np.isin(of[at], hit).astype(float))
                score = 0.35 * ((cosine + 1.0) * 0.5) + 0.15 * lexical + 0.30 * flags[0] + 0.20 * flags[1]
                null = ~(known[i] & known[n + at]) | long & (q_dims[i] != r_dims[at])
                rank = np.where(null, -np.inf, np.where(np.isnan(score), np.inf, np.round(score, digits)))
                top = np.lexsort((own[at], -rank))[:k]
                best.append((np.full(len(top), x), own[at][top], score[top], null[top]))
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, bool)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "record_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2], pa.float64(), mask=columns[3])})

    return run


def dense_rerank_top_k(queries: DataFrame, records: DataFrame, pairs: DataFrame, k: int, digits: int = 6, query_rows: int = 4_096, record_rows: int = 8_192) -> DataFrame:
    """(query_id, record_id, score, rank): the k best pairs (query_id, record_id) of each query by the score of dense_rerank, rounded; ties go to the lower id.

    queries has query, tokens and vector; records has entity, attribute, tokens and vector; tokens
    stand once in a row. Pairs are dealt out as two ids to cells of a block of queries and a block of
    records; texts, tokens and vectors go to a cell once, not with each pair. Ids are longs.
    """
    # aliases, as both may come from one table
    q, r = queries.withColumn("query_id", F.col("query_id").cast("long")), records.withColumn("record_id", F.col("record_id").cast("long"))
    n_r = -(-r.count() // record_rows) or 1
    n_q = max(-(-q.count() // query_rows), -(-q.sparkSession.sparkContext.defaultParallelism // n_r))  # a cell for each core at least
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    q = q.select("query_id", F.lit(None).cast("long").alias("record_id"), F.lower("query").alias("query"), F.col("tokens").alias("tokens"), F.col("vector").alias("vector"), block("query_id", n_q).alias("q_block"), every(n_r).alias("r_block"))
    own = pairs.select(F.col("query_id").cast("long").alias("query_id"), F.col("record_id").cast("long").alias("record_id"))
    own = own.withColumns({"q_block": block("query_id", n_q), "r_block": block("record_id", n_r)})
    name = lambda c: F.lower(F.trim(c)).alias(c)
    r = r.select("record_id", name("entity"), name("attribute"), F.col("tokens").alias("tokens"), F.col("vector").alias("vector"), block("record_id", n_r).alias("r_block"), every(n_q).alias("q_block"))
    left = q.unionByName(own, allowMissingColumns=True)
    cells = left.groupBy("q_block", "r_block").cogroup(r.groupBy("q_block", "r_block")).applyInArrow(_rerank_cell(k, digits), "query_id long, record_id long, score double")
    return top_k(cells.withColumn("score", F.round("score", digits)), k)


def chunk_overlap(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k chunks (chunk_id, tokens) with most tokens of each query; the earliest among equals."""
    asked = queries.select("query_id", F.explode("tokens").alias("term"))
    own = chunks.select("chunk_id", F.explode("tokens").alias("term"))
    scored = own.join(asked, "term").groupBy("query_id", "chunk_id").agg(F.count("*").alias("score"))
    return top_k(scored, k, tie="chunk_id")


def hops(seeds: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, record_id, hop): records reached from the seeds over edges (record_id, related_id)."""
    seen = seeds.select("query_id", "record_id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, most + 1):
        reached = front.join(edges, "record_id").select("query_id", F.col("related_id").alias("record_id")).distinct()
        front = reached.join(seen, ["query_id", "record_id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def evidence_chain(facts: DataFrame, most: int = 3, group: str = "group_id", seq: str = "seq") -> DataFrame:
    """(group, seq, next_seq, hop): facts of a group whose value occurs in the fact before.

    Which values occur in which texts is found once, by `contained` within groups; a chain then
    follows those links, so a group costs its links and not its pairs.
    """
    texts = facts.select(group, F.col(seq).alias("text_id"), "text")
    links = held(contained(texts, facts.select(group, F.col(seq).alias("needle_id"), F.col("value").alias("needle")), [group]).where("text_id <> needle_id"))
    links = links.select(group, F.col("text_id").alias("_at"), F.col("needle_id").alias("next_seq"))
    front = facts.select(group, F.col(seq), F.col(seq).alias("_at"), F.array(seq).alias("path"))
    out = None
    for hop in range(1, most + 1):
        front = front.join(links, [group, "_at"]).where(~F.array_contains("path", F.col("next_seq")))
        front = front.select(group, seq, F.col("next_seq").alias("_at"), F.array_append("path", F.col("next_seq")).alias("path"))
        rows = front.select(group, seq, F.col("_at").alias("next_seq"), F.lit(hop).alias("hop"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(group, seq, "next_seq").agg(F.min("hop").alias("hop"))


def read_gates(asked: DataFrame, threshold: float = READ_THRESHOLD, least_margin: float = 0.0) -> DataFrame:
    """asked with stop_reason, confidence, margin and whether it reads.

    asked has one row for each query: query, need, has_evidence, covered (null: no head), attribute_known, top1, top2 and
    shared_tokens. The gates are taken in their order; an override by shared tokens opens the last.
    """
    margin = F.coalesce("top1", F.lit(0.0)) - F.coalesce("top2", F.lit(0.0))
    override = F.coalesce(F.col("shared_tokens") >= EVIDENCE_TOKENS, F.lit(False))
    reason = (
        F.when(T.is_unknown_request(F.col("query")), "explicit_unknown_request")
        .when(F.col("covered").isNotNull() & ~F.col("attribute_known"), "no_attribute_recognised")
        .when(F.coalesce(~F.col("covered"), F.lit(False)), "attribute_not_covered")
        .when((F.col("need") < threshold) & ~F.col("has_evidence"), "router_abstained")
        .when(F.col("top1").isNull(), "no_relevant_evidence")
        .when((margin < least_margin) & ~F.col("has_evidence"), "insufficient_evidence_margin")
        .when((F.col("top1") < threshold) & override, "token_evidence_override")
        .when((F.col("top1") < threshold) & ~F.col("has_evidence"), "below_read_threshold")
        .otherwise("evidence_found")
    )
    return asked.withColumn("margin", margin).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("top1", F.lit(0.0))))).withColumn(
        "stop_reason", reason
    ).withColumn("reads", reason.isin("evidence_found", "token_evidence_override"))
