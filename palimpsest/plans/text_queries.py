"""Text functions over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.files import conversation_turns, read_spread, read_table

STOP_WORDS = ("the", "of", "and", "is", "to", "in", "it")
TERM_SQL = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_\-]+"


def tokens_sql(x: str) -> str:
    """T.tokens of an expression."""
    stop = ", ".join(f"'{t}'" for t in T.STOP_TOKENS)
    raw = f"list_filter(regexp_extract_all(lower({x}), '{TERM_SQL}'), lambda t: t NOT IN ({stop}))"
    parts = f"list_filter(flatten(list_transform(list_filter({raw}, lambda t: contains(t, '_') OR contains(t, '-')), lambda t: regexp_split_to_array(t, '[_-]+'))), lambda p: length(p) >= 3)"
    grams = f"flatten(list_transform(list_filter(regexp_extract_all(lower({x}), '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda r: length(r) >= 3), lambda r: list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3))))"
    return f"list_distinct(list_concat(list_concat({raw}, {parts}), {grams}))"


def terms_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '{TERM_SQL}'))"


def any_sql(x: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in marks) + ")"


def lexical_sql(q: str, r: str) -> str:
    return f"CASE WHEN len({q}) = 0 OR len({r}) = 0 THEN 0.0 ELSE len(list_intersect({q}, {r}))::DOUBLE / sqrt((len({q}) * len({r}))::DOUBLE) END"


SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and term sets of every document."""
    own = T.tokens(F.col("text"))
    return read_spread(spark, sf_dir, "documents").select(
        "doc_id", F.size(own).alias("n_tokens"), F.sha1(F.encode(F.array_join(F.array_sort(own), " "), "UTF-8")).alias("digest"), F.size(T.terms(F.col("text"))).alias("n_terms"),
        F.size(T.bm25_words(F.col("text"))).alias("n_words"), F.size(T.content_words(F.col("text"), STOP_WORDS)).alias("n_content"),
    )


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts and their keys."""
    body = T.clean(F.col("text"))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", F.length(body).alias("n_chars"), F.sha1(F.encode(body, "UTF-8")).alias("digest"), T.stable_key(F.col("source"), F.col("lang"), body).alias("stable_key"),
        F.sha1(F.encode(T.squash_ascii(F.col("text")), "UTF-8")).alias("squashed"),
    )


def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns cut into sentences, with the question and guard flags of each."""
    rows = read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(T.segments(F.col("text"))).alias("pos", "segment"))
    s = F.col("segment")
    return rows.select("*", T.is_question(s).alias("question"), T.is_grounded_query(s).alias("grounded"), T.is_unknown_request(s).alias("unknown"))


def q_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts parsed from user turns."""
    return read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.parse_fact(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


def q_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence cards of all turns, read back, and corrected."""
    rows = read_table(spark, sf_dir, "conversations")
    fields = (F.col("role"), F.when(F.col("turn") % 2 == 0, "turn").otherwise(""), F.col("turn").cast("string"))
    card = T.evidence_card(F.col("text"), *fields)
    none = F.lit(None).cast("string")
    return rows.withColumn("card", card).select(
        "conv_id", "turn", F.sha1(F.encode("card", "UTF-8")).alias("digest"), (T.card_fact(F.col("card")) == F.split(F.trim("text"), "\n")[0]).alias("same_fact"),
        F.sha1(F.encode(T.corrected_card(F.lit("card text 1"), (F.lit("user"), F.lit("turn"), F.lit("1")), (none, none, F.col("turn").cast("string"))), "UTF-8")).alias("corrected"),
        T.origin(F.col("text")).alias("origin"),
    )


def q_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals among all turns and some sentences that are known to be ones."""
    known = spark.createDataFrame([(-i - 1, x) for i, x in enumerate(KNOWN_REPLIES)], "conv_id long, text string").select("conv_id", F.lit(0).cast("long").alias("turn"), "text")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(known)
    return rows.select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refused"), T.has_refusal_mark(F.col("text")).alias("marked"))


KNOWN_REPLIES = (
    "不知道", "没有相关的记录", "您的协议编号未知。", "I do not know that.", "There is no mention of it", "It was not stated.", "I'm not sure", "unknown", "The answer is 42.",
    "值班人是 5259", "We cannot be certain", "Unable to determine", "nothing about it was said", "证据不足，无法回答",
)


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns scored as answers to made-up anchors."""
    rows = read_table(spark, sf_dir, "conversations")
    anchors = F.array(F.lit("the and"), F.lit("onth"), F.concat(F.lit("of "), F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", T.score_answer(F.col("text"), anchors, F.col("conv_id") % 3 != 0).alias("s")).select(
        "conv_id", "turn", "s.correct", F.size("s.matched").alias("n_matched"), "s.refused", "s.abstained", "s.wrongly_abstained"
    )


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 1,800 characters, each with the one before it."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.chunk")
    before = F.lag("start").over(W.partitionBy("doc_id").orderBy("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.length("chunk").alias("n_chars"), F.sha1(F.encode("chunk", "UTF-8")).alias("digest"), before.cast("long").alias("previous"))


def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as message lists: the last user message, and all with their roles."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    digest = lambda c: F.sha1(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    return rows.select("conv_id", F.size("m").alias("n_messages"), digest(T.last_message(F.col("m"))).alias("last_user"), digest(T.joined_messages(F.col("m"))).alias("joined"))


def q_turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their speakers."""
    return conversation_turns(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.sha1(F.encode("line", "UTF-8")).alias("digest"))


def q_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical scores of every document against one benchmark item; the items take turns."""
    items = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % items.count()).alias("item_id")).join(items, "item_id")
    # columns of their own, so that tokens and scores are made once for all uses
    rows = rows.select("doc_id", "question", "text", T.tokens(F.col("question")).alias("q"), T.tokens(F.col("text")).alias("r"))
    rows = rows.select("doc_id", "question", "text", T.lexical_score(F.col("q"), F.col("r")).alias("lexical"), T.coverage_score(F.col("q"), F.col("r")).alias("overlap"))
    lexical, overlap = F.col("lexical"), F.col("overlap")
    return rows.select(
        "doc_id", F.round(lexical, 6).alias("lexical"), F.round(overlap, 6).alias("coverage"), F.round(T.distinctive_overlap(F.col("question"), F.col("text")), 6).alias("distinctive"),
        F.round(V.slot_score(lexical, overlap, F.col("doc_id") % 2 == 0), 6).alias("slot"), F.round(V.blend(lexical, overlap), 6).alias("blended"),
    )


def q_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in lines made of each turn's text, and an excerpt of it."""
    rows = read_table(spark, sf_dir, "conversations").withColumn("code", F.concat(F.lit("def "), F.regexp_replace("role", "[^a-z]", ""), F.lit("_x():\n    pass\nclass A:\n"), F.col("text")))
    out = rows.select("conv_id", "turn", T.excerpt(F.col("code"), F.lit("class A"), 12).alias("excerpt"), F.explode(T.symbols(F.col("code"))).alias("s"))
    return out.select("conv_id", "turn", F.sha1(F.encode("excerpt", "UTF-8")).alias("excerpt"), "s.kind", "s.name", F.col("s.line").cast("long").alias("line"))


def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token budgets of all turns in a window of 64."""
    rows = read_table(spark, sf_dir, "conversations")
    n = F.size(T.bm25_words(F.col("text")))
    return rows.select("conv_id", "turn", n.alias("n"), T.token_budget(F.lit(64), n, F.lit(8)).alias("b")).select("conv_id", "turn", "n", "b.trigger", "b.overflow", "b.tokens_for_memory")


def q_failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases that failed somewhere."""
    rows = read_table(spark, sf_dir, "labels")
    stage = T.failure_stage(F.col("quality") == 1, F.col("doc_id") % 5 == 0, F.col("toxic") == 0, F.col("doc_id") % 2 == 0)
    return rows.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_tokens, q_clean_text, q_segments, q_facts, q_cards, q_refusals, q_answers, q_chunks, q_messages, q_turn_lines, q_pair_scores, q_symbols, q_budget, q_failure_stages)}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LITERALS = ", ".join("({}, 0, '{}')".format(-i - 1, x.replace("'", "''")) for i, x in enumerate(KNOWN_REPLIES))
_REFUSAL = "|".join(T.REFUSALS).replace("'", "''")
_SQUASH = r"lower(regexp_replace(coalesce({}, ''), '\s+', '', 'g'))"
_CARD = (
    f"concat_ws(chr(10), '{T.CARD_HEAD}', '{T.CARD_FACT}' || trim(text), '{T.CARD_ENTITY}' || role, CASE WHEN turn % 2 = 0 THEN '{T.CARD_ATTRIBUTE}turn' END, "
    f"'{T.CARD_VALUE}' || turn, '{T.CARD_PHRASE}' || role || '；' || CASE WHEN turn % 2 = 0 THEN 'turn；' ELSE '' END || turn, '{T.CARD_DEMAND}')"
)
_CORRECTED = (
    f"concat_ws(chr(10), '{T.CARD_HEAD}', '{T.CARD_FACT}' || replace('card text 1', '1', turn::VARCHAR), '{T.CARD_ENTITY}user', '{T.CARD_ATTRIBUTE}turn', "
    f"'{T.CARD_VALUE}' || turn, '{T.CARD_PHRASE}user；turn；' || turn, '{T.CARD_DEMAND}')"
)

SQL = {
    "q_tokens": f"""
        SELECT doc_id, len(k)::INT AS n_tokens, sha1(array_to_string(list_sort(k), ' ')) AS digest, len(t)::INT AS n_terms, len(w)::INT AS n_words,
               len(list_distinct(list_filter(w, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))))::INT AS n_content
        FROM (SELECT doc_id, {tokens_sql("text")} AS k, {terms_sql("text")} AS t, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)""",
    "q_clean_text": rf"""
        SELECT doc_id, length(b)::INT AS n_chars, sha1(b) AS digest, substr(sha1(source || '|' || lang || '|' || b), 1, 20) AS stable_key,
               sha1({_SQUASH.format("text")}) AS squashed
        FROM (SELECT *, trim(regexp_replace(replace(text, chr(0), ''), '\s+', ' ', 'g')) AS b FROM documents)""",
    "q_segments": rf"""
        WITH c AS (SELECT conv_id, turn, {SQUEEZED} AS w FROM conversations WHERE role = 'user'),
        p AS (SELECT conv_id, turn, w, list_filter(list_transform(string_split(regexp_replace(w, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c),
        s AS (SELECT conv_id, turn, CASE WHEN len(parts) <= 1 OR len(parts) > 8 THEN [w] ELSE parts END AS parts FROM p WHERE w <> ''),
        e AS (SELECT conv_id, turn, unnest(range(0, len(parts))) AS pos, unnest(parts) AS segment FROM s)
        SELECT conv_id, turn, pos::INT AS pos, segment, contains(segment, '？') OR contains(segment, '?') OR {" OR ".join(f"starts_with(segment, '{q}')" for q in T.QUESTION_STARTS)} AS question,
               {any_sql("lower(segment)", T.GROUNDED_MARKS)} AS grounded,
               {any_sql("segment", T.UNKNOWN_MARKS)} OR ((contains(segment, '没有记录') OR contains(segment, '如果没有')) AND {any_sql("segment", T.NO_GUESS_MARKS)}) AS unknown
        FROM e""",
    "q_cards": f"""
        SELECT conv_id, turn, sha1({_CARD}) AS digest, trim(string_split(trim(text), chr(10))[1]) = string_split(trim(text), chr(10))[1] AS same_fact, sha1({_CORRECTED}) AS corrected,
               CASE WHEN trim(text) = '' THEN '' ELSE substr(sha1(trim(text)), 1, 16) END AS origin
        FROM conversations""",
    "q_refusals": f"""
        SELECT conv_id, turn, regexp_matches(trim(text), '(?im){_REFUSAL}') AS refused, {any_sql("text", T.REFUSAL_MARKS)} AS marked
        FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES {_LITERALS}) v(conv_id, turn, text))""",
    "q_answers": f"""
        WITH a AS (SELECT conv_id, turn, conv_id % 3 <> 0 AS answerable, regexp_matches(trim(text), '(?im){_REFUSAL}') AS refused,
                   len(list_filter(['theand', 'onth', 'of' || turn], lambda x: contains({_SQUASH.format("text")}, x)))::INT AS n FROM conversations)
        SELECT conv_id, turn, CASE WHEN answerable THEN n > 0 ELSE n > 0 OR refused END AS correct, n AS n_matched, refused,
               NOT answerable AND refused AS abstained, answerable AND refused AND n = 0 AS wrongly_abstained FROM a""",
    "q_chunks": """
        WITH c AS (SELECT doc_id, unnest(range(0, ceil(length(text) / 1800.0)::BIGINT)) AS i, text FROM documents),
        p AS (SELECT doc_id, i * 1800 AS start, trim(substr(text, i * 1800 + 1, 1800)) AS chunk FROM c)
        SELECT doc_id, start, length(chunk)::INT AS n_chars, sha1(chunk) AS digest, lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS previous FROM p WHERE chunk <> ''""",
    "q_messages": """
        SELECT conv_id, count(*)::INT AS n_messages, sha1(coalesce(max_by(text, turn) FILTER (role = 'user'), '')) AS last_user,
               sha1(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS joined
        FROM conversations GROUP BY conv_id""",
    "q_turn_lines": "SELECT conv_id, turn, sha1(role || ': ' || trim(text)) AS digest FROM conversations WHERE trim(coalesce(text, '')) <> ''",
    "q_pair_scores": f"""
        WITH p AS (SELECT doc_id, {tokens_sql("b.text")} AS q, {tokens_sql("d.text")} AS r,
                   list_distinct(list_filter(string_split(b.text, ''), lambda c: regexp_matches(c, '[^\\x00-\\x7F]'))) AS qc,
                   list_distinct(list_filter(string_split(d.text, ''), lambda c: regexp_matches(c, '[^\\x00-\\x7F]'))) AS rc
                   FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
        s AS (SELECT doc_id, {lexical_sql("q", "r")} AS lx, CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, r))::DOUBLE / len(q) END AS cv,
              CASE WHEN len(rc) = 0 THEN 0.0 ELSE len(list_intersect(qc, rc))::DOUBLE / len(rc) END AS ds FROM p)
        SELECT doc_id, round(lx, 6) AS lexical, round(cv, 6) AS coverage, round(ds, 6) AS distinctive,
               round(CASE WHEN doc_id % 2 = 0 THEN 0.85::DOUBLE * lx + 0.15::DOUBLE * cv ELSE 0.4::DOUBLE * ((lx + 1) / 2) + 0.6::DOUBLE * cv END, 6) AS slot, round(0.5::DOUBLE * lx + 0.5::DOUBLE * cv, 6) AS blended FROM s""",
    "q_symbols": r"""
        WITH c AS (SELECT conv_id, turn, 'def ' || regexp_replace(role, '[^a-z]', '', 'g') || '_x():' || chr(10) || '    pass' || chr(10) || 'class A:' || chr(10) || text AS code FROM conversations),
        l AS (SELECT conv_id, turn, code, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS line, unnest(string_split(code, chr(10))) AS x FROM c),
        s AS (SELECT *, regexp_extract(x, '^\s*(class|async def|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS kind, regexp_extract(x, '^\s*(class|async def|def)\s+([A-Za-z_][A-Za-z0-9_]*)', 2) AS name,
              greatest(strpos(code, 'class A'), 1) AS p FROM l)
        SELECT conv_id, turn, sha1(substr(code, greatest(p - 12, 1), p + 7 + 12 - greatest(p - 12, 1))) AS excerpt, kind, name, line FROM s WHERE name <> ''""",
    "q_budget": """
        SELECT conv_id, turn, n, n + 8 > 57 AS trigger, greatest(0, n + 8 - 57) AS overflow, greatest(0, 57 - n - 8) AS tokens_for_memory
        FROM (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9'']+'))::INT AS n FROM conversations)""",
    "q_failure_stages": """
        SELECT CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN quality <> 1 THEN 'unknown_refusal_control' WHEN toxic <> 0 THEN 'routing_miss'
               WHEN doc_id % 2 <> 0 THEN 'evidence_fusion' ELSE 'generation_control' END AS stage, count(*) AS n FROM labels GROUP BY 1""",
}
