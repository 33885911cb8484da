"""Text functions as Column factories; everything stays in the JVM but for squash()."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What the record store's rules are stated in.
STOP_TOKENS = ("我", "的", "是", "了", "请", "一下")
CJK = "一-鿿"
TERM_PATTERN = f"[{CJK}]|[A-Za-z0-9_\\-]+"
QUESTION_STARTS = ("请问", "什么", "为什么", "怎么", "如何", "能不能", "是否", "有没有", "如果", "帮我", "解释")
FORGET_MARKS = ("删除", "忘记", "忘掉", "清除", "撤回", "作废")
CORRECTION_MARKS = ("更正", "更新", "改为", "改成", "变为")
FACT_OPERATORS = "(?:改为|改成|更新为|设置为|变为|是|为|叫|(?<![A-Za-z])[:：]|=)"
FACT_ENDS = "(?:，|,|。|！|!|；|;|$)"
NAMED_ATTRIBUTES = "常用时区|时区|工作地点|办公地点|常住城市|居住地|最喜欢的水果|水果偏好|项目代号|工作代号|提醒时间|默认输出风格|备用联系人|编辑器|开发工具|语言|名字|姓名"
FIELD_ENDS = "[ ：:，,。.!！？]"
UNKNOWN_MARKS = ("不存在的", "未登记", "没有登记", "从未记录", "从来没有登记", "没有出现在", "没有出现过")
NO_GUESS_MARKS = ("不要猜", "说不知道", "明确说不知道")
GROUNDED_MARKS = ("我的", "我之前", "之前告诉", "当前项目", "这个项目", "本项目", "仓库", "代码库", "readme", "记忆", "历史上下文", "重启后", "原版对照", "当前模型", "这套模型", "长期记忆")
CARD_HEAD, CARD_FACT = "【长期记忆证据】", "事实："
CARD_ENTITY, CARD_ATTRIBUTE, CARD_VALUE, CARD_PHRASE = "实体：", "属性：", "已确认值：", "可直接复述的关键短语："
CARD_DEMAND = "回答要求：第一句先直接回答问题，并原样复述上面的关键短语；需要多个字段时一次性列出，不要先解释检索过程；证据不足就明确说不知道。"
REFUSALS = (
    "不知道",
    "不清楚",
    "没有(相关)?(的)?(记录|信息|资料|内容)",
    "未(包含|找到|记录|提及|提供|出现|收录)(相关)?(的)?(信息|记录|内容|资料)?",
    "未在(长期)?记忆(中)?(包含|出现|找到|记录)",
    "无法(回答|确认|确定|提供|判断)",
    "缺乏(具体)?(上下文|信息|线索)",
    "证据不足",
    "没有(足够)?(的)?证据",
    "没有提及",
    "记忆(中)?(没有|未)(相关)?(记录|信息)",
    r"未知\s*[。.!！]?\s*$",
    r"\b(i|we)\s+(do\s*n[o']?t|don't|do\s+not)\s+(know|have|see|recall)",
    r"\b(i'?m|i\s+am)\s+not\s+(sure|certain|able)",
    r"\bno\s+(information|record|records|mention|evidence|data)\b",
    r"\bnot\s+(mentioned|stated|specified|provided|recorded|available|found|clear)\b",
    r"\b(wasn'?t|weren'?t|isn'?t|was\s+not|were\s+not|is\s+not)\s+(mentioned|stated|specified|provided|recorded)\b",
    r"\bcannot\s+be\s+(determined|answered|found|inferred)",
    r"\b(can'?t|cannot|could\s+not|couldn'?t)\s+(answer|determine|tell|find|say|recall)",
    r"\bthere\s+(is|are)\s+no\s+(mention|record|records|information)",
    r"\bunable\s+to\s+(answer|determine|find|provide|recall)",
    r"\bdoes\s+not\s+(mention|state|specify|provide|contain|include)",
    r"\bnothing\s+(in|about|regarding)\b",
    r"\bnot\s+enough\s+(information|evidence)",
    r"\bunknown\s*[.!]?\s*$",
)
REFUSAL_MARKS = ("不知道", "没有记录", "无法确认", "未找到", "不清楚", "没有相关信息")


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def clean(text: Column) -> Column:
    """Without NUL, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\x00", ""), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Distinct lower-case terms, parts of 3 letters or more of joined ones, and CJK three-grams.

    Stop tokens and grams are CJK, and parts need a joining sign, so a text without either is
    matched once and goes through no lambda.
    """
    low = F.lower(text)
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(low, F.lit(TERM_PATTERN), F.lit(0))
    has_cjk = low.rlike(f"[{CJK}]")
    raw = F.when(has_cjk, F.filter(found, lambda t: ~t.isin(*STOP_TOKENS))).otherwise(found)
    joined = F.filter(found, lambda t: t.contains("_") | t.contains("-"))
    parts = F.filter(F.flatten(F.transform(joined, lambda t: F.split(t, "[_-]+"))), lambda p: F.length(p) >= 3)
    parts = F.when(low.contains("_") | low.contains("-"), parts).otherwise(none)
    runs = F.filter(F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.length(r) >= 3)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda i: F.substr(r, i, F.lit(3)))))
    return F.array_distinct(F.concat(raw, parts, F.when(has_cjk, grams).otherwise(none)))


def terms(text: Column) -> Column:
    """Distinct lower-case terms, nothing else."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)))


def bm25_words(text: Column) -> Column:
    """All lower-case words of ASCII letters, digits and apostrophes, repeats included."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def content_words(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words of two letters or more that are not in stop."""
    return F.array_distinct(F.filter(bm25_words(text), lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def lexical_score(query: Column, own: Column) -> Column:
    """Shared terms by the root of the product of both numbers; 0 if either is empty."""
    shared = F.size(F.array_intersect(query, own)).cast("double")
    return F.when((F.size(query) == 0) | (F.size(own) == 0), F.lit(0.0)).otherwise(shared / F.sqrt((F.size(query) * F.size(own)).cast("double")))


def coverage_score(query: Column, own: Column) -> Column:
    """Share of the query's distinct tokens that own has."""
    n = F.size(F.array_distinct(query))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, own)).cast("double") / n)


def is_address_term(t: Column) -> Column:
    return (F.length(t) >= 8) | t.rlike(r"[0-9_\-./\\]")


def is_symbol_term(t: Column) -> Column:
    return t.rlike("^[a-z_]{3,}$")


def is_value_term(t: Column) -> Column:
    return (F.length(t) >= 4) & (t.rlike(r"[0-9_\-./\\]") | t.rlike("^[a-z]+$"))


def routing_text(text: Column, entity: Column, attribute: Column, value: Column, aliases: Mapping[str, str] | None = None, operations: Mapping[int, str] | None = None) -> Column:
    """Text, fields and the attribute's aliases, without blank parts.

    aliases gives further words of an attribute, operations those of an attribute named
    operational:<number>; both belong to the records' subject, so the caller has them.
    """
    name = F.trim(attribute)
    words, extra = F.lit(""), F.lit("")
    for k, v in (aliases or {}).items():
        words = F.when(name == k, F.lit(v)).otherwise(words)
    number = F.regexp_extract(F.lower(name), r"^operational:(?:.*:)?\s*([+-]?[0-9]+)\s*$", 1)
    for k, v in (operations or {}).items():
        extra = F.when(number == str(k), F.lit(v)).otherwise(extra)
    parts = F.filter(F.array(text, entity, attribute, value, words, extra), lambda p: F.trim(p) != "")
    return F.array_join(parts, " ")


def segments(text: Column, most: int = 8) -> Column:
    """The text split after sentence ends; whole if that makes one part or more than `most`."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.filter(F.transform(F.split(whole, r"(?<=[。！？!?；;])\s*"), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(whole == "", F.array().cast("array<string>")).when((F.size(parts) <= 1) | (F.size(parts) > most), F.array(whole)).otherwise(parts)


def is_question(text: Column) -> Column:
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    starts = F.lit(False)
    for s in QUESTION_STARTS:
        starts = starts | whole.startswith(s)
    return (whole != "") & (whole.contains("？") | whole.contains("?") | starts)


def _strip(field: Column) -> Column:
    return F.regexp_replace(field, f"^{FIELD_ENDS}+|{FIELD_ENDS}+$", "")


def parse_fact(text: Column) -> Column:
    """struct<kind, should_write, entity, attribute, value> of a user's sentence."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    forget = _any(whole, FORGET_MARKS)
    named = _strip(F.regexp_extract(whole, "我的(.{1,24}?)(?:的记忆|记录|信息|资料)", 1))
    told = _strip(F.regexp_extract(whole, "(?:忘记|忘掉|删除|清除|撤回|作废)(?:我的|关于我的)?(.{1,24}?)(?:吧|了|。|！|$)", 1))
    own = f"我的(.{{1,24}}?){FACT_OPERATORS}(.{{1,80}}?){FACT_ENDS}"
    known = f"({NAMED_ATTRIBUTES})\\s*{FACT_OPERATORS}\\s*(.{{1,80}}?){FACT_ENDS}"
    a1, v1, a2, v2 = (_strip(F.regexp_extract(whole, p, g)) for p, g in ((own, 1), (own, 2), (known, 1), (known, 2)))
    first, second = (a1 != "") & (v1 != ""), (a2 != "") & (v2 != "")
    fact = first | second
    kind = (
        F.when(whole == "", "empty").when(forget, "forget").when(is_question(whole), "query")
        .when(fact & _any(whole, CORRECTION_MARKS), "correction").when(fact, "fact").otherwise("episode")
    )
    attribute = F.when(forget, F.when(named != "", named).otherwise(told)).when(first, a1).when(second, a2).otherwise("")
    states = kind.isin("fact", "correction", "forget")
    return F.struct(
        kind.alias("kind"), kind.isin("fact", "correction", "episode").alias("should_write"), F.when(states, "user").otherwise("").alias("entity"),
        F.when(states, attribute).otherwise("").alias("attribute"),
        F.when(kind.isin("fact", "correction"), F.when(first, v1).otherwise(v2)).otherwise("").alias("value"),
    )


def evidence_card(text: Column, entity: Column, attribute: Column, value: Column) -> Column:
    """The lines of a record's card: head, fact, the fields that it has, and what is asked."""
    line = lambda head, field: F.when(F.trim(field) != "", F.concat(F.lit(head), F.trim(field)))
    fields = F.filter(F.transform(F.array(entity, attribute, value), lambda x: F.trim(x)), lambda x: x != "")
    phrase = F.when(F.size(fields) > 0, F.concat(F.lit(CARD_PHRASE), F.array_join(fields, "；")))
    return F.concat_ws(
        "\n", F.lit(CARD_HEAD), F.concat(F.lit(CARD_FACT), F.trim(text)), line(CARD_ENTITY, entity), line(CARD_ATTRIBUTE, attribute),
        line(CARD_VALUE, value), phrase, F.lit(CARD_DEMAND),
    )


def card_fact(text: Column) -> Column:
    """The fact line of a card; other texts as they are, trimmed."""
    body = F.trim(text)
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith(CARD_FACT))
    said = F.trim(F.substring(F.get(lines, F.lit(0)), len(CARD_FACT) + 1, 1 << 30))
    return F.when(body.startswith(CARD_HEAD) & (F.size(lines) > 0), said).otherwise(body)


def corrected_card(text: Column, old: tuple[Column, Column, Column], new: tuple[Column, Column, Column]) -> Column:
    """The card with new fields (null: keep); null if nothing is new or a field would be blank."""
    entity, attribute, value = (F.coalesce(n, o) for n, o in zip(new, old, strict=True))
    fact, before = card_fact(text), F.trim(old[2])
    said = F.when(new[2].isNull(), fact).when((before != "") & fact.contains(before), F.replace(fact, before, value)).otherwise(F.concat(attribute, F.lit("是 "), value))
    known = (F.trim(entity) != "") & (F.trim(attribute) != "") & (F.trim(value) != "")
    given = new[0].isNotNull() | new[1].isNotNull() | new[2].isNotNull()
    return F.when(known & given, evidence_card(said, entity, attribute, value))


def origin(text: Column) -> Column:
    """16 digits that name a user turn; '' for a blank one."""
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when(body == "", "").otherwise(F.substring(F.sha1(F.encode(body, "UTF-8")), 1, 16))


def is_grounded_query(text: Column) -> Column:
    return _any(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), GROUNDED_MARKS)


def is_unknown_request(text: Column) -> Column:
    """Asks for a field that the text itself says isn't there."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    return _any(whole, UNKNOWN_MARKS) | ((whole.contains("没有记录") | whole.contains("如果没有")) & _any(whole, NO_GUESS_MARKS))


def is_refusal(reply: Column) -> Column:
    """Declines to answer, in one of the known wordings."""
    return F.coalesce(F.trim(reply).rlike("(?im)" + "|".join(REFUSALS)), F.lit(False))


def has_refusal_mark(reply: Column) -> Column:
    """The older rule: one of a few marks."""
    return F.coalesce(_any(reply, REFUSAL_MARKS), F.lit(False))


def _squash(text: str | None) -> str:
    return "".join(unicodedata.normalize("NFKC", text or "").split()).casefold()


@F.pandas_udf(StringType())
def squash(text: pd.Series) -> pd.Series:
    """NFKC, no white space, case folded; Spark has no built-in for the first and last."""
    return text.map(_squash)


def squash_ascii(text: Column) -> Column:
    """squash() of ASCII texts, in the JVM."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def contains_any(reply: Column, anchors: Column) -> Column:
    """Some anchor occurs in the reply; both squashed, blank anchors left out."""
    return F.exists(anchors, lambda a: (a != "") & reply.contains(a))


def contains_all(reply: Column, anchors: Column) -> Column:
    return F.forall(anchors, lambda a: reply.contains(a))


def contains_digit_alone(reply: Column, digit: Column) -> Column:
    """The digit occurs with no digit beside it."""
    return F.regexp_count(F.concat(F.lit(" "), reply, F.lit(" ")), F.concat(F.lit("[^0-9]"), digit, F.lit("[^0-9]"))) > 0


def without_punctuation(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s\p{Punct}，。！？；：、“”‘’（）【】]+", ""))


def score_answer(reply: Column, acceptable: Column, answerable: Column, squashed=squash_ascii) -> Column:
    """struct<correct, matched, refused, abstained, wrongly_abstained>."""
    own = squashed(reply)
    matched = F.filter(acceptable, lambda a: (a != "") & own.contains(squash_ascii(a)))
    hit, refused = F.size(matched) > 0, is_refusal(reply)
    return F.struct(
        F.when(answerable, hit).otherwise(hit | refused).alias("correct"), F.slice(matched, 1, 3).alias("matched"), refused.alias("refused"),
        (~answerable & refused).alias("abstained"), (answerable & refused & ~hit).alias("wrongly_abstained"),
    )


def last_message(messages: Column, role: str = "user") -> Column:
    """The content of the last message of a role in array<struct<role, content>>."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["content"])


def joined_messages(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def stable_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.encode(F.concat_ws("|", *parts), "UTF-8")), 1, 20)


def hash_share(key: Column) -> Column:
    """The first 32 bits of the key's SHA-1 as a share of their largest value."""
    return hash_number(key).cast("double") / F.lit(0xFFFFFFFF)


def hash_number(key: Column) -> Column:
    """The first 32 bits of the key's SHA-1."""
    return F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, width: int = 1800) -> Column:
    """array<struct<start, chunk>>: pieces of `width` characters, trimmed, without blank ones."""
    n = F.ceil(F.length(text) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * width).alias("start"), F.trim(F.substr(text, i * width + 1, F.lit(width))).alias("chunk")))
    return F.when(F.length(text) > 0, F.filter(pieces, lambda p: p["chunk"] != "")).otherwise(F.array().cast("array<struct<start:int,chunk:string>>"))


def symbols(text: Column) -> Column:
    """array<struct<kind, name, line>> of Python definitions, one for each line that has one."""
    lines = F.split(text, "\n")
    pattern = r"^\s*(class|async def|def)\s+([A-Za-z_][A-Za-z0-9_]*)"
    found = F.transform(lines, lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("kind"), F.regexp_extract(x, pattern, 2).alias("name"), (i + 1).alias("line")))
    return F.filter(found, lambda s: s["name"] != "")


def excerpt(text: Column, phrase: Column, radius: int) -> Column:
    """The text around the phrase's first place, or its beginning."""
    at = F.greatest(F.position(phrase, text), F.lit(1))
    start = F.greatest(at - radius, F.lit(1))
    return F.substr(text, start, at + F.length(phrase) + radius - start)


def distinctive_overlap(query: Column, text: Column, stop: str = "") -> Column:
    """Share of the text's distinct non-ASCII characters that the query has."""
    found = lambda x: F.regexp_extract_all(x, F.lit("[^\\x00-\\x7F]"), F.lit(0))
    chars = lambda x: F.array_distinct(F.filter(found(x), lambda c: ~F.lit(stop).contains(c)) if stop else found(x))
    own = chars(text)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(chars(query), own)).cast("double") / F.size(own))


def token_budget(context: Column, prompt: Column, answer: Column, share: float = 0.9) -> Column:
    """struct<trigger, overflow, tokens_for_memory> of a context window."""
    limit = F.floor(context * share)
    used = prompt + answer
    return F.struct((used > limit).alias("trigger"), F.greatest(F.lit(0), used - limit).alias("overflow"), F.greatest(F.lit(0), limit - used).alias("tokens_for_memory"))


def failure_stage(answerable: Column, correct: Column, retrieved: Column, complete: Column) -> Column:
    """Where a wrong answer went wrong."""
    return (
        F.when(correct, "none").when(~answerable, "unknown_refusal_control").when(~retrieved, "routing_miss")
        .when(~complete, "evidence_fusion").otherwise("generation_control")
    )


def template_frame(template: Column) -> Column:
    """A regular expression of a template: literal parts escaped, slots {name} as (.+?)."""
    escaped = F.regexp_replace(template, r"([\\.\[\]()*+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\{[a-z_]+\}", "(.+?)"), F.lit("$"))


def slot_value(text: Column, templates: Sequence[str]) -> Column:
    """The last slot's value by the first template that the whole text follows; null if it follows none."""
    out = F.lit(None).cast("string")
    for t in reversed(templates):
        frame = template_frame(F.lit(t))
        out = F.when(F.rlike(text, frame), F.call_function("regexp_extract", text, frame, F.lit(t.count("{")))).otherwise(out)
    return out
