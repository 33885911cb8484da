"""Text rules on hand-written cases; the tables hold no CJK text."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.plans import registry


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return rows.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "tokens"),
    [
        ("请问 DEFAULT_MEMORY_RESET_TOKEN 是 什么", {"问", "default_memory_reset_token", "default", "memory", "reset", "token", "什", "么"}),
        ("模型名称 a-bc", {"模", "型", "名", "称", "模型名", "型名称", "a-bc"}),
        ("", set()),
        ("Élan vital", {"lan", "vital"}),
    ],
)
def test_tokens(spark, said, tokens):
    assert set(one(spark, T.tokens(F.col("t")), t=said)) == tokens


@pytest.mark.parametrize(
    ("said", "parts"),
    [
        ("我叫李雷。我住在上海！你呢？", ["我叫李雷。", "我住在上海！", "你呢？"]),
        ("只有一句", ["只有一句"]),
        ("a! b! c! d! e! f! g! h! i!", ["a! b! c! d! e! f! g! h! i!"]),
        ("  ", []),
    ],
)
def test_segments(spark, said, parts):
    assert one(spark, T.segments(F.col("t")), t=said) == parts


@pytest.mark.parametrize(
    ("said", "kind", "attribute", "value"),
    [
        ("我的城市是上海。", "fact", "城市", "上海"),
        ("更正：我的城市改为杭州", "correction", "城市", "杭州"),
        ("请忘记我的城市吧", "forget", "城市", ""),
        ("我的城市是什么？", "query", "", ""),
        ("如果下雨", "query", "", ""),
        ("时区：东八区", "fact", "时区", "东八区"),
        ("记住：我的评测报告放在 E:\\deepseek\\artifacts。", "episode", "", ""),
        ("今天天气不错", "episode", "", ""),
        ("", "empty", "", ""),
    ],
)
def test_facts(spark, said, kind, attribute, value):
    f = one(spark, T.parse_fact(F.col("t")), t=said)
    assert (f.kind, f.attribute, f.value) == (kind, attribute, value)
    assert f.should_write == (kind in ("fact", "correction", "episode"))


def test_cards(spark):
    card = one(spark, T.evidence_card(*map(F.col, "teav")), t=" 我的名字是 Wpy ", e="user", a="名字", v="Wpy")
    assert card.split("\n")[:5] == ["【长期记忆证据】", "事实：我的名字是 Wpy", "实体：user", "属性：名字", "已确认值：Wpy"]
    assert "关键短语：user；名字；Wpy" in card
    assert one(spark, T.card_fact(F.col("t")), t=card) == "我的名字是 Wpy"
    assert one(spark, T.card_fact(F.col("t")), t=" plain ") == "plain"
    none = F.lit(None).cast("string")
    old = tuple(map(F.lit, ("user", "名字", "Wpy")))
    new = one(spark, T.corrected_card(F.col("t"), old, (none, none, F.lit("王五"))), t=card)
    assert "事实：我的名字是 王五" in new and "已确认值：王五" in new and "Wpy" not in new
    assert one(spark, T.corrected_card(F.col("t"), old, (none, none, none)), t=card) is None


def test_origin_of_blank_is_blank(spark):
    assert one(spark, T.origin(F.col("t")), t="  ") == ""
    assert len(one(spark, T.origin(F.col("t")), t="x")) == 16


@pytest.mark.parametrize(("said", "refused"), [("您的协议编号未知。", True), ("I don't know", True), ("Not found.", True), ("值班人-5259", False), ("the unknown soldier", False)])
def test_refusals(spark, said, refused):
    assert one(spark, T.is_refusal(F.col("t")), t=said) is refused


def test_squash(spark):
    assert one(spark, T.squash(F.col("t")), t="值班人　-５２５９ Straße") == "值班人-5259strasse"
    assert one(spark, T.squash_ascii(F.col("t")), t=" A b\tC ") == "abc"


def test_unknown_requests(spark):
    assert one(spark, T.is_unknown_request(F.col("t")), t="如果没有记录，不要猜")
    assert not one(spark, T.is_unknown_request(F.col("t")), t="没有记录")


def test_template_frames(spark):
    frame = one(spark, T.template_frame(F.col("t")), t="my {a} is {b}.")
    assert frame == r"^my (.+?) is (.+?)\.$"


def test_digit_boundary(spark):
    assert one(spark, T.contains_digit_alone(F.col("t"), F.lit("7")), t="it is 7.")
    assert not one(spark, T.contains_digit_alone(F.col("t"), F.lit("7")), t="it is 17")


def test_routing_text(spark):
    said = T.routing_text(*map(F.col, "teav"), aliases={"模型名称": "正式名字 模型名"}, operations={6: "reset token fim"})
    assert one(spark, said, t="x", e="", a="模型名称", v="Q") == "x 模型名称 Q 正式名字 模型名"
    assert one(spark, said, t="x", e="", a="operational:6", v="").endswith("operational:6 reset token fim")
    assert one(spark, T.routing_text(*map(F.col, "teav")), t="x", e=" ", a="模型名称", v="Q") == "x 模型名称 Q"


def test_pair_scores_are_made_once(spark, sf_dir):
    """Tokens and scores that several columns use are columns of their own; characters beyond the basic plane count as one."""
    plan = registry.QUERIES["q_pair_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 3
    rows = spark.createDataFrame([("é😀a", "éé😀x😀ü", 0)], "a string, b string, i int")
    got = rows.select(T.distinctive_overlap(F.col("a"), F.col("b")).alias("x"), T.distinctive_overlap(F.col("a"), F.col("b"), "é").alias("y")).first()
    assert round(got["x"], 6) == 0.666667 and got["y"] == 0.5
