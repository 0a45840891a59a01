import pytest
from pyspark.sql import functions as F

from corvane.functions import lineage as L
from corvane.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.clean, " a　b\x00\n c ", "a b c"),
        (lambda c: T.bounded(c, 4), "tel 13812345678", "tel "),
        (lambda c: T.clean_model_output(c, 50), "## **Hi** <b>you</b> ```x```", "Hi you x"),
        (T.section_title, "三、 背景 Work-Plan", "背景workplan"),
        (T.section_title, "2. 结论", "结论"),
        (T.is_question, "这是不是对的", True),
        (T.is_question, "done", False),
        (T.is_closing, "我的汇报到此结束", True),
        (T.importance, "下一步做什么?", 2),
        (T.importance, "why?", 1),
        (T.truthy, " Yes ", True),
        (T.truthy, "maybe", None),
        (T.unsafe_html, "<p ONclick = x>", True),
        (T.unsafe_html, "<p>on x=1</p>", False),
        (T.safe_error, "fail /a/b/c: x", "fail [路径]"),
        (T.device_kind, "MacBook AirPods", "headphones"),
        (T.device_kind, "BlackHole 2ch", "virtual"),
        (lambda c: T.alias(c, T.SCENARIOS), " 答辩 ", "defense"),
        (lambda c: T.one_of(c, T.SPEAKER_ROLES), "SELF", "self"),
        (lambda c: T.one_of(c, T.SPEAKER_ROLES), "boss", "unknown"),
        (L.is_digest, "a" * 64, True),
        (T.strip_remote_tags, "a<link href='https://fonts.gstatic.com/x' rel=y>b", "ab"),
    ],
)
def test_functions(spark, f, given, want):
    assert one(spark, f(F.lit(given))) == want


def test_diff_tokens_and_lists(spark):
    assert one(spark, T.diff_tokens(F.lit("测试 OpenAI ASR"))) == ["测", "试", "OpenAI", "ASR"]
    assert one(spark, T.split_list(F.lit("a, b；c\n\n，d"))) == ["a", "b", "c", "d"]


def test_redaction_leaves_nothing(spark):
    text = "api_key=abcdef sk-12345678abc 13800138000 a@b.cn 110101199003071234"
    out = one(spark, T.redact(F.lit(text)))
    assert not any(x in out for x in ("abcdef", "12345678", "13800138000", "a@b.cn", "110101199003071234"))


def test_heading_strip_and_keys(spark):
    assert one(spark, T.strip_heading(F.lit("## Plan (v1) the rest"), F.lit("Plan (v1) · 第 1-2 行"))) == "the rest"
    a, b = L.cache_key(x=F.lit(1), y=F.lit("z")), L.cache_key(y=F.lit("z"), x=F.lit(1))
    assert one(spark, a) == one(spark, b) and len(one(spark, a)) == 64


def test_numbers_and_staleness(spark):
    assert one(spark, T.number_text(F.lit(1234.5), 2)) == "1234.50" and one(spark, T.percent_text(F.lit(None).cast("double"))) == "未记录"
    assert [one(spark, L.is_current(F.lit(5), F.lit(v), 2)) for v in (5, 3, 2, 6)] == [True, True, False, False]
    assert one(spark, T.context_tail(F.array(F.lit("abc"), F.lit("de")), 6)) == "\n发言：de"
