"""Text rules as column expressions: cleaning, redaction, tokens, titles, questions, escaping, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a secret may begin or end, \b in the patterns below: ASCII letters, digits and _ count, so one with an accented
#: letter beside it is taken out too, as in SQL.
EDGE = r"(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))"
#: Patterns in the order in which they are applied, and what replaces a match. (?U) gives classes their
#: Unicode meaning.
REDACTIONS = [
    (r"(?iU)\b(?:api[_-]?key|access[_-]?token|token|password|passwd|secret)\s*[:=]\s*(?:bearer\s+)?[^\s,;，；]+", "[凭据]"),
    (r"(?iU)\bbearer\s+[A-Za-z0-9._~+/-]{8,}=*", "[凭据]"),
    (r"(?U)\bgh[pousr]_[A-Za-z0-9]{16,}\b", "[凭据]"),
    (r"(?U)\bAKIA[0-9A-Z]{16}\b", "[凭据]"),
    (r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[凭据]"),
    (r"(?iU)DASHSCOPE_API_KEY\s*=\s*\S+|\bsk-[A-Za-z0-9_-]{8,}\b", "[密钥]"),
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[邮箱]"),
    (r"(?U)(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号]"),
    (r"(?U)(?<!\d)\d{17}[\dXx](?!\d)", "[身份证]"),
    (r"(?U)(?<![a-zA-Z0-9_.])/(?:Users|home|private|var|tmp|etc|opt|Volumes)/[^\s,;，；]+", "[路径]"),
    (r"(?iU)\b[a-z]:\\[^\s,;，；]+", "[路径]"),
]
#: Han characters that carry no meaning alone.
HAN_STOP = "的了是在和与及或我你他她它们这那一个有就也很都而及其为于把被到说"
#: Fixed value: Latin words, numbers, runs of Han characters.
TOKEN = r"[a-zA-Z][a-zA-Z0-9_.+-]*|\d+(?:\.\d+)?|[㐀-鿿]+"
#: What makes a turn important, a closing, a question.
IMPORTANT = r"决定|结论|承诺|下一步|行动项|负责人|截止|风险|问题|阻塞|指标|结果|完成|未完成|需要核实"
CLOSING = r"以上就是|谢谢(?:大家|各位|老师)|欢迎(?:大家|各位|老师)?.{0,8}提问|(?:我的|本次|今天的)?.{0,8}(?:汇报|分享|介绍)(?:到此)?(?:完毕|结束)"
QUESTION_WORDS = r"为什么|怎么(?:办|做|实现|部署)?|如何|能否|可否|是否|是不是|有没有|多少|谁|哪里|哪个|哪些|什么时候|几点"
QUESTION_TAIL = r"[吗么呢嘛]\s*[。！!]?\s*$"
#: Fixed value: numbers of chapters and sections before a title.
SECTION_PREFIX = (
    r"(?U)^\s*(?:(?:第\s*)?[一二三四五六七八九十百]+\s*(?:章节|部分|[、.．:：-])+|(?:第\s*)?\d+\s*(?:章节|部分|[、.．:：-])+|第\s*[一二三四五六七八九十百]+)\s*"
)
#: Names of scenarios and their aliases.
SCENARIOS = {
    "general": "general", "meeting": "general", "general_meeting": "general", "普通会议": "general", "会议": "general",
    "defense": "defense", "答辩": "defense", "group_meeting": "group_meeting", "组会": "group_meeting",
    "project_report": "project_report", "汇报": "project_report", "比赛汇报": "project_report", "custom": "custom", "自定义": "custom",
}
#: Where a turn may come from, and who may have spoken.
TURN_SOURCES = ["unknown", "self_mic", "meeting_audio", "remote_audio", "manual_input", "microphone"]
SPEAKER_ROLES = ["unknown", "self", "other", "reviewer"]
SPACES = r"(?U)[\s\x1c-\x1f]+"


def clean(x: Column) -> Column:
    """NULs become spaces, runs of white space one space, ends are stripped."""
    return F.trim(F.regexp_replace(F.translate(x, "\x00", " "), SPACES, " "))


def redact(x: Column) -> Column:
    for pattern, put in REDACTIONS:
        x = F.regexp_replace(x, pattern.replace(r"\b", EDGE), put)
    return x


def bounded(x: Column, limit: int) -> Column:
    """Cleaned, redacted, and only then cut."""
    return F.left(redact(clean(x)), F.lit(limit))


def clean_model_output(x: Column, limit: int) -> Column:
    """Without short tags, fences, bold marks and a leading heading mark; then bounded()."""
    x = F.regexp_replace(x, r"<[^>]{1,200}>", "")
    for mark in ("```", "**", "__"):
        x = F.replace(x, F.lit(mark), F.lit(""))
    return bounded(F.regexp_replace(x, r"(?U)^\s{0,3}#{1,6}\s*", ""), limit)


def folded(x: Column) -> Column:
    """Lower case, with the sharp s as two letters, as full case folding has it."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def tokens(x: Column) -> Column:
    """Latin words, numbers, and of runs of Han characters the single ones and pairs that aren't all stops."""
    found = F.regexp_extract_all(folded(x), F.lit(TOKEN), F.lit(0))
    stop = F.lit(HAN_STOP)

    def split(t: Column) -> Column:
        n = F.length(t)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(1)))
        ones = F.filter(chars, lambda c: F.instr(stop, c) == 0)
        pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        pairs = F.filter(pairs, lambda p: ~((F.instr(stop, F.substring(p, 1, 1)) > 0) & (F.instr(stop, F.substring(p, 2, 1)) > 0)))
        return F.when(t.rlike("^[㐀-鿿]"), F.concat(ones, pairs)).otherwise(F.array(t))

    # only where there is Han text are tokens looked into one by one
    return F.when(x.rlike("[㐀-鿿]"), F.flatten(F.transform(found, split))).otherwise(found)


def token_count(x: Column) -> Column:
    """size(tokens(x)); where there is no Han text, counted without making them."""
    return F.when(x.rlike("[㐀-鿿]"), F.size(tokens(x))).otherwise(F.regexp_count(folded(x), F.lit(TOKEN)))


def match_terms(x: Column) -> Column:
    """Distinct tokens that say something: of two characters at least, or a Latin letter or digit."""
    return F.array_distinct(F.filter(tokens(x), lambda t: (F.length(t) >= 2) | t.rlike("[a-zA-Z0-9]")))


def coverage(reference: Column, spoken: Column) -> tuple[Column, Column]:
    """Of two term arrays: shared terms over the smaller set's, and their number; 0 if either is empty."""
    n = F.size(F.array_intersect(reference, spoken))
    least = F.least(F.size(reference), F.size(spoken))
    return F.when(least > 0, n / least).otherwise(F.lit(0.0)), F.when(least > 0, n).otherwise(F.lit(0))


def section_title(x: Column) -> Column:
    """A heading's key: without its number, letters, digits and Han characters only, folded."""
    return folded(F.regexp_replace(F.regexp_replace(clean(x), SECTION_PREFIX, ""), "[^a-zA-Z0-9㐀-鿿]+", ""))


def agenda_title(x: Column) -> Column:
    text = bounded(x, 600)
    head = F.regexp_extract(text, r"^(.{1,100}?)[：:](?U)\s*(.+)$", 1)
    return F.when(head == "", text).otherwise(F.coalesce(F.nullif(bounded(head, 160), F.lit("")), text))


def agenda_points(x: Column) -> Column:
    """What follows the first colon, split at semicolons: six distinct points at most."""
    rest = F.regexp_extract(bounded(x, 600), r"^(.{1,100}?)[：:](?U)\s*(.+)$", 2)
    points = F.transform(F.split(rest, r"(?U)[；;]\s*", -1), lambda p: bounded(p, 240))
    return F.slice(F.array_distinct(F.filter(points, lambda p: p != "")), 1, 6)


def strip_heading(text: Column, locator: Column) -> Column:
    """A chunk's text without the heading that its locator names, unless the locator is a bare place."""
    head = clean(F.element_at(F.split(locator, "·", -1), 1))
    bare = head.rlike(r"^(?:正文|第(?U)\s*\d+.*|段落\s*\d+|幻灯片\s*\d+)$")
    # \Q..\E can't hold an \E of its own
    pattern = F.concat(F.lit(r"(?iU)^\s*#{1,6}\s*\Q"), F.replace(head, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\s*"))
    return F.when((head != "") & ~bare, F.regexp_replace(clean(text), pattern, F.lit(""))).otherwise(clean(text))


def is_question(x: Column) -> Column:
    t = clean(x)
    return (t != "") & (t.rlike(r"[?？]\s*$") | t.rlike(QUESTION_TAIL) | t.rlike(QUESTION_WORDS))


def is_closing(x: Column) -> Column:
    return x.rlike(CLOSING)


def importance(x: Column, pattern: str = IMPORTANT) -> Column:
    """2 for an important turn, 1 for a question mark, else 0."""
    return F.when(x.rlike(pattern), 2).when(x.rlike("[?？]"), 1).otherwise(0)


def diff_tokens(x: Column) -> Column:
    """Latin words, single Han characters, other visible characters one by one."""
    return F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_]+|[一-鿿]|(?U)[^\s]"), F.lit(0))


def unsafe_html(x: Column) -> Column:
    """Whether markup holds a script, a script address or an event handler."""
    t = F.lower(x)
    return t.contains("<script") | t.contains("javascript:") | t.rlike(r"\son[a-z]+\s*=")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


#: Scripts and style sheets that a UI toolkit loads from elsewhere.
REMOTE_TAGS = [
    r"(?i)<script\b[^>]*\bsrc=[\"']https://cdnjs\.cloudflare\.com/ajax/libs/iframe-resizer/[^\"']+[\"'][^>]*>\s*</script>",
    r"(?i)<link\b[^>]*\bhref=[\"']https://fonts\.(?:googleapis|gstatic)\.com[^\"']*[\"'][^>]*>",
]


def strip_remote_tags(x: Column) -> Column:
    for pattern in REMOTE_TAGS:
        x = F.regexp_replace(x, pattern, "")
    return x


def split_list(x: Column) -> Column:
    """Items of a typed list: parted by lines, commas and semicolons of either script."""
    return F.filter(F.transform(F.split(x, r"[\n\r,，;；]+", -1), clean), lambda p: p != "")


def alias(x: Column, names: dict[str, str], other: str | None = None) -> Column:
    """A name by its alias, without regard to case; other if there is none."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(F.try_element_at(table, folded(F.trim(x))), F.lit(other))


def one_of(x: Column, allowed: list[str], other: str = "unknown") -> Column:
    t = folded(F.trim(x))
    return F.when(t.isin(allowed), t).otherwise(F.lit(other))


#: Paths of either kind.
PATHS = [
    r"(?U)(?<![\w.-])(?:/[^/\r\n,;，；。！？!?'\"<>]+){2,}",
    r"(?iU)(?<![\w.-])[a-z]:\\(?:[^\\:\r\n,;，；。！？!?'\"<>]+\\)+[^\\:\r\n,;，；。！？!?'\"<>]+",
]


def safe_error(x: Column) -> Column:
    """An error's text fit to be shown: no paths, no secrets, 240 characters; empty for null."""
    x = F.coalesce(x, F.lit(""))
    for pattern in PATHS:
        x = F.regexp_replace(x, pattern, "[路径]")
    return F.left(clean(redact(x)), F.lit(240))


def number_text(x: Column, digits: int, missing: str = "未记录") -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")))


def percent_text(x: Column, missing: str = "未记录") -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.concat(F.replace(F.format_number(x * 100, 1), F.lit(","), F.lit("")), F.lit("%")))


def change_text(before: Column, after: Column, tolerance: float = 1e-12) -> Column:
    """What became of an error rate, in percentage points."""
    delta = (before - after) * 100
    size = F.replace(F.format_number(F.abs(delta), 1), F.lit(","), F.lit(""))
    return (
        F.when(delta.isNull(), F.lit("变化未记录"))
        .when(delta > tolerance, F.concat(F.lit("下降 "), size, F.lit(" 个百分点（改善）")))
        .when(delta < -tolerance, F.concat(F.lit("上升 "), size, F.lit(" 个百分点（变差）")))
        .otherwise(F.lit("持平"))
    )


def truthy(x: Column) -> Column:
    """A CSV cell as a boolean; null for what is neither."""
    t = F.lower(F.trim(x))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def strength(x: Column) -> Column:
    """A number within 0 to 1; null and NaN are 0."""
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def context_tail(texts: Column, limit: int = 2600, prefix: str = "发言：") -> Column:
    """The last characters of an array of turns, a line each."""
    return F.right(F.array_join(F.transform(texts, lambda t: F.concat(F.lit(prefix), t)), "\n"), F.lit(limit))


def device_kind(x: Column) -> Column:
    """What a sound device's name says it is; the virtual kind first."""
    t = folded(x)
    return (
        F.when(t.rlike("blackhole|loopback|vb-cable"), F.lit("virtual"))
        .when(t.rlike("headphone|headset|airpods|earbuds|耳机|耳麦|耳塞"), F.lit("headphones"))
        .otherwise(F.lit("other"))
    )
